"""Each stage of the pipeline against brute force, on what the stage before it kept."""
import corpus_pipeline
from test_native import hits
from test_pairs_and_spans import components
from texts import SF, frame


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, tmp_path):
    from logbraid.llm.quality_rules import quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing",
    ]
    before = rows_of(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if i == 4:
            assert {r.doc_id for r in out.collect()} == set(before)
            assert max(r.offset + r.length for r in out.collect()) <= 2048
            break
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        after = rows_of(out)
        texts = [(d, r.text) for d, r in before.items()]
        if i == 0:
            assert set(after) == {r.doc_id for r in quality_rules(docs).where("kept").collect()}
        elif i == 1:
            assert set(after) == {d for d, _, c in components(texts, 5, 80) if d == c}
        elif i == 2:
            first = {}
            raw = {d: t.encode() for d, t in texts}
            for d in sorted(raw):
                for at in range(len(raw[d]) - 49):
                    first.setdefault(raw[d][at : at + 50], d)
            for d, t in raw.items():
                gone = bytearray(len(t))
                for at in range(len(t) - 49):
                    if first[t[at : at + 50]] < d:
                        gone[at : at + 50] = b"\1" * 50
                kept = bytes(c for c, g in zip(t, gone) if not g)
                assert (d in after) == bool(kept)
                if kept:
                    assert after[d].text == kept.decode(errors="ignore") and after[d].n_chars == len(after[d].text)
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {d for d, n, hit, _, _ in hits(texts, items, 13) if hit and 20 * hit >= n}
            assert set(after) == set(before) - bad and all(after[d].text == before[d].text for d in after)
        docs, before = out, after


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts and repeated rows pass or go by the same rules; a repeated row stays once."""
    docs = frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    near = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    ids = [r.doc_id for r in near]
    assert len([d for d in ids if d is not None]) == len({d for d in ids if d is not None})
    assert ids.count(None) == 2 and {50, 51, 52} <= set(ids)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).collect() == []
        assert stage(spark, docs, SF).count() > 0
