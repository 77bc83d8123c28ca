"""Near duplicates, repeated strings and packing against brute force."""
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from texts import frame, pairs


def components(docs, k, percent):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = {d: d for d, _ in docs if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j, (b, _) in enumerate(docs[:i]):
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(docs, sets)), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_similarity_classes(spark, k, percent):
    from logbraid.llm.ngram_join import similarity_classes

    got = sorted((tuple(r) for r in similarity_classes(frame(spark), k, percent).collect()), key=repr)
    assert got == components(pairs(), k, percent)


def test_similarity_of_many_near_copies(spark):
    """Frequent elements only: the groups meet by pivots, and one text links to a copy but not to the pivot."""
    from logbraid.llm.ngram_join import similarity_classes

    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        words[i % 60] = f"x{i}"
        if i % 2:
            words[(i + 20) % 60] = f"y{i % 7}"
        rows.append((i, " ".join(words), "en", "s", 0, 1, 2, "", "", "", ""))
    got = sorted((tuple(r) for r in similarity_classes(frame(spark, rows), 1, 95).collect()), key=repr)
    assert got == components(pairs(rows), 1, 95)


def repeats(docs, size):
    first = {}
    for d, t in docs:
        t = (t or "").encode()
        for i in range(len(t) - size + 1):
            if d is not None:
                first[t[i : i + size]] = min(d, first.get(t[i : i + size], d))
    out = []
    for d, t in docs:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if d is not None and first[t[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        spans = bytes(gone).count(b"\0\1") + (gone[:1] == b"\1")
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [50, 20])
def test_remove_repeats(spark, size):
    from logbraid.llm.suffix_dedup import remove_repeats

    rows = remove_repeats(frame(spark), size, keep=("lang",)).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows]
    assert sorted(got, key=repr) == repeats(pairs(), size)
    assert {r.lang for r in rows} == {"en"}


def test_several_texts_of_one_id(spark):
    from logbraid.llm.suffix_dedup import remove_repeats

    rng = np.random.default_rng(2)
    passage, other = ("".join(chr(c) for c in rng.integers(97, 123, n)) for n in (700, 90))
    docs = [(2, "a" * 3 + passage), (2, "short"), (2, other + passage[:100]), (3, "x" + passage + "y" + other), (3, other * 2), (3, ""), (1, passage[300:420]), (4, other)]
    docs += [(5, "z" * 30 + passage[i : i + 60 + i]) for i in range(60)] + [docs[3], (None, passage), (None, other)]
    rows = [(d, t, "en", "s", 0, 1, 2, "", "", "", "") for d, t in docs]
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == repeats(docs, 50)


def test_one_per_class_keeps_all_texts_of_an_id(spark):
    from logbraid.llm.ngram_join import one_per_class

    one, two = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = [(1, one, "en", "b"), (1, two, "en", "a"), (1, one, "de", "a"), (2, one, "en", "a"), (3, None, None, None), (None, one, "en", "a"), (None, one, "en", "a")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    got = sorted((tuple(r) for r in one_per_class(table, ["doc_id", "text", "lang", "source"]).collect()), key=repr)
    assert got == sorted([(1, one, "de", "a"), (1, two, "en", "a"), (3, None, None, None), docs[5], docs[6]], key=repr)


def test_remove_repeats_in_hot_places():
    """The same steps with places that are hot from the second content on, so suffixes go one by one."""
    import logbraid.llm.suffix_dedup as s

    place, content = np.array([5, 5, 5, 6]), np.array([1, 2, 3, 1])
    doc, lo, count = np.array([1, 2, 3, 4]), np.array([0, 0, 0, 9]), np.array([3, 3, 3, 3])
    old, s.CONTENTS = s.CONTENTS, 2
    try:
        (batch,) = s._send_runs([place, content, doc, lo, count], 1)
    finally:
        s.CONTENTS = old
    parts = dict(zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True))
    told_doc, _, code = s.unpack(parts[-1].as_buffer())
    assert sorted(told_doc.tolist()) == [1, 2, 3] and set((code % 4).tolist()) == {s.HOT}
    step, sent, *_ = s.unpack(parts[0].as_buffer())
    assert np.cumsum(step).tolist() == [5, 5, 6] and sent.tolist() == [1, 2, 1]


def test_contents_of_a_place_keep_64_bits():
    from logbraid.llm.arrow_text import pack, unpack
    from logbraid.llm.suffix_dedup import cover_runs

    data = np.random.default_rng(3).integers(97, 123, 20_000).astype(np.uint8)
    content = cover_runs(data, np.array([0]), np.array([len(data)]), 50)[-1]
    assert content.dtype == np.int64 and np.bitwise_or.reduce(content.view(np.uint64)) == np.uint64(2**64 - 1)
    assert len(np.unique(content >> 44)) > 900
    assert (unpack(pack(content))[0] == content).all()


def test_remove_repeats_of_an_empty_table(spark):
    from logbraid.llm.suffix_dedup import remove_repeats

    assert remove_repeats(frame(spark).where("false")).collect() == []


def test_as_text_drops_split_characters(spark):
    from logbraid.llm.suffix_dedup import remove_repeats

    rows = [(1, "a" + "é" * 30), (2, "bc" + "é" * 25 + "èz")]
    rows = [(d, t, "en", "s", 0, 1, 2, "", "", "", "") for d, t in rows]
    got = {r.doc_id: r.kept for r in remove_repeats(frame(spark, rows), as_text=True).collect()}
    assert got[1] == rows[0][1] and got[2].startswith("bc") and got[2].endswith("z")


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from logbraid.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, capacity = Tokenizer.from_file(path), 256
    want = []
    for d, text in pairs():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((d, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    rows = pack_documents(frame(spark), path, capacity, with_ids=True).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(w[3] for w in want) // capacity) + 2
    assert pack_documents(frame(spark).where("false"), path).collect() == []


def test_best_fit_is_the_one_by_one_walk():
    from logbraid.llm.packing import best_fit

    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 200))).tolist()
        open_: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [(left, i) for i, left in enumerate(open_) if left >= length]
            if fits:
                open_[min(fits)[1]] -= length
            else:
                open_.append(capacity - length)
        histogram = {length: lengths.count(length) for length in set(lengths)}
        plan, used, filled = best_fit(histogram, capacity), set(), defaultdict(int)
        for length, _, first, each, offset, pieces in plan:
            for i in range(pieces):
                used.add(first + i // each)
                assert offset + i % each * length + length <= capacity
                filled[first + i // each] += length
        assert len(used) == len(open_)
        assert sorted(capacity - f for f in filled.values()) == sorted(open_)


def test_words_of_a_text_give_its_ids():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    from logbraid.llm.packing import word_ids

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = st.sampled_from(["The", "THE!!", "the,", "don't", "it's", "a1b2", "é", "é", "́", " ", "\n", "\t", " ", "\x1c", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "ß", "İ", "###", "x.y", "'", "Σς", "日本"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(pieces, st.text(max_size=4))).map("".join))
    def check(text):
        assert word_ids([text], path) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]

    check()
