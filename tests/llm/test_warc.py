"""WARC archives: what comes back equals what went in, record types against a plain model."""
import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logbraid.llm import warc

PAGES = "page_id long, url string, html string, row long, digest string, chunk int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "d", 2) for i, u, h in rows], PAGES).repartition(3)


def sample(seed=3):
    rng = random.Random(seed)
    texts = ["", None, "é\r\n\r\nWARC/1.1\r\n" * 3, "a" * 5000, "\x00\n", *("<p>%d</p>" % rng.randrange(9) * rng.randint(1, 90) for _ in range(40))]
    out = [(i, f"http://h{i}.org/ä b\r\nX: y" if i % 3 else None, rng.choice(texts)) for i in range(150)]
    return [*out, out[7], out[7], (None, "u", texts[3]), (None, None, "only here"), (None, None, None)]


def model(rows, min_bytes=0):
    """Multiset of results; equal (page_id, payload) rows differ in nothing but their number."""
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for data, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids.sort(key=lambda i: (i is not None, i), reverse=True)
        for n, i in enumerate(ids):
            again = n > 0 and len(data) >= min_bytes
            out.append((i, len(data), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_types_equal_a_plain_model(spark, min_bytes):
    rows = sample()
    got = warc.round_trip(pages(spark, rows), min_bytes)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == model(rows, min_bytes)
    assert got.where("not intact").count() == 0


@pytest.mark.parametrize(("chunk", "archive"), [(1 << 20, 1 << 28), (7, 1), (64, 3000)])
def test_payloads_come_back_byte_by_byte(spark, chunk, archive):
    rows = sample(5)
    manifest = warc.write_warc(pages(spark, rows), chunk_bytes=chunk, archive_bytes=archive)
    back = warc.read_warc(spark, manifest, chunk_bytes=chunk)
    assert back.where(F.octet_length("data") > chunk).count() == 0
    texts = {}
    for r in back.orderBy("record_id", "chunk").collect():
        record = texts.setdefault(r.record_id, [r.record_type, r.page_id, r.refers_to_id, bytearray(), hashlib.sha1()])
        record[3] += r.data
        record[4].update(r.data)
        assert (r.end, r.digest) == (len(record[3]), warc.base32_sha1(record[4]))  # each chunk carries the digest so far
        if r.last and r.record_type == "response":
            assert r.stated_digest == r.digest
    assert len(texts) == len(rows) == sum(r.n_records for r in manifest.collect())
    got = [(page, texts[refers or me][3].decode()) for me, (_, page, refers, _, _) in texts.items()]
    assert sorted(got, key=repr) == sorted(((i, h or "") for i, _, h in rows), key=repr)


def test_archives_are_plain_warc(spark):
    manifest = warc.write_warc(pages(spark, [(1, "http://a/b c", "hällo"), (2, "http://a", "hällo")])).collect()
    text = b"".join(gzip.open(m.path.removeprefix("file://")).read() for m in manifest).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Target-URI: http://a/b%20c\r\n" in text
    assert text.count("hällo\r\n\r\n") == 1 and "WARC-Type: revisit" in text and warc.REVISIT_PROFILE in text


def test_no_rows_and_broken_archives(spark):
    assert warc.round_trip(pages(spark, [(1, "u", "x")]).limit(0)).count() == 0
    (m,) = warc.write_warc(pages(spark, [(1, "u", "x" * 100_000)]).coalesce(1)).collect()
    path = m.path.removeprefix("file://")
    data = open(path, "rb").read()
    cut = path + ".cut"
    open(cut, "wb").write(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends inside"):
        warc.read_warc(spark, spark.createDataFrame([(cut,)], "path string")).collect()


def test_archives_that_are_not_packed(spark, tmp_path):
    path = tmp_path / "x.warc"
    path.write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Type: text/plain\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n" * 2)
    got = warc.read_warc(spark, spark.createDataFrame([(f"file://{path}",)], "path string"))
    assert [(r.record_type, bytes(r.data), r.last) for r in got.collect()] == [("resource", b"ab\r\n", True)] * 2
