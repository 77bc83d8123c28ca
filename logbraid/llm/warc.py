"""WARC archives through a table of chunks: no step holds a whole record.

1. A payload is cut into rows (row, chunk, data) of at most `chunk_bytes`. Each row carries the digest of the payload up to its own end, so the
   last one has the payload's digest and length, and the table without `data` says all there is to know about the records.
2. Records with equal payloads (by length and SHA-1) are grouped; one of each group becomes the `response`, the rest revisit it. Only
   numbers and digests move for that.
3. Chunks and one header row per record (chunk -1) are dealt by record and sorted by (row, chunk); a task streams them into archives, one gzip member
   per record, and starts a new archive beyond `archive_bytes`.
4. Archives are read back as streams, into the same kind of chunk rows, with digests counted anew.

A task writes archives under names of its own; only those that a finished task has listed in the manifest are read, so lost and repeated tasks
do no harm. Archives are opened with `pyarrow.fs`, at a URI that all executors share.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logbraid.llm.arrow_text import tidy_map
from logbraid.session import new_folder

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
#: A batch of rows is handed on when its chunks hold so many bytes or it has so many rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096

CHUNKS = "row long, page_id long, url string, chunk int, end long, digest string, last boolean, data binary"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = (
    "path string, record_id string, record_type string, page_id long, url string, refers_to_id string, stated_digest string, "
    "chunk int, end long, digest string, last boolean, data binary"
)

#: Names and forms that the WARC format fixes.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http;msgtype=response"
#: A field of our own, which other readers skip.
PAGE_FIELD = "X-Page-ID"


def base32_sha1(hasher) -> str:
    return base64.b32encode(hasher.digest()).decode()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


class _Rows:
    """Gathers rows into batches of bounded size."""

    def __init__(self, ddl: str):
        self.schema, self.rows, self.size = _schema(ddl), [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= BATCH_BYTES or len(self.rows) >= BATCH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.size = [], 0


def _map_chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(CHUNKS)
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("row", "page_id", "url")), strict=True)
            for (row, page_id, url), payload in zip(keys, batch.column("payload"), strict=True):
                data = memoryview(payload.as_buffer() if payload.is_valid else b"")
                sha, chunk = hashlib.sha1(), 0
                for at in range(0, max(1, len(data)), chunk_bytes):
                    piece = data[at : at + chunk_bytes]
                    sha.update(piece)
                    end = at + len(piece)
                    yield from out.add((row, page_id, url, chunk, end, base32_sha1(sha), end == len(data), bytes(piece)), len(piece))
                    chunk += 1
        yield from out.flush()

    return run


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(row, page_id, url, chunk, end, digest, last, data): the payloads (`html` as UTF-8; null is empty) of pages(page_id, url, html) in chunks.

    `row` is unique for each row of `pages`, also if rows repeat. `end` is the number of payload bytes up to the end of the chunk and
    `digest` their SHA-1 in base 32. An empty payload is one empty chunk. The table is written to the shared folder, so that `row` stays as it is.
    """
    spark = pages.sparkSession
    folder = new_folder(spark)
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("payload"),
    )
    rows.mapInArrow(tidy_map(_map_chunks(chunk_bytes)), CHUNKS).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(CHUNKS).parquet(folder)


def assign_types(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(row, page_id, url, n_bytes, digest, refers_row): one row per record of a chunk table.

    Of the records whose payloads are equal and hold at least `min_bytes`, the one with the largest page_id (null is least; then the largest row) has
    no `refers_row`; the others refer to it. Smaller payloads refer to nothing.
    """
    records = chunks.where("last").select("row", "page_id", "url", F.col("end").alias("n_bytes"), "digest")
    key = F.struct(F.col("page_id").isNotNull(), F.col("page_id"), F.col("row"))
    first = records.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max(key).alias("first"), F.count("*").alias("n"))
    # Only payloads that come twice have something to look up.
    several = first.where("n > 1").select("digest", "n_bytes", F.col("first.row").alias("first_row"))
    found = records.join(several, ["digest", "n_bytes"], "left")
    refers = F.when(F.col("first_row") != F.col("row"), F.col("first_row"))
    return found.select("row", "page_id", "url", "n_bytes", "digest", refers.alias("refers_row"))


def _open(uri: str):
    """The file system of a URI and the path in it; Spark writes local ones with one slash."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _record_id(run: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), str(row))}>"


def _printable(url: str) -> str:
    """A URI fit for a header line: everything but visible ASCII in percent signs."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _header(run: str, date: str, row: int, page_id, url, n_bytes: int, digest: str, refers_row) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    response = refers_row is None
    fields = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", _record_id(run, row)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _printable(url) if url else None),
        (PAGE_FIELD, page_id),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", None if response else REVISIT_PROFILE),
        ("WARC-Refers-To", None if response else _record_id(run, refers_row)),
        ("Content-Type", RESPONSE_TYPE),
        ("Content-Length", len(http) + (n_bytes if response else 0)),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"{VERSION}\r\n{lines}\r\n{http}".encode()


def _map_archives(folder: str, run_id: str, date: str, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        name = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        done: list[tuple[str, int, int]] = []
        sink = member = None
        path, n_records, n_bytes, skip = "", 0, 0, False

        def put(data: bytes) -> None:
            nonlocal n_bytes
            if data:
                sink.write(data)
                n_bytes += len(data)

        def end_record() -> None:
            nonlocal member
            if member is not None:
                put(member.compress(b"\r\n\r\n") + member.flush())
                member = None

        def end_archive() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                done.append((path, n_records, n_bytes))
                sink = None

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "chunk", "page_id", "url", "n_bytes", "digest", "refers_row")]
            data = batch.column("data")
            for i, (row, chunk, page_id, url, size, digest, refers) in enumerate(zip(*columns, strict=True)):
                if chunk >= 0:
                    if not skip:
                        put(member.compress(data[i].as_buffer()))
                    continue
                end_record()
                if n_bytes >= archive_bytes:
                    end_archive()
                if sink is None:
                    path, n_records, n_bytes = f"{name}-{len(done):05d}.warc.gz", 0, 0
                    sink = files.open_output_stream(path, compression=None)
                skip = refers is not None
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                put(member.compress(_header(run_id, date, row, page_id, url, size, digest, refers)))
                n_records += 1
        if sink is not None:
            end_record()
            end_archive()
        yield pa.RecordBatch.from_pylist([{"path": p, "n_records": r, "n_bytes": b} for p, r, b in done], _schema(MANIFEST))

    return run


def write_warc(
    pages: DataFrame, folder: str | None = None, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = 6
) -> DataFrame:
    """Writes pages(page_id, url, html) to gzip archives below `folder` (a URI that all executors share; a new shared folder by default) and returns the
    manifest (path, n_records, n_bytes), one row per archive.

    A null html is an empty payload, a null url has no target, a null page_id no page field. Repeated rows are records of their own. An
    empty table gives no archive; other columns are ignored. A record's url is written in visible ASCII.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark)
    files, base = _open(folder)
    files.create_dir(base, recursive=True)
    chunks = chunk_table(pages, chunk_bytes)
    heads = assign_types(chunks, min_bytes).withColumns({"chunk": F.lit(-1), "data": F.lit(None).cast("binary")})
    bodies = chunks.select("row", "chunk", "data").where(F.octet_length("data") > 0)
    stream = heads.unionByName(bodies, allowMissingColumns=True).repartition("row").sortWithinPartitions("row", "chunk")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    manifest = new_folder(spark)
    stream.mapInArrow(tidy_map(_map_archives(folder, str(uuid.uuid4()), date, archive_bytes, level)), MANIFEST).write.parquet(manifest)
    scheme = folder.partition(":")[0] + ":" if ":/" in folder else ""
    return spark.read.schema(MANIFEST).parquet(manifest).withColumn("path", F.concat(F.lit(scheme + "//" if scheme else ""), "path"))


class _Stream:
    """Bytes of an archive, decompressed member by member, in pieces of bounded size."""

    def __init__(self, source, size: int):
        self.source, self.size, self.buffer, self.inflate = source, size, b"", None
        self.raw = source.read(size)
        self.packed = self.raw[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(self.size)
            if not self.raw:
                if self.inflate is not None:
                    raise ValueError("the archive ends inside a gzip member")
                return False
        if not self.packed:
            self.buffer, self.raw = self.buffer + self.raw, b""
            return True
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        self.buffer += self.inflate.decompress(self.raw, self.size)
        self.raw = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
        return True

    def line(self) -> bytes | None:
        """Without its end; None at the end of the archive."""
        while (at := self.buffer.find(b"\n")) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends inside a line")
                return None
        got, self.buffer = self.buffer[:at], self.buffer[at + 1 :]
        return got.rstrip(b"\r")

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            while not self.buffer:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            yield piece

    def fields(self) -> dict[str, str]:
        """Header lines up to an empty one, names in lower case."""
        found = {}
        while line := self.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.strip().lower()] = value.strip()
        return found


def _records(stream: _Stream, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = stream.fields()
        left = int(head["content-length"])
        if head.get("content-type", "").lower().startswith("application/http"):
            before = bytearray()
            while left and not before.endswith(b"\r\n\r\n"):
                got = stream.line()
                if got is None or left < len(got) + 2:
                    raise ValueError("a record ends inside its HTTP header")
                before += got + b"\r\n"
                left -= len(got) + 2
                if not got:
                    break
        page = head.get(PAGE_FIELD.lower())
        key = (
            head.get("warc-record-id"), head.get("warc-type"), int(page) if page else None, head.get("warc-target-uri"),
            head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        )
        sha, end, chunk, held = hashlib.sha1(), 0, 0, []
        size = 0
        for piece in stream.take(left):
            while piece:
                part, piece = piece[: chunk_bytes - size], piece[chunk_bytes - size :]
                sha.update(part)
                size, end = size + len(part), end + len(part)
                if with_data:
                    held.append(part)
                if size == chunk_bytes and end < left:
                    yield (*key, chunk, end, base32_sha1(sha), False, b"".join(held) if with_data else None)
                    chunk, size, held = chunk + 1, 0, []
        yield (*key, chunk, end, base32_sha1(sha), True, b"".join(held) if with_data else None)


def _map_read(chunk_bytes: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(RECORDS)
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                files, path = _open(uri)
                with files.open_input_stream(path, compression=None) as source:
                    try:
                        for row in _records(_Stream(source, min(chunk_bytes, CHUNK_BYTES)), chunk_bytes, with_data):
                            yield from out.add((uri, *row), len(row[-1] or b""))
                    except (ValueError, KeyError, zlib.error) as error:
                        raise ValueError(f"{uri}: {error}") from error
        yield from out.flush()

    return run


def read_warc(spark: SparkSession, archives: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, record_id, record_type, page_id, url, refers_to_id, stated_digest, chunk, end, digest, last, data): the records of the
    archives named by archives(path), in chunks; one task reads one archive as a stream.

    `digest` is counted from the payload read, up to the end of the chunk; `stated_digest` is the header's. The last chunk of a record has `last`, so
    records without data are `read_warc(..., with_data=False).where("last")`. An archive that breaks off is an error that names it.
    """
    paths = archives.select("path").repartition("path")
    return paths.mapInArrow(tidy_map(_map_read(chunk_bytes, with_data)), RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact): one row per record that was read (read_warc, the rows with
    `last`), where a revisit has the length of the response that it refers to and `refers_to` is that one's page_id.

    `intact` says whether the payload has the digest its header states; for a revisit, whether its response was found and states the same digest.
    """
    response = records.where("record_type = 'response'")
    plain = response.select(
        "page_id", F.col("end").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"), F.col("stated_digest").eqNullSafe(F.col("digest")).alias("intact"),
    )
    target = response.select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("end").alias("payload_bytes"), F.col("digest").alias("found")
    )
    again = records.where("record_type = 'revisit'").join(target, "refers_to_id", "left")
    return plain.unionByName(
        again.select(
            "page_id", "payload_bytes", F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to",
            F.col("stated_digest").eqNullSafe(F.col("found")).alias("intact"),
        )
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages, reads the archives back and returns what `resolve_revisits` finds."""
    spark = pages.sparkSession
    folder = new_folder(spark)
    read_warc(spark, write_warc(pages, min_bytes=min_bytes), with_data=False).where("last").drop("data").write.parquet(folder)
    return resolve_revisits(spark.read.parquet(folder))
