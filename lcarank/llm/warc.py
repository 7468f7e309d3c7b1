"""WARC archives: written as records, read back, and put together again as captures.

Writing. A capture is three records: a request, a response (or a revisit of an earlier capture with
the same payload) and metadata; request and metadata name the response in WARC-Concurrent-To. Of
captures with equal payloads of at least MIN_REVISIT bytes, the one with the smallest id is the
response and the others are revisits, which carry no payload and name the response in
WARC-Refers-To. Files are written by Spark's text writer: a record without its closing two CR LF is a
line, and two CR LF are the line separator, so a file is plain WARC 1.1, compressed as a whole.

Reading. Files come in through Spark's binary reader, one archive at a time; records are cut by their
Content-Length, so a payload may hold anything. Payload length and digest are taken from the bytes.

Assembly. Records meet at their capture's id (their own for responses and revisits, the one in
WARC-Concurrent-To for the others) in one row with nested request, response and metadata; revisits
then take what they refer to from the response. Records of a kind that meet twice: the smallest
record id counts. A request or metadata record without a response makes a row whose response is null.

Null html is an empty payload, a null url an empty target. Rows alike in
page id and payload make one capture's records again and come back as often as they were written; those
with the smallest id of a payload are all responses. A null page id never counts
as the smallest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcarank.llm.common import CHUNK_BYTES, tidy
from lcarank.session import ensure_checkpoint_dir, materialize

MIN_REVISIT = 100
#: Records in a file at most, so that an archive fits a task's memory.
FILE_RECORDS = 30_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def record_id(*parts) -> str:
    h = hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def make_record(kind: str, rid: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    """A record without the two CR LF that end it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def capture_records(page: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers: int | None) -> list[bytes]:
    """Request, response or revisit (of the page ``refers``), metadata."""
    target = "".join((url or "").split())  # white space would end a header
    rid, uri = record_id(page, digest, "response"), [("WARC-Target-URI", target)]
    together, digested = ("WARC-Concurrent-To", rid), ("WARC-Payload-Digest", f"sha256:{digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    if refers is None:
        main = make_record("response", rid, http + payload, [*uri, digested, ("Content-Type", "application/http; msgtype=response")])
    else:
        main = make_record("revisit", rid, http, [*uri, digested, ("WARC-Refers-To", record_id(refers, digest, "response")), ("WARC-Profile", PROFILE),
                                                  ("Content-Type", "application/http; msgtype=response")])
    request = make_record("request", record_id(page, digest, "request"), f"GET {target} HTTP/1.1\r\n\r\n".encode(),
                          [*uri, together, ("Content-Type", "application/http; msgtype=request")])
    about = "" if page is None else f"page-id: {page}\r\n"
    metadata = make_record("metadata", record_id(page, digest, "metadata"), about.encode(), [*uri, together, ("Content-Type", "application/warc-fields")])
    return [request, main, metadata]


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page``, ``url``, ``payload``, ``n_bytes``, ``digest``, ``refers_to`` (null: a response)."""
    body = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("payload")) \
        .withColumns({"n_bytes": F.octet_length("payload"), "digest": F.sha2("payload", 256)})
    small = source.select("page", "n_bytes", "digest").where(f"n_bytes >= {MIN_REVISIT}")
    firsts = small.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    later = small.join(firsts, "digest").where("page > first or page is null") \
        .groupBy("page", "digest").agg(F.first("first").alias("refers_to"))
    # Few pages are revisits; their ids meet the pages once, with a null id as its own key.
    return source.join(later.withColumnRenamed("digest", "same").withColumnRenamed("page", "later"),
                       F.expr("page <=> later and digest = same"), "left").drop("later", "same")


def write_archives(captures: DataFrame, path: str) -> None:
    """WARC files of the rows of ``plan_captures``. A capture is named by its page and payload."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = make_record("warcinfo", record_id("file", path), b"software: lcarank\r\nformat: WARC File Format 1.1\r\n",
                           [("Content-Type", "application/warc-fields")])
        held, size, started = [], 0, False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started:
                    held, started = [info], True
                made = capture_records(*row)
                held += made
                size += sum(map(len, made))
                if size > CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    captures.select("page", "url", "payload", "n_bytes", "digest", "refers_to").mapInArrow(run, "record binary") \
        .select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()) \
        .option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _bytes_of(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive, unpacked piece by piece; any number of gzip members."""
    if content[:2] != b"\x1f\x8b":
        for i in range(0, len(content), CHUNK_BYTES):
            yield content[i:i + CHUNK_BYTES]
        return
    rest = memoryview(content)
    while len(rest):
        member, used = zlib.decompressobj(31), 0
        while not member.eof and used < len(rest):
            part = rest[used:used + (1 << 18)]
            used += len(part)
            yield member.decompress(part)
        rest = rest[used - len(member.unused_data):]


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-case names, block) of every record; ValueError on a broken one."""
    source, buffer, at = _bytes_of(content), bytearray(), 0

    def fill(until: int) -> bool:
        nonlocal buffer, at
        if at > CHUNK_BYTES:
            del buffer[:at]
            until, at = until - at, 0
        while len(buffer) < until:
            part = next(source, None)
            if part is None:
                return False
            buffer += part
        return True

    while True:
        end = buffer.find(END, at)
        while end < 0:
            if not fill(len(buffer) + 1):
                if bytes(buffer[at:]).strip(b"\r\n"):
                    raise ValueError("a WARC record breaks off in its header")
                return
            end = buffer.find(END, at)
        head = bytes(buffer[at:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        length = int(fields["content-length"])
        before = at
        if not fill(end + 4 + length):
            raise ValueError("a WARC record breaks off in its block")
        end -= before - at
        yield fields, bytes(buffer[end + 4:end + 4 + length])
        at = end + 4 + length
        fill(at + 4)
        while buffer[at:at + 2] == b"\r\n":
            at += 2


RECORD = ("type string, record_id string, concurrent_to string, refers_to string, target string, declared string, "
          "n_bytes long, digest string, fields string")


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record but warcinfo. ``n_bytes`` and ``digest`` (SHA-256) are of the HTTP payload of
    responses; ``fields`` is the block of metadata; ``payload`` comes only if asked for."""
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"n_bytes": pa.int64(), "payload": pa.binary()}
        pack = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names=names)
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse_archive(content.as_py()):
                    kind = f.get("warc-type")
                    if kind == "warcinfo":
                        continue
                    body = block.partition(END)[2] if kind == "response" else None
                    rows.append((kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"),
                                 f.get("warc-payload-digest"), None if body is None else len(body),
                                 None if body is None else hashlib.sha256(body).hexdigest(),
                                 block.decode("utf-8", "replace") if kind == "metadata" else None, body))
                    size += len(block) if payloads else 256
                    if size > CHUNK_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD + ", payload binary" * payloads)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture`` (id of its response or revisit), nested ``request``,
    ``response`` and ``metadata``, and ``original``, the capture that a revisit refers to with its
    payload's length and digest."""
    own = F.col("type").isin("response", "revisit")
    rest = [c for c in records.columns if c not in ("record_id", "concurrent_to", "fields", "target")]
    one = lambda kinds, *cols: F.min(F.when(F.col("type").isin(*kinds), F.struct("record_id", *cols)))
    captures = materialize(records.where(F.col("type").isin("request", "response", "revisit", "metadata"))
                           .withColumn("capture", F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to")))
                           .groupBy("capture").agg(one(["request"], "target").alias("request"),
                                                   one(["response", "revisit"], "target", *rest).alias("response"),
                                                   one(["metadata"], "fields").alias("metadata"),
                                                   F.greatest(F.sum(own.cast("int")), F.lit(1)).alias("copies")))
    page = F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1).try_cast("long")
    captures = captures.withColumn("page", page)
    found = captures.where("response.type = 'response'").select(
        F.col("capture").alias("referred"), F.struct("capture", "page", "response.n_bytes", "response.digest").alias("original"))
    return captures.join(found, F.col("response.refers_to") == F.col("referred"), "left") \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("referred", "copies", "copy")


def digest(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and put captures together;
    the registered query's columns."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    write_archives(plan_captures(pages), path)
    return assemble(read_records(spark, path)).select(
        F.col("page").alias("page_id"),
        F.coalesce("response.n_bytes", "original.n_bytes").alias("payload_bytes"),
        F.coalesce("response.digest", "original.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("original.page").alias("refers_to"))
