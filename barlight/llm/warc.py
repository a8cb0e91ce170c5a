"""Operator 8: WARC archives, written and read with segment reassembly.

Archives are written by Spark's text writer with the record separator of the
format as line separator, so any file system that Spark reaches will do. A
block longer than a segment becomes a record and its continuations. Reading
parses each file by content lengths, groups continuations by the origin's
identifier, orders them by segment number, verifies the total length and
decodes chunked transfer framing.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_path, materialise

#: Bytes of a segment, records of a file and bytes of a chunk; the first two bound a file and so a reader's memory.
SEGMENT, FILE_RECORDS, CHUNK = 32_768, 2048, 8192
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2024-01-01T00:00:00Z"
RAW = "record_id string, type string, page_id long, uri string, digest string, refers_to string, origin string, segment int, total long, block binary"


def record_id(page: int | None, digest: str) -> str:
    """The same for repeated rows of a page, so that their segments are the same too."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page} {digest}') if page is not None else uuid.uuid4()}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def http_payload(block: bytes) -> bytes:
    """Body of an HTTP response, without transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    # A line break in a value would end the field.
    head = "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _records(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> Iterator[bytes]:
    kind = "revisit" if refers is not None else "response"
    name = record_id(page, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"\r\n" if refers is not None else http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields: list[tuple[str, object]] = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", _DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Page-ID", page)]
    if refers is not None:
        fields += [("WARC-Refers-To", record_id(refers, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        yield _record(fields, block)
        return
    yield _record([*fields, ("WARC-Segment-Number", 1)], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = i == len(parts)
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{name} {i}')}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", len(block) if last else None)], part)


def write_warc(pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for each page in gzip archives at path.

    Of pages with equal payloads of `least` bytes or more, that with the
    smallest id holds the payload and the others revisit it. A null page is an
    empty payload; a page with a null id is a response of its own.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = F.octet_length(html) >= least
    # Only payloads that repeat are joined.
    again = pages.where(large & F.col(id_col).isNotNull()).groupBy(F.sha2(html, 256).alias("digest")).agg(F.min(F.col(id_col).cast("long")).alias("first"), F.count("*").alias("many")).where("many > 1").select("digest", "first")
    rows = rows.join(again, "digest", "left").select("page", "url", "html", "digest", F.when(F.col("first") < F.col("page"), F.col("first")).alias("refers"))

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for page, url, text, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held += _records(page, url, text.encode(), digest, refers)
                size += len(text)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if end + 4 + size > len(data):
            raise ValueError("the last record is cut short")
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str, decoded: bool = False) -> DataFrame:
    """Raw records (RAW) of the archives at path: fields, and the block of each record or segment.

    decoded: a record that is no segment has its payload in place of its block,
    which spares payloads a second Python worker beside the one that parses.
    """

    def run(batches):
        names = [f.split()[0] for f in RAW.split(", ")]
        for batch in batches:
            for content in batch.column(0).to_pylist():
                if content[:2] == b"\x1f\x8b":
                    unzip, parts = zlib.decompressobj(31), []
                    while content:
                        parts.append(unzip.decompress(content))
                        content = unzip.unused_data
                        unzip = zlib.decompressobj(31)
                    content = b"".join(parts)
                out = []
                for f, block in parse(content):
                    page, segment, total = (f.get(k) for k in ("page-id", "warc-segment-number", "warc-segment-total-length"))
                    digest = f.get("warc-payload-digest", "").rpartition(":")[2] or None
                    out.append((f["warc-record-id"], f["warc-type"], page and int(page), f.get("warc-target-uri"), digest, f.get("warc-refers-to"), f.get("warc-segment-origin-id"), segment and int(segment), total and int(total), http_payload(block) if decoded and segment is None else block))
                    if len(out) == 256:
                        yield _batch(out, names)
                        out = []
                yield _batch(out, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RAW)


_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names)


def payloads(records: DataFrame, decoded: bool = False) -> DataFrame:
    """(record_id, type, page_id, uri, digest, refers_to, payload) of whole records: segments joined, framing decoded.

    decoded: what read_warc was called with. Equal records that occur twice
    give two rows. A record whose segments are missing, or do not add up to the
    total length that the last one states, raises an error.
    """
    names = ["record_id", "type", "page_id", "uri", "digest", "refers_to"]

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.slice(low, 64)
                body = [http_payload(b) for b in part.column("block").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(body, pa.binary())], [*names, "payload"])

    def framed(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(run, "record_id string, type string, page_id long, uri string, digest string, refers_to string, payload binary")

    whole = records.where("segment is null").select(*names, "block")
    # Heads travel with their segments, so that the archives are parsed once for both.
    parts = records.where("segment is not null").withColumn("name", F.coalesce("origin", "record_id"))
    head = F.when(F.col("origin").isNull(), F.struct(*names))
    joined = parts.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("sum"), F.collect_list(head).alias("heads"))
    lost = F.raise_error(F.concat(F.lit("segments of "), F.col("name"), F.lit(" are missing or have another length")))
    right = F.expr("size(parts) = element_at(parts, -1).segment and length(data) = sum")
    joined = joined.withColumn("data", F.expr("aggregate(parts, cast('' as binary), (x, p) -> x || p.block)"))
    joined = joined.select(F.when(F.size("heads") > 0, F.col("heads")).otherwise(lost).alias("heads"), F.when(right, F.col("data")).otherwise(lost).alias("block"))
    first = joined.select(F.explode("heads").alias("head"), "block").select("head.*", "block")
    if decoded:
        return whole.withColumnRenamed("block", "payload").union(framed(first))
    return framed(whole.union(first))


def warc_round_trip(pages: DataFrame, path: str | None = None, least: int = 100, **columns: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of pages.

    A revisit takes its payload's length from the response that it refers to.
    Digests of responses are computed from what was read.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_warc(pages, path, least, **columns)
    read = payloads(read_warc(spark, path, decoded=True), decoded=True)
    read = materialise(read.select("record_id", "type", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("own"), "digest"), "records")
    full = read.where("type = 'response'")
    kept = full.select("page_id", F.col("n").alias("payload_bytes"), F.col("own").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    target = full.where("page_id is not null").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target"), F.col("n").alias("full_n")).distinct()
    again = read.where("type = 'revisit'").select("page_id", "digest", "type", "refers_to").join(target, "refers_to", "left")
    return kept.union(again.select("page_id", "full_n", "digest", "type", "target"))
