"""WARC archives: writing with segmented records, reading with reassembly.

`write_warc` builds every record with SQL functions and hands them to Spark's
text writer, whose line separator is the end of a WARC record. A payload goes
in an HTTP response with chunked transfer framing; a response longer than
``segment_bytes`` is cut into a first record and continuation records. Equal
payloads are stored once: the page with the largest id is the response, the
others are revisit records that name it.

`read_warc` parses archives file by file, joins the segments of a record by
origin identifier in order of their numbers, verifies the total length, decodes
the chunked framing, and verifies the payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.session import materialize

#: A table of revisits with at most so many rows (about 60 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000
CRLF = "\r\n"
HTTP_HEAD = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""])
RECORD = "record_id string, origin_id string, record_type string, target_uri string, refers_to string, digest string, segment long, total long, block binary"
PAYLOAD = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, whole boolean, copies long"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, with SQL functions: 5 hex digits make 4 letters."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(
    pages: DataFrame,
    path: str,
    chunk_bytes: int = 2048,
    segment_bytes: int = 4096,
    revisit_from: int = 0,
    records_per_file: int = 20_000,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write each page row as a record of gzip archives under ``path``.

    Payloads of ``revisit_from`` bytes or more that equal another's are stored
    once. A null html is the empty payload; a null id is written as ``none``
    and never beats another id. Rows that repeat an id and a payload write
    equal records. Other columns are ignored.
    """
    named = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).cast("binary").alias("payload"))
    named = named.withColumn("digest", base32_sha1(F.col("payload")))
    # Who revisits whom is settled on ids and digests; payloads aren't shuffled for it.
    digests = materialize(named.select("id", "digest", (F.octet_length("payload") >= revisit_from).alias("sharable")), "digests")
    holders = digests.filter("sharable").groupBy(F.col("digest").alias("held")).agg(F.max("id").alias("holder"))
    others = digests.filter("sharable").join(holders, F.col("digest") == F.col("held")).filter(~F.col("id").eqNullSafe(F.col("holder")))
    others = materialize(others.select(F.col("id").alias("other_id"), F.col("digest").alias("other_digest"), "holder").distinct(), "revisits")
    small = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    joined = named.join(small, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("other_digest")), "left")
    stored = F.col("other_digest").isNull()

    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(":"), F.col("digest"))
    n_chunks = F.ceil(F.octet_length("payload") / chunk_bytes).cast("int")
    places = F.filter(F.sequence(F.lit(0), n_chunks), lambda k: k < n_chunks)
    chunk = lambda k: F.substring(F.col("payload"), k * chunk_bytes + 1, F.lit(chunk_bytes))
    framed = F.transform(places, lambda k: F.concat(F.hex(F.octet_length(chunk(k))), F.lit(CRLF), chunk(k).cast("string"), F.lit(CRLF)))
    message = F.concat(F.lit(HTTP_HEAD), F.array_join(framed, ""), F.lit("0" + CRLF + CRLF)).cast("binary")

    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    common = F.concat(line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))))
    angled = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    whole = joined.filter(stored).select("url", "digest", name("id").alias("name"), message.alias("message"))
    whole = whole.withColumn("length", F.octet_length("message")).withColumn("segments", F.ceil(F.col("length") / segment_bytes).cast("int"))
    cut = whole.select("*", F.explode(F.sequence(F.lit(1), F.col("segments"))).alias("segment"))
    cut = cut.withColumn("block", F.substring("message", (F.col("segment") - 1) * segment_bytes + 1, F.lit(segment_bytes)))
    first, last = F.col("segment") == 1, F.col("segment") == F.col("segments")
    number = F.when(F.col("segments") > 1, line("WARC-Segment-Number", F.col("segment").cast("string"))).otherwise("")
    total = F.when(last & ~first, line("WARC-Segment-Total-Length", F.col("length").cast("string"))).otherwise("")
    response = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, angled(F.col("name"))).otherwise(angled(F.concat("name", F.lit(":"), F.col("segment").cast("string"))))),
        common, number, total,
        F.when(first, "").otherwise(line("WARC-Segment-Origin-ID", angled(F.col("name")))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF), F.col("block").cast("string"),
    )
    revisit = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.lit("revisit")), line("WARC-Record-ID", angled(F.concat(name("id"), F.lit(":revisit")))),
        common, line("WARC-Refers-To", angled(name("holder"))),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("Content-Length", F.lit("0")), F.lit(CRLF),
    )
    records = cut.select(response.alias("value")).unionByName(joined.filter(~stored).select(revisit.alias("value")))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive; gzip members may follow one another."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at, unzip = memoryview(content), 0, zlib.decompressobj(31)
    while at < len(view) or unzip.unconsumed_tail:
        fed = unzip.unconsumed_tail or view[at : at + step]
        if not unzip.unconsumed_tail:
            at += len(fed)
        yield unzip.decompress(fed, 4 * step)
        if unzip.eof:
            at -= len(unzip.unused_data)
            unzip = zlib.decompressobj(31)


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of one archive in order; a broken tail ends it."""
    held, source = bytearray(), _inflated(content)

    def upto(n: int) -> bool:
        while len(held) < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while upto(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not upto(len(held) + 1):
                return
            end = held.find(b"\r\n\r\n")
        head = bytes(held[:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        length = int(fields.get("content-length", "0"))
        if not upto(end + 4 + length):
            return
        block = bytes(held[end + 4 : end + 4 + length])
        upto(end + 8 + length)
        del held[: end + 8 + length]
        bare = lambda key: fields[key].strip("<>") if key in fields else None
        number = lambda key: int(fields[key]) if fields.get(key, "").isdigit() else None
        yield {
            "record_id": bare("warc-record-id"), "origin_id": bare("warc-segment-origin-id"), "record_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"), "refers_to": bare("warc-refers-to"),
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "block": block,
        }


def dechunked(body: bytes) -> bytes | None:
    """The data of chunked transfer framing; null if the framing is broken."""
    out, at = bytearray(), 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n > len(body):
            return None
        if n == 0:
            return bytes(out)
        out += body[end + 2 : end + 2 + n]
        at = end + 4 + n


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_schema = lambda ddl: pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(RECORD)
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for record in parse_records(content.as_py()):
                rows.append(record)
                held += len(record["block"])
                if held > 4 << 20 or len(rows) >= 2_000:
                    yield _arrow(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _arrow(rows, schema)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From records with all their segments to verified payloads."""
    schema = _schema(PAYLOAD)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for r in batch.slice(at, 256).to_pylist():
                parts = {p["segment"] or 1: p["block"] for p in r["parts"]}
                whole = sorted(parts) == list(range(1, len(parts) + 1))
                block = b"".join(parts[k] for k in sorted(parts))
                whole = whole and (len(block) == r["total"] if r["total"] is not None else len(parts) == 1)
                payload: bytes | None = None
                if r["record_type"] == "response" and whole:
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if b"transfer-encoding: chunked" in head.lower():
                        payload = dechunked(payload)
                digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if r["record_type"] == "response":
                    whole = payload is not None and r["digest"] in (None, digest)
                rows.append(
                    {k: r[k] for k in ("record_id", "record_type", "target_uri", "refers_to")}
                    | {"payload": payload, "payload_bytes": None if payload is None else len(payload), "payload_digest": digest or r["digest"], "whole": whole}
                    | {"copies": sum(p["segment"] in (None, 1) for p in r["parts"])}
                )
            yield _arrow(rows, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of the archives under ``path``.

    Columns of ``PAYLOAD``. ``whole`` is false, and the payload null, where a
    segment is missing, the total length is wrong, the framing is broken or the
    digest differs. ``copies`` counts the records that a row stands for, more than
    one where segmented records are equal in id.
    Each archive must fit in a task's memory; Spark's binary reader allows up to
    2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    records = files.mapInArrow(_parse, RECORD)
    part = F.struct("segment", "block")
    meta = ["record_type", "target_uri", "refers_to", "digest"]
    kinds = F.col("record_type").isin("response", "revisit", "continuation")
    single = F.col("segment").isNull() & F.col("origin_id").isNull()
    # The records that are whole already needn't be shuffled with their payloads.
    lone = records.filter(kinds & single).select("record_id", *meta, "total", F.array(part).alias("parts"))
    head = F.col("origin_id").isNull()
    cut = records.filter(kinds & ~single).groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(
        *[F.max(F.when(head, F.col(c))).alias(c) for c in meta], F.max("total").alias("total"), F.collect_list(part).alias("parts")
    )
    return lone.unionByName(cut).mapInArrow(_payloads, PAYLOAD)
