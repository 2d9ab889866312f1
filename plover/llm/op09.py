"""Query of the WARC operator over `pages`, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.llm.warc import read_warc, write_warc
from plover.session import materialize, scratch_path, table


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = materialize(read_warc(spark, path).drop("payload"), "records")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(\d+|-\d+):", 1).try_cast("long")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    rows = records.select("*", copies.alias("copy")).drop("copy", "copies")
    lengths = records.filter("record_type = 'response'").select(F.col("record_id").alias("response_id"), F.col("payload_bytes").alias("response_bytes")).dropDuplicates(["response_id"])
    met = rows.join(lengths, F.col("refers_to") == F.col("response_id"), "left")
    return met.select(
        page(F.col("record_id")).alias("page_id"), F.coalesce("payload_bytes", "response_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        page(F.col("refers_to")).alias("refers_to"), "whole",
    )


_LETTERS = " || ".join(f"to_base(('0x' || substr(h, {5 * k + 1}, 5))::BIGINT, 32, 4)" for k in range(8))

SQL = f"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
named AS (
    SELECT page_id, payload_bytes,
        translate({_LETTERS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
    FROM hashed),
held AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> holder THEN holder END AS refers_to, true AS whole
FROM held
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": SQL}
