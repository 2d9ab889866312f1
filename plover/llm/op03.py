"""Query of the MinHash near-duplicate operator over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plover.llm.near_dedup import near_duplicates
from plover.session import table


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
