"""Query of the embedding near-duplicate operator over `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plover.llm.embedding_dedup import embedding_near_duplicates
from plover.session import table


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_near_dedup": op6_embedding_near_dedup}
