"""Query of the mixing operator over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plover.llm.mixing import mix
from plover.session import table


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op10_mix_sources": op10_mix_sources}
