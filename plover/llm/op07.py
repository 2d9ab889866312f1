"""Query of the benchmark decontamination over `documents` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.llm.decontamination import contaminated
from plover.session import table


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "cosine", "common", "answered")


QUERIES = {"op7_benchmark_leaks": op7_benchmark_leaks}
