"""Query of the quality classifier over `documents` and `labels`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.llm.quality import quality_scores
from plover.session import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _, _, _ = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "evidence", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))


QUERIES = {"op1_quality": op1_quality}
