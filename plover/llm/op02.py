"""Query of the toxicity model over `documents` and `labels`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.llm.toxicity import fold, score_toxicity, train_toxicity
from plover.session import table


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter("toxic is not null").filter(fold(F.col("doc_id"), 5) != 0)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    model = train_toxicity(docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "label"))
    scores = score_toxicity(docs, model)
    held_out = fold(F.col("id"), 5) == 0
    return scores.select(F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
