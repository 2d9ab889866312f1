"""Query of the language identifier over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.llm.language import predict_language, train_language
from plover.llm.toxicity import fold
from plover.session import table


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(fold(F.col(c), 4) == 2, F.lit(False))
    model = train_language(docs.filter(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = predict_language(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
