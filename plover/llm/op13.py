"""Query of the BPE operator over `documents`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plover.llm.bpe import encode_texts
from plover.session import table


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op13_bpe": op13_bpe}
