"""Query of the license scan over `documents`.

`documents` has no paths. The query lays it out as a tree of sources, languages
and folders of a hundred ids; the first document of each hundred is its
folder's LICENSE file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.llm.licenses import license_scan
from plover.session import table


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    block = lambda n: F.coalesce(F.floor(F.col("doc_id") / n).cast("string"), F.lit("none"))
    file = F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("LICENSE."), name)).otherwise(F.concat(name, F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), block(1000), block(100), file)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan(files, keep=("doc_id",)).select("doc_id", "path", "license", "similarity", "inherited_from")


QUERIES = {"op4_license_scan": op4_license_scan}
