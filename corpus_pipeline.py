"""The corpus pipeline: five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its rows are written as Parquet and reread as the next one's docs. All
but the last return the columns of `documents`; the last returns the mix, a row
for each drawn copy of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plover.llm.decontamination import contaminated
from plover.llm.mixing import WORD, mix
from plover.llm.near_dedup import near_duplicates
from plover.llm.quality import quality_scores, surface_features, with_score
from plover.llm.secrets import redact, scan_versions
from plover.session import bounded_batches, materialize, table

#: Tables of ids to drop or of findings with at most so many rows are broadcast.
BROADCAST_ROWS = 500_000


def _checked(small: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(_doc, doc_id, text, source, _row, _again) per row, and whether any id repeats or is null.

    ``_doc`` holds the whole row, so that no column of ``docs`` meets one of a
    stage. ``_row`` tells rows of different texts apart: it is the document's
    id; rows without an id, or with one that names several texts, get a hash of
    id and text above 2^62 instead. ``_again`` marks rows whose id repeats or is
    null.
    """
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "text", "source")
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    ids = docs.groupBy(F.col("doc_id").alias("again_id")).agg(F.count(F.lit(1)).alias("rows"), (F.min(text) != F.max(text)).alias("several"))
    again = materialize(ids.filter("rows > 1 or again_id is null").select("again_id", (F.col("several") | F.col("again_id").isNull()).alias("several")), "again")
    doc_id = F.col("doc_id").cast("long")
    if not again.count():
        return rows.withColumns({"_row": doc_id, "_again": F.lit(False)}), False
    # The few ids of irregular rows are sent to the texts, which aren't shuffled.
    met = rows.join(_checked(again), F.col("doc_id").eqNullSafe(F.col("again_id")), "left")
    own = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull()).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    return met.select(*rows.columns, F.when(F.col("several"), own).otherwise(doc_id).alias("_row"), F.col("several").isNotNull().alias("_again")), True


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores under 0.5.

    Null, empty and blank texts score 0 and go. Rows are scored each, so
    repeated ones stay or go together; ties at 0.5 stay. Null ids are documents
    without a label; null sources and languages are sites of their own. Extra
    columns of any name are handed on. Scores are computed beside the text, so
    whole texts aren't shuffled.
    """
    bounded_batches(spark)
    _, model, sites, share = quality_scores(docs, table(spark, sf_dir, "labels"))
    features = F.col("_features")
    rows = docs.select(F.struct("*").alias("_doc"), F.col("source").alias("host"), F.col("lang").alias("path"), surface_features(F.col("text")).alias("_features"))
    return with_score(rows.withColumn("evidence", model.log_odds(features)), sites, share, features[0] > 0).filter("score >= 0.5").select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the least by id, of each group of near-duplicates.

    Of rows that repeat both id and text one stays, the least by its columns;
    rows without an id or of one id with different texts are documents of their
    own, after those with ids of their own. Null and empty texts stay. Extra
    columns of any name are handed on.
    """
    bounded_batches(spark)
    keyed, repeats = _keyed(docs)
    groups = near_duplicates(keyed, id_col="_row")
    gone = materialize(groups.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    rest = keyed.join(_checked(gone), F.col("_row") == F.col("gone_id"), "left_anti")
    if not repeats:
        return rest.select("_doc.*")
    # Only the rows whose id repeats or is null are shuffled.
    same = rest.filter("_again").groupBy("_row", F.sha2("text", 256)).agg(F.min("_doc").alias("_doc"))
    return rest.filter("not _again").select("_doc.*").unionByName(same.select("_doc.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, whatever their ids.

    Null and empty texts stay, and so do all rows if the benchmark is empty;
    rows that repeat a text go or stay together. Extra columns of any name are
    handed on.
    """
    bounded_batches(spark)
    keyed, _ = _keyed(docs)
    found = contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_row")
    gone = materialize(found.select(F.col("id").alias("gone_id")).distinct(), "gone")
    return keyed.join(_checked(gone), F.col("_row") == F.col("gone_id"), "left_anti").select("_doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all rows stay, those without an id too.

    Texts without a secret are as they were; of others ``n_chars`` is counted
    anew. Extra columns of any name are handed on.
    """
    bounded_batches(spark)
    keyed, _ = _keyed(docs)
    findings, _ = scan_versions(keyed, path_col="_row")
    some = findings.filter(F.size("spans") > 0).select(F.col("path").alias("found_id"), "spans").dropDuplicates(["found_id"])
    some = materialize(some, "secrets")
    rows = keyed.join(_checked(some), F.col("_row") == F.col("found_id"), "left")
    rows = rows.withColumn("_text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("spans"))))
    chars = F.when(F.col("spans").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_text").cast("long"))
    return rows.select(*[{"text": F.col("_text"), "n_chars": chars}.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


#: Columns that the mix adds.
MIXED = ("size", "source_size", "target", "copy", "shard", "words", "local_order")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per drawn copy of a document, with the columns of ``MIXED``.

    A copy of which only the first words are drawn is cut after them. Null and
    empty texts have no words and aren't drawn; repeated rows are documents of
    their own, and rows of one id and text are drawn alike. A column of ``docs``
    that is named like one of ``MIXED`` gives way to it.
    """
    keyed, repeats = _keyed(docs)
    if repeats:  # rows that repeat id and text get numbers, so that each is drawn by itself
        turn = F.row_number().over(Window.partitionBy("_row").orderBy("_doc"))
        rest = keyed.filter("_again").withColumn("_row", F.when(turn == 1, F.col("_row")).otherwise(F.xxhash64("_row", turn).bitwiseOR(F.lit(-(2**63)))))
        keyed = materialize(keyed.filter("not _again").unionByName(rest), "rows")
    drawn = mix(keyed, id_col="_row").select("doc_id", "size", "source_size", "target", F.explode("copies").alias("c"))
    drawn = drawn.select(F.col("doc_id").alias("mixed_id"), "size", "source_size", "target", "c.copy", "c.shard", "c.words", "c.local_order")
    rows = keyed.join(drawn, F.col("_row") == F.col("mixed_id"))
    pieces = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int"))
    rows = rows.withColumn("_text", F.when(F.col("words") < F.col("size"), F.array_join(pieces, " ")).otherwise(F.col("text")))
    kept = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[kept.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns if c not in MIXED], *MIXED)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: Models and similarity joins are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the rows that the last one returns."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage{number}")
    return docs
