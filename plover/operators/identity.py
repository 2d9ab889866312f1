"""Identity of records that several sources describe: a cascade of keys, closed transitively.

Records of one source key, one DOI or one arXiv number are the same paper, and
so are chains of them. Title and first author decide only for a record without
either number: it joins the first record of that title and author before it.
Each key ties its records to the first of them, so a key of any size gives one
edge a record and no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.operators.components import connected_components


def normalized_title(text: Column) -> Column:
    """Words of letters, digits and underscores in lower case, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def normalized_doi(text: Column) -> Column:
    """Without a resolver's address or prefix, in lower case; '' if none."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def normalized_arxiv(text: Column) -> Column:
    """Without address, prefix and version; '' if none."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"^(https?://arxiv\.org/(abs|pdf)/|arxiv:\s*)", ""), r"(v\d+)?(\.pdf)?$", "")


def _keyed(records: DataFrame) -> DataFrame:
    return records.select(
        "rec", F.when(F.col("source").isNotNull() & F.col("source_id").isNotNull(), F.concat_ws("\x1f", F.lit("s"), "source", "source_id")).alias("k_source"),
        F.when(normalized_doi(F.col("doi")) != "", F.concat(F.lit("d\x1f"), normalized_doi(F.col("doi")))).alias("k_doi"),
        F.when(normalized_arxiv(F.col("arxiv")) != "", F.concat(F.lit("a\x1f"), normalized_arxiv(F.col("arxiv")))).alias("k_arxiv"),
        F.when(normalized_title(F.col("author")) != "", F.concat_ws("\x1f", F.lit("t"), normalized_title(F.col("title")), normalized_title(F.col("author")))).alias("k_title"),
    )


def _firsts(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(F.col("key").alias("f_key")).agg(F.min("rec").alias("first"))


def identity_edges(records: DataFrame) -> DataFrame:
    """(a, b): each record and the first one of each of its keys, where that is another."""
    keys = _keyed(records)
    numbers = keys.select("rec", F.explode(F.array_compact(F.array("k_source", "k_doi", "k_arxiv"))).alias("key"))
    titles = keys.filter("k_title is not null").select("rec", F.col("k_title").alias("key"), (F.col("k_doi").isNull() & F.col("k_arxiv").isNull()).alias("bare"))
    tied = numbers.join(_firsts(numbers), F.col("key") == F.col("f_key")).unionByName(titles.join(_firsts(titles), F.col("key") == F.col("f_key")).filter("bare").drop("bare"))
    return tied.filter("first < rec").select(F.col("rec").alias("a"), F.col("first").alias("b"))


def resolve_identities(records: DataFrame) -> DataFrame:
    """Adds ``root``, the first record of the same paper.

    ``records`` (rec, source, source_id, doi, arxiv, title, author); ``rec``
    is a unique long that gives the order of arrival.
    """
    parts = connected_components(identity_edges(records)).select(F.col("node").alias("p_rec"), "component")
    return records.join(parts, F.col("rec") == F.col("p_rec"), "left").drop("p_rec").withColumn("root", F.coalesce("component", "rec")).drop("component")


def merge_papers(resolved: DataFrame) -> DataFrame:
    """One row per paper: title, author and id of its first record, the first number or journal given, the longest abstract, the last update.

    Also needs abstract, journal and updated_at. Of abstracts equally long the
    first counts.
    """
    first_given = lambda c: F.coalesce(F.min(F.when(F.coalesce(c, F.lit("")) != "", F.struct("rec", c.alias("v"))))["v"], F.lit(""))
    length = F.length(F.coalesce("abstract", F.lit("")))
    merged = resolved.groupBy("root").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("source", "source_id").alias("source_records"), first_given(normalized_doi(F.col("doi"))).alias("doi"),
        first_given(normalized_arxiv(F.col("arxiv"))).alias("arxiv"), F.min(F.struct("rec", "title", "author", "doi", "arxiv")).alias("f"),
        F.max(F.struct(length.alias("n"), (-F.col("rec")).alias("r"), "abstract"))["abstract"].alias("abstract"), first_given(F.col("journal")).alias("journal"), F.max("updated_at").alias("updated_at"),
    )
    doi, arxiv = normalized_doi(F.col("f.doi")), normalized_arxiv(F.col("f.arxiv"))
    name = F.concat_ws("|", normalized_title(F.col("f.title")), normalized_title(F.col("f.author")))
    paper = F.when(doi != "", F.concat(F.lit("doi:"), doi)).when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).otherwise(F.concat(F.lit("paper:"), F.substring(F.sha2(name, 256), 1, 32)))
    return merged.select("root", paper.alias("paper_id"), "records", "source_records", "doi", "arxiv", F.col("f.title").alias("title"), F.col("f.author").alias("author"), "abstract", "journal", "updated_at")
