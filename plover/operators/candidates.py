"""Candidates by name and address: containment of short strings by an index on their rarest part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.operators.joins import checked_broadcast
from plover.session import materialize

#: Characters of an indexed part; shorter names are parts of their own.
PART = 3

#: Written forms that don't tell companies apart (fixed values).
_LEGAL = ("株式会社", "有限会社", "合同会社", "（株）", "(株)", "㈱", "　", " ", "-", "－", "ー")
_WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
_NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def match_key(text: Column) -> Column:
    """A name or address without legal forms, spaces and hyphens, in half width and lower case; '' for null."""
    out = F.translate(F.coalesce(text, F.lit("")), _WIDE, _NARROW)
    for form in _LEGAL:
        out = F.replace(out, F.lit(form), F.lit(""))
    return F.lower(out)


def _parts(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct parts of the given sizes."""

    def runs(size: int) -> Column:
        starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.substring(text, k, F.lit(size)))

    return F.array_distinct(F.flatten(F.array(*map(runs, sizes))))


def contained_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): pairs of distinct strings of which the first is part of the second.

    Each inner string is looked up by its part that fewest outer strings have,
    so the index gives few pairs that aren't contained, and those are dropped.
    Only parts that an inner string has, of the sizes that occur, are indexed,
    and strings too long or too short for the other side are left out. Nulls
    and empty strings match nothing.
    """
    one = inner.select("inner").filter("inner <> ''").distinct()
    two = outer.select("outer").filter("outer <> ''").distinct()
    longest = two.agg(F.max(F.length("outer"))).first()[0] or 0
    one = one.filter(F.length("inner") <= longest)
    lengths = sorted(r[0] for r in one.select(F.least(F.length("inner"), F.lit(PART)).alias("n")).distinct().collect())
    if not lengths:
        return one.select("inner", F.col("inner").alias("outer")).limit(0)
    two = two.filter(F.length("outer") >= lengths[0])
    short = F.length("inner") < PART
    asked = one.select("inner", F.explode(F.when(short, F.array("inner")).otherwise(_parts(F.col("inner"), (PART,)))).alias("part"))
    wanted = checked_broadcast(materialize(asked.select(F.col("part").alias("w_part")).distinct(), "parts"))
    every = two.select("outer", F.explode(_parts(F.col("outer"), lengths)).alias("part")).join(wanted, F.col("part") == F.col("w_part"), "left_semi")
    holders = every.groupBy(F.col("part").alias("h_part")).agg(F.count(F.lit(1)).alias("holders"))
    # A part that no outer string has says that none contains the inner one.
    counted = asked.join(holders, F.col("part") == F.col("h_part"), "left").select("inner", "part", F.coalesce("holders", F.lit(0)).alias("holders"))
    rarest = counted.groupBy("inner").agg(F.min(F.struct("holders", "part")).alias("r")).filter("r.holders > 0").select("inner", F.col("r.part").alias("r_part"))
    return rarest.join(every, F.col("r_part") == F.col("part")).filter(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def address_overlap(job: Column, master: Column) -> Column:
    """1 if one holds the other, else the longest part of 6 to 3 characters of the job's that the master's holds, by the job's length."""

    def has(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(job) - (size - 1), F.lit(1)))
        return F.exists(starts, lambda k: (k + (size - 1) <= F.length(job)) & master.contains(F.substring(job, k, F.lit(size))))

    found = F.when(has(6), 6).when(has(5), 5).when(has(4), 4).when(has(3), 3).otherwise(0)
    share = F.least(found / F.greatest(F.length(job), F.lit(1)), F.lit(1.0))
    return F.when((job == "") | (master == ""), 0.0).when(job.contains(master) | master.contains(job), 1.0).otherwise(share)


def company_candidates(jobs: DataFrame, master: DataFrame, shown: int = 5) -> tuple[DataFrame, DataFrame]:
    """Masters whose names equal a job's, hold it or are held by it: (profile scores, the masters' groups).

    ``jobs`` (key, company, location), ``master`` (number, company, address).
    The name counts 1.0 or 0.82 for three quarters, the address' overlap for
    the rest. Jobs of equal name and place are one profile and masters of equal
    name and place one group, so that copies of either make no pairs. Scores are
    (j_name, j_place, m_name, m_place, rows, first, confidence, name_score,
    address_score); groups (m_name, m_place, rows, first, top) hold their
    ``shown`` smallest numbers.
    """
    asked = job_profiles(jobs).select("j_name", "j_place").distinct()
    right = master.select("number", "company", "address", match_key(F.col("company")).alias("m_name"), match_key(F.col("address")).alias("m_place"))
    order = Window.partitionBy("m_name", "m_place").orderBy("number", "company", "address")
    some = right.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= shown)
    some = some.groupBy("m_name", "m_place").agg(F.array_sort(F.collect_list(F.struct("n", "number", "company", "address"))).alias("top"))
    sizes = right.groupBy(F.col("m_name").alias("s_name"), F.col("m_place").alias("s_place")).agg(F.count(F.lit(1)).alias("rows"))
    groups = some.join(sizes, (F.col("m_name") == F.col("s_name")) & (F.col("m_place") == F.col("s_place"))).select("m_name", "m_place", "rows", F.col("top")[0]["number"].alias("first"), "top")
    groups = materialize(groups, "groups")
    one, two = asked.select(F.col("j_name").alias("inner")), groups.select(F.col("m_name").alias("inner"))
    pairs = contained_pairs(one, two.withColumnRenamed("inner", "outer")).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
    pairs = pairs.unionByName(contained_pairs(two, one.withColumnRenamed("inner", "outer")).select(F.col("outer").alias("a"), F.col("inner").alias("b"))).distinct()
    met = asked.join(pairs, F.col("j_name") == F.col("a")).join(groups.drop("top"), F.col("b") == F.col("m_name"))
    name = F.when(F.col("j_name") == F.col("m_name"), 1.0).otherwise(0.82)
    place = address_overlap(F.col("j_place"), F.col("m_place"))
    scores = met.select("j_name", "j_place", "m_name", "m_place", "rows", "first", F.round(name * 0.75 + place * 0.25, 3).alias("confidence"), name.alias("name_score"), F.round(place, 3).alias("address_score"))
    return scores, groups


def job_profiles(jobs: DataFrame) -> DataFrame:
    """Jobs with the forms of their names and places that are compared."""
    return jobs.withColumns({"j_name": match_key(F.col("company")), "j_place": match_key(F.col("location"))})


def resolve_numbers(jobs: DataFrame, master: DataFrame, least: float = 0.92, margin: float = 0.05, shown: int = 5) -> DataFrame:
    """Per job: status (already_present, estimated, ambiguous, not_found), number, confidence, how many candidates, and the best of them as JSON.

    ``jobs`` also has number, kept if it is of 13 digits. A job's candidates
    are ordered by confidence and then by number.
    """
    known = F.coalesce(F.col("number").cast("string").rlike("^[0-9]{13}$"), F.lit(False))
    kept = max(shown, 2)
    scores, groups = company_candidates(jobs.filter(~known), master, kept)
    found = materialize(scores, "candidates")
    counts = found.groupBy(F.col("j_name").alias("c_name"), F.col("j_place").alias("c_place")).agg(F.sum("rows").alias("candidates"))
    # A group's rows score alike, so the best rows are in the groups that are first by confidence and smallest number;
    # a profile that very many groups meet keeps its best in each task, before they meet.
    order = Window.partitionBy("j_name", "j_place").orderBy(F.desc("confidence"), "first", "m_name", "m_place")
    few = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= kept).drop("n", "rows", "first")
    tops = groups.select(F.col("m_name").alias("t_name"), F.col("m_place").alias("t_place"), "top")
    rows = few.join(tops, (F.col("m_name") == F.col("t_name")) & (F.col("m_place") == F.col("t_place"))).withColumn("m", F.explode("top"))
    rows = rows.select("j_name", "j_place", "m.number", "m.company", "m.address", "confidence", "name_score", "address_score")
    by = Window.partitionBy("j_name", "j_place").orderBy(F.desc("confidence"), "number", "company", "address")
    top = rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= kept)
    entry = F.struct(*[F.col(c) for c in ("number", "company", "address", "confidence", "name_score", "address_score")])
    at = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    best = top.groupBy(F.col("j_name").alias("b_name"), F.col("j_place").alias("b_place")).agg(
        at(1, "number").alias("top"), at(1, "confidence").alias("best"), F.coalesce(at(2, "confidence"), F.lit(0.0)).alias("second"),
        F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.struct("n", entry.alias("c"))))).alias("shown"),
    )
    best = best.join(counts, (F.col("b_name") == F.col("c_name")) & (F.col("b_place") == F.col("c_place")))
    mine = job_profiles(jobs).withColumn("known", known)
    met = mine.join(best, ~F.col("known") & (F.col("j_name") == F.col("b_name")) & (F.col("j_place") == F.col("b_place")), "left")
    sure = (F.col("best") >= least) & (F.round(F.col("best") - F.col("second"), 6) >= margin)
    status = F.when(F.col("known"), "already_present").when(F.col("best").isNull(), "not_found").when(sure, "estimated").otherwise("ambiguous")
    return met.select(
        "key", status.alias("status"), F.when(F.col("known"), F.col("number")).when(status == "estimated", F.col("top").cast("string")).alias("number"),
        F.when(F.col("known"), 1.0).otherwise(F.col("best")).alias("confidence"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.to_json(F.transform("shown", lambda s: s["c"])).alias("shown"),
    )
