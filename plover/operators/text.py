"""Text: character n-grams, sparse cosine, novelty, keyword scores and classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.operators.joins import checked_broadcast
from plover.session import materialize


#: Texts whose n-grams are counted in one partition, on average at most.
TEXTS = 20_000


def char_grams(df: DataFrame, key: str, text: Column, n: int = 3) -> DataFrame:
    """(key, gram, cnt): counts of the n-grams of the text without white space, in lower case."""
    chars = F.filter(F.split(F.regexp_replace(F.lower(text), r"\s", ""), ""), lambda c: c != "")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_c") - (n - 1), F.lit(1))), lambda k: k <= F.size("_c") - (n - 1))
    # From an array of characters, so that a long text costs its length and not its square.
    grams = F.transform(starts, lambda k: F.concat(*[F.element_at("_c", k + j) for j in range(n)]))
    # A small file of many short texts is one split: they are dealt by key first, so its n-grams don't all meet in
    # one task, and what is grouped by key and n-gram stays where it is. More texts are more partitions, so a task's
    # counts don't grow with the table.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TEXTS))
    return df.select(key, chars.alias("_c")).repartition(parts, key).select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("cnt"))


def cosine_pairs(grams: DataFrame, pairs: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """Adds the cosine of both keys' n-gram counts to given pairs.

    The pairs choose what is compared; no pair is made here. All joins are
    merges: n-grams are many more than the bytes of a small file of texts
    suggest, and a broadcast of them would pass through the driver.
    """
    merged = lambda df: df.hint("merge")
    norms = grams.groupBy(key).agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("norm"))
    a = grams.select(F.col(key).alias(one), "gram", F.col("cnt").alias("ca"))
    b = grams.select(F.col(key).alias(two), "gram", F.col("cnt").alias("cb"))
    dots = pairs.join(merged(a), one).join(merged(b), [two, "gram"]).groupBy(one, two).agg(F.sum(F.col("ca") * F.col("cb")).alias("dot"))
    met = pairs.join(merged(dots), [one, two], "left")
    met = met.join(merged(norms.select(F.col(key).alias(one), F.col("norm").alias("na"))), one, "left").join(merged(norms.select(F.col(key).alias(two), F.col("norm").alias("nb"))), two, "left")
    return met.withColumn("cosine", F.coalesce(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), F.lit(0.0))).drop("dot", "na", "nb")


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that the text holds."""
    return F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in terms]))


def keyword_score(text: Column, groups: dict[str, tuple[Sequence[str], float, float]]) -> Column:
    """Sum over groups of points per term that occurs, each group capped."""
    total = F.lit(0.0)
    for terms, points, cap in groups.values():
        total = total + F.least(F.lit(cap), F.size(term_hits(text, terms)) * F.lit(points))
    return total


def rule_labels(text: Column, rules: dict[str, str], veto: str | None = None) -> Column:
    """Names of the patterns that match, none where the veto matches."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in rules.items()]))
    return found if veto is None else F.when(text.rlike(veto), F.slice(found, 1, 0)).otherwise(found)


def inverted_to_text(df: DataFrame, key: str, index: str) -> DataFrame:
    """Text from a map of word to positions."""
    words = df.select(key, F.explode(index).alias("word", "at")).select(key, "word", F.explode("at").alias("at"))
    return words.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))


def weighted_classes(df: DataFrame, key: str, text: Column, classes: DataFrame, top: int = 3, most: int = 3) -> DataFrame:
    """The best classes per row by weighted keyword counts, with their share of all points.

    ``classes`` (class, keyword, weight) is a small dimension; each keyword
    counts at most ``most`` times.
    """
    rows = df.select(key, F.lower(text).alias("_t")).join(checked_broadcast(classes), F.col("_t").contains(F.col("keyword")))
    count = F.least(F.lit(most), F.floor((F.length("_t") - F.length(F.replace(F.col("_t"), F.col("keyword"), F.lit("")))) / F.length("keyword")).cast("int"))
    points = rows.groupBy(key, "class").agg(F.sum(F.col("weight") * count).alias("points"))
    order = Window.partitionBy(key).orderBy(F.col("points").desc(), "class")
    every = Window.partitionBy(key)
    ranked = points.withColumn("place", F.row_number().over(order)).withColumn("share", F.col("points") / F.sum("points").over(every))
    return ranked.filter(F.col("place") <= top)


def ordered_distinct(items: Column) -> Column:
    """Distinct items in order of first occurrence."""
    return F.array_distinct(items)


def diverse_pick(candidates: DataFrame, by: str, count: int, same: float = 0.6) -> DataFrame:
    """Up to ``count`` rows per group, picked greedily by score and then doc_id from all of the group's candidates.

    A candidate whose title shares ``same`` of the smaller word set with a
    picked one is the same event and is passed over. Rows of a domain that is
    new come first, then the others in order. Each pick is one pass that takes
    the best candidate that the picks so far allow, so no list of candidates
    gathers in a task. A group whose first ``HEAD`` candidates give all picks
    from new domains is done with these, because later ones can't come before;
    only the other groups' passes are over all candidates. Word sets are read
    where the domain alone doesn't decide and are never sorted. Needs by,
    doc_id, score, domain and title; adds place.
    """
    words = F.array_distinct(F.filter(F.split(F.coalesce("title", F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
    order = F.struct(F.col("score").isNull().alias("unscored"), (-F.col("score")).alias("less"), "doc_id", F.coalesce("domain", F.lit("")).alias("domain"))
    rows = materialize(candidates.filter(F.col(by).isNotNull()).select(by, order.alias("c"), words.alias("words")), "candidates")
    first = rows.select(by, "c").withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("c"))).filter(F.col("_n") <= HEAD).groupBy(by).agg(F.max("c").alias("_last"))
    bounds = materialize(first.withColumnRenamed(by, "_by"), "bounds")
    head = rows.join(checked_broadcast(bounds), F.col(by) == F.col("_by")).filter("c <= _last").select(by, "c", "words")
    quick = _picks(materialize(head, "head"), by, count, same, (True,))
    done = materialize(quick.filter(F.col("place") == count).select(F.col(by).alias("_by")), "done")
    left = rows.join(checked_broadcast(done), F.col(by) == F.col("_by"), "left_anti")
    picks = quick.join(checked_broadcast(done), F.col(by) == F.col("_by"), "left_semi").unionByName(_picks(left, by, count, same, (True, False)))
    return picks.select(by, "place", "c.doc_id")


#: Candidates of a group that are tried before all are.
HEAD = 500


def _picks(rows: DataFrame, by: str, count: int, same: float, phases: tuple[bool, ...]) -> DataFrame:
    """(by, place, c, words): a pass for each pick of `diverse_pick`; phases are True for new domains only."""
    picks = materialize(rows.select(by, F.lit(0).alias("place"), "c", "words").limit(0), "picks")

    def event(p: Column) -> Column:
        shared = F.size(F.array_intersect("words", p["words"]))
        return (p["c"]["doc_id"] == F.col("c.doc_id")) | ((shared > 0) & (shared >= same * F.least(F.size("words"), F.size(p["words"]))))

    for fresh in phases:
        for _ in range(count):
            lists = picks.groupBy(F.col(by).alias("_by")).agg(F.collect_list(F.struct("c", "words")).alias("_picks"))  # ``count`` entries at most
            left = rows.join(checked_broadcast(lists), F.col(by) == F.col("_by"), "left").withColumn("_n", F.coalesce(F.size("_picks"), F.lit(0))).withColumn("_n", F.greatest("_n", F.lit(0)))
            if fresh:  # cheap, so it is asked first
                known = F.exists("_picks", lambda p: p["c"]["domain"] == F.col("c.domain"))
                left = left.filter(~F.coalesce(known, F.lit(False)))
            taken = F.exists("_picks", event)
            best = left.filter(F.col("_n") < count).filter(~F.coalesce(taken, F.lit(False))).groupBy(by).agg((F.max("_n") + 1).alias("place"), F.min("c").alias("c"))
            best = materialize(best, "best")
            if not best.limit(1).count():
                break
            found = best.select(F.col(by).alias("_by"), "place", F.col("c").alias("_c"))
            whole = rows.join(checked_broadcast(found), (F.col(by) == F.col("_by")) & (F.col("c") == F.col("_c"))).groupBy(by, "place", "c").agg(F.min("words").alias("words"))
            picks = materialize(picks.unionByName(materialize(whole, "picked")), "picks")
    return picks
