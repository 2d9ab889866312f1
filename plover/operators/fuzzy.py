"""Fuzzy name matching: a lossless search for candidates, their ratio, and a margin between companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.functions.unicode import nfkc, sequence_ratio
from plover.operators.candidates import contained_pairs
from plover.operators.joins import best_with_margin, checked_broadcast
from plover.session import materialize


def _tokens(texts: DataFrame, key: str) -> DataFrame:
    """(key, token): each text's characters, numbered by how often they have come before."""
    chars = F.array_sort(F.filter(F.split(key, ""), lambda c: c != ""))
    turns = F.transform("_chars", lambda c, i: F.struct(c.alias("char"), (i + 2 - F.array_position("_chars", c)).alias("turn")))
    return texts.select(key, chars.alias("_chars")).select(key, F.explode(turns).alias("token"))


def _need(key: str, share: float) -> Column:
    """How many characters a text has to share with any other for the ratio."""
    return F.greatest(F.ceil(F.length(key) * share - 1e-9), F.lit(1))


def _long_enough(texts: DataFrame, key: str, others: DataFrame, other: str, share: float) -> DataFrame:
    """Texts that some length among the others' allows."""
    low, high = others.agg(F.min(F.length(other)), F.max(F.length(other))).first()
    n = F.length(key)
    return texts.filter((n * share <= (high or 0) + 1e-9) & (F.lit((low or 0) * share) <= n + 1e-9))


def _sharing(texts: DataFrame, key: str, seen: DataFrame, share: float) -> DataFrame:
    """Texts with enough characters that the other side has at all, so that they have join keys; others are in no pair."""
    known = checked_broadcast(seen.filter("seen > 0").select("token"))
    counts = _tokens(texts, key).join(known, "token").groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    return materialize(counts.filter(F.col("_c") >= _need(key, share)).select(key), "sharing")


def _keys(tokens: DataFrame, seen: DataFrame, key: str, share: float) -> DataFrame:
    """(text, join key): pairs of each text's rarest tokens, and single ones of the shortest texts.

    Texts of lengths m and n with a ratio of ``least`` share at least
    ``least * (m + n) / 2`` characters, and n is at least m * least / (2 - least),
    so ``need`` = m * least / (2 - least) of them. In one order of all tokens,
    any two then share two among the first m - need + 2 of both, if both need
    two; texts that need one, and those near enough in length to meet such, have
    single tokens as keys too. Tokens that only one side has come first and make
    no keys.
    """
    ranked = tokens.join(checked_broadcast(seen), "token").withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("seen", "token")))
    first = ranked.filter((F.col("at") <= F.length(key) - _need(key, share) + 2) & (F.col("seen") > 0))
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("t"))  # as long as the text at most
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x["token"].alias("a"), y["token"].alias("b")))))
    single = F.transform("t", lambda x: F.struct(x["token"].alias("a"), F.lit(None).cast(tokens.schema["token"].dataType).alias("b")))
    short = F.length(key) <= 1 / share**2
    return lists.select(key, F.explode(F.when(short, F.concat(single, pairs)).otherwise(pairs)).alias("join_key"))


def near_pairs(one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """(name, alias): all pairs of distinct texts that can have a ratio of ``least``, and some more.

    ``one`` has name, ``two`` alias, neither null nor empty. Tokens are ordered
    by the pairs that they would make. Texts whose length or characters meet no
    text of the other side leave before they are cut into keys.
    """
    share = least / (2 - least)
    one, two = _long_enough(one, "name", two, "alias", share), _long_enough(two, "alias", one, "name", share)
    sides = [_tokens(x, key).select("token", F.lit(k).alias("side")) for k, (x, key) in enumerate(((one, "name"), (two, "alias")))]
    seen = sides[0].unionByName(sides[1]).groupBy("token").agg((F.count_if(F.col("side") == 0) * F.count_if(F.col("side") == 1)).alias("seen"))
    seen = materialize(seen, "tokens")
    keys = [_keys(_tokens(_sharing(x, key, seen, share), key), seen, key, share) for x, key in ((one, "name"), (two, "alias"))]
    left, right = keys[0], keys[1].withColumnRenamed("join_key", "other_key")
    same = F.col("join_key.a").eqNullSafe(F.col("other_key.a")) & F.col("join_key.b").eqNullSafe(F.col("other_key.b"))
    low, high = F.length("name") * share, F.length("name") * ((2 - least) / least)
    return left.join(right, same & F.length("alias").between(F.floor(low), F.ceil(high))).select("name", "alias").distinct()


def fuzzy_match(names: DataFrame, aliases: DataFrame, least: float = 0.75, margin: float = 0.10) -> DataFrame:
    """Per name (key, name) its company among aliases (company, alias): matched, ambiguous or not_found.

    All pairs with a ratio of ``least - margin``, which may make a match
    ambiguous, or where one contains the other are compared: the former share
    two of their rarest characters, the latter are found by the rarest part of
    the shorter. Names that meet nothing, null and empty ones
    are not_found with a score of 0. A containment counts 0.94 at least. The
    margin is to the next company, so two aliases of one company aren't
    ambiguous.
    """
    floor = least - margin
    left = materialize(names.select("key", F.lower(nfkc(F.col("name"))).alias("name")), "names")
    right = materialize(aliases.select("company", F.lower(nfkc(F.col("alias"))).alias("alias")).filter("alias <> ''"), "aliases")
    one, two = materialize(left.select("name").filter("name <> ''").distinct(), "names"), materialize(right.select("alias").distinct(), "aliases")
    near = near_pairs(one, two, floor)
    inner, outer = one.select(F.col("name").alias("inner")), two.select(F.col("alias").alias("outer"))
    held = contained_pairs(inner, outer).select(F.col("inner").alias("name"), F.col("outer").alias("alias"))
    holds = contained_pairs(outer.withColumnRenamed("outer", "inner"), inner.withColumnRenamed("inner", "outer")).select(F.col("outer").alias("name"), F.col("inner").alias("alias"))
    pairs = near.unionByName(held).unionByName(holds).distinct()
    inside = F.col("name").contains(F.col("alias")) | F.col("alias").contains(F.col("name"))
    scored = pairs.withColumn("ratio", sequence_ratio(F.col("name"), F.col("alias")))
    scored = scored.withColumn("score", F.when(F.col("name") == F.col("alias"), 1.0).when(inside, F.greatest(F.col("ratio"), F.lit(0.94))).otherwise(F.col("ratio")))
    found = left.join(scored.filter(F.col("score") >= floor - 1e-9), "name").join(right, "alias").select("key", "company", "score")
    best = best_with_margin(found, "key", "company", "score", least, margin)
    return left.select(F.col("key").alias("_key")).distinct().join(best, F.col("_key").eqNullSafe(F.col("key")), "left").select(
        F.col("_key").alias("key"), F.coalesce("match_status", F.lit("not_found")).alias("match_status"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"), F.coalesce("second_score", F.lit(0.0)).alias("second_score"), "company"
    )
