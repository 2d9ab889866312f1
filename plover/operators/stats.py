"""Ranks, normalised scores, correlations, classification measures and corrections."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.operators import ranks
from plover.operators.joins import band_join, checked_broadcast
from plover.operators.quantiles import quantiles
from plover.session import materialize


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1, ties sharing their mean rank."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def pearson(x: Column, y: Column) -> Column:
    """Correlation from moments; null if either side is constant."""
    n, sx, sy = F.count(x), F.sum(x), F.sum(y)
    top = n * F.sum(x * y) - sx * sy
    bottom = F.sqrt(F.greatest(n * F.sum(x * x) - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * F.sum(y * y) - sy * sy, F.lit(0.0)))
    return F.try_divide(top, F.when(bottom > 1e-9, bottom))


def _value_ranks(known: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Adds the average rank of ``value`` within ``by``, from counts per distinct value."""
    counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = ranks.running(counts, [*by, value], {"_upto": F.col("_n")})
    first = upto.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"))
    on = lambda prefix: [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by]
    placed = upto.join(first, on("_g_")).select(*[F.col(c).alias(f"_v_{c}") for c in by], F.col(value).alias("_v"), (F.col("_upto") - F.col("_start") - (F.col("_n") - 1) / 2).alias(out))
    return known.join(placed, [*on("_v_"), F.col(value) == F.col("_v")]).drop("_v", *[f"_v_{c}" for c in by])


def correlations(long: DataFrame, by: Sequence[str], least: int = 20) -> DataFrame:
    """Pearson and Spearman of x and y per group with ``least`` complete rows and two values each.

    Ranks come from counts per distinct value, so a group of any size is spread over all tasks.
    """
    known = long.filter("x is not null and y is not null")
    ranked = _value_ranks(_value_ranks(known, "x", by, "rx"), "y", by, "ry")
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), pearson(F.col("x"), F.col("y")).alias("pearson"), pearson(F.col("rx"), F.col("ry")).alias("spearman"))
    return out.filter((F.col("n") >= least) & (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))).drop("_x0", "_x1", "_y0", "_y1")


def growing_spearman(df: DataFrame, features: Sequence[str], target: str, time: str, cuts: Sequence[int]) -> dict[tuple[str, int], float]:
    """Spearman of each feature and the target among the rows whose ``time`` is under each cut, by (feature, cut).

    A feature lacks an entry where fewer than two complete rows or values are
    known. All cuts are taken together: a value has a count and a rank for each
    of them. Rows are dealt by ranges of the target once, and those of equal
    target are summed up there, so no rows meet their ranks in a shuffle.
    Ranks are taken from their mean.
    """
    x, y, before = [F.col(c).cast("double") for c in features], F.col(target).cast("double"), [F.col(time) < c for c in cuts]
    at = [(f, k) for f in range(len(features)) for k in range(len(cuts))]
    rows = df.select(F.col(time), *[v.alias(f"_x{f}") for f, v in enumerate(x)], y.alias("_y")).filter("_y is not null")
    rank = lambda upto, n, total: F.col(upto) - (F.col(n) - 1) / 2 - (total + 1) / 2

    long = rows.select(F.col(time), F.expr(f"stack({len(features)}, {', '.join(f'{f}, _x{f}' for f in range(len(features)))}) as (_f, _x)")).filter("_x is not null")
    counts = long.groupBy("_f", "_x").agg(*[F.count_if(b).alias(f"_n{k}") for k, b in enumerate(before)])
    values = materialize(ranks.running(counts, ["_f", "_x"], {f"_u{k}": F.col(f"_n{k}") for k in range(len(cuts))}), "values")
    ends = {r["_f"]: r for r in values.groupBy("_f").agg(*[F.sum(f"_n{k}").alias(f"n{k}") for k in range(len(cuts))], *[F.min(F.col(f"_u{k}") - F.col(f"_n{k}")).alias(f"s{k}") for k in range(len(cuts))]).collect()}
    if not ends:
        return {}

    placed, spread = [], {}
    for f in ends:
        mine = values.filter(F.col("_f") == f).select(F.col("_x").alias(f"_v{f}"), *[(rank(f"_u{k}", f"_n{k}", F.lit(ends[f][f"n{k}"])) - ends[f][f"s{k}"]).alias(f"_r{f}_{k}") for k in range(len(cuts))], *[F.col(f"_n{k}").alias(f"_m{k}") for k in range(len(cuts))])
        squares = mine.agg(*[F.sum(F.col(f"_m{k}") * F.col(f"_r{f}_{k}") * F.col(f"_r{f}_{k}")) for k in range(len(cuts))]).first()
        spread |= {(f, k): v for k, v in enumerate(squares)}
        placed.append((f, checked_broadcast(mine.drop(*[f"_m{k}" for k in range(len(cuts))]))))
    at = [(f, k) for f, k in at if f in ends]

    def dealt(parts: DataFrame) -> DataFrame:
        for f, ranked in placed:
            parts = parts.join(ranked, F.col(f"_x{f}") == F.col(f"_v{f}"), "left")
        known = lambda f, k: before[k] & F.col(f"_x{f}").isNotNull()
        sums = [F.sum(F.when(known(f, k), F.col(f"_r{f}_{k}")).otherwise(0.0)).alias(f"_s{f}_{k}") for f, k in at]
        return parts.groupBy("_r_part", "_y").agg(*[F.count_if(known(f, k)).alias(f"_n{f}_{k}") for f, k in at], *sums)

    upto = ranks.running(rows, ["_y"], {f"_u{f}_{k}": F.col(f"_n{f}_{k}") for f, k in at}, dealt=dealt)
    ry = {(f, k): rank(f"_u{f}_{k}", f"_n{f}_{k}", F.lit(ends[f][f"n{k}"])) for f, k in at}
    row = upto.agg(*[F.sum(F.col(f"_s{f}_{k}") * ry[f, k]) for f, k in at], *[F.sum(F.col(f"_n{f}_{k}") * ry[f, k] * ry[f, k]) for f, k in at]).first()
    found = zip(at, row[: len(at)], row[len(at) :], strict=True)
    return {(features[f], cuts[k]): both / math.sqrt(spread[f, k] * own) for (f, k), both, own in found if spread[f, k] and own}


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero of the scaled double, as SQL engines round; Spark's ``round`` takes the shortest decimal instead, which differs at ties."""
    return F.round(value * 10.0**digits) / 10.0**digits


def robust_scores(df: DataFrame, scores: dict[str, str], where: Column) -> DataFrame:
    """For each value column a score of 0 to 100 between the 5th and 95th percentile of the chosen rows.

    It is 50 if these don't differ or are fewer than two; other rows get null.
    The percentiles are selected over all tasks and joined as one row.
    """
    chosen = df.select(*[F.when(where, F.col(v)).alias(v) for v in scores])
    bounds = quantiles(chosen, list(scores), (0.05, 0.95))
    met = df.crossJoin(F.broadcast(bounds.select(*[F.col(f"{k}_{v}").alias(f"_{k}_{v}") for v in scores for k in "nq"])))
    for v, out in scores.items():
        low, high = F.col(f"_q_{v}")[0], F.col(f"_q_{v}")[1]
        scaled = F.try_divide(F.col(v) - low, high - low) * 100
        flat = (F.col(f"_n_{v}") < 2) | (high == low)
        met = met.withColumn(out, F.when(where & F.col(v).isNotNull(), F.when(flat, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled)))))
    return met.drop(*[f"_{k}_{v}" for v in scores for k in "nq"])


def weighted_score(df: DataFrame, weights: dict[str, float], least: int) -> DataFrame:
    """Weighted mean of the components at hand, weights renormalised.

    Adds total_score, score_status (ok, partial, insufficient_data) and
    missing_fields.
    """
    known = [F.col(c).isNotNull().cast("int") for c in weights]
    count = sum(known[1:], known[0])
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    # Weights are added as decimals: in doubles 0.3 + 0.4 + 0.2 + 0.1 isn't 1.
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(Decimal(str(w)))).otherwise(F.lit(Decimal(0))) for c, w in weights.items()), F.lit(Decimal(0))).cast("double")
    enough = (count >= least) & (weight > 0)
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in weights])), ",")
    return (
        df.withColumn("total_score", F.when(enough, total / weight))
        .withColumn("score_status", F.when(~enough, "insufficient_data").when(missing == "", "ok").otherwise("partial"))
        .withColumn("missing_fields", missing)
    )


def quantile_bin(df: DataFrame, value: str, bins: int, tie: str, out: str = "bin") -> DataFrame:
    """Adds 1 to ``bins`` by rank; equal values are ranked by ``tie``."""
    numbered = ranks.with_totals(ranks.row_number(df, [value, tie], "_k"), F.count(F.lit(1)).alias("_n"), of=df)
    return numbered.withColumn(out, F.ceil(F.col("_k") * F.lit(bins) / F.col("_n"))).drop("_k", "_n")


def _placed(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: positives, negatives, and how many of each score less, ties counting half."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    groups = ranks.by_value(known, score, {"p": (F.col(label) == 1).cast("long"), "q": (F.col(label) == 0).cast("long")})
    return groups.select("p", "q", (F.col("below_p") + F.col("p") / 2).alias("p_less"), (F.col("below_q") + F.col("q") / 2).alias("q_less"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties counting half; one row per distinct score is ranked."""
    good, bad = F.sum("p"), F.sum("q")
    return _placed(df, score, label).agg(good.alias("positives"), bad.alias("negatives"), F.try_divide(F.sum(F.col("p") * F.col("q_less")), good * bad).alias("auc"))


def delong(df: DataFrame, score: str, label: str) -> DataFrame:
    """AUC with the DeLong variance from the placements of both classes."""
    m, k = F.sum("p"), F.sum("q")
    sums = _placed(df, score, label).agg(
        m.alias("m"), k.alias("k"), F.sum(F.col("p") * F.col("q_less")).alias("a1"), F.sum(F.col("p") * F.col("q_less") * F.col("q_less")).alias("a2"),
        F.sum(F.col("q") * F.col("p_less")).alias("b1"), F.sum(F.col("q") * F.col("p_less") * F.col("p_less")).alias("b2"),
    )
    spread = lambda n, one, two, other: F.try_divide(F.col(two) - F.col(one) * F.col(one) / F.col(n), (F.col(n) - 1) * F.col(other) * F.col(other)) / F.col(n)
    variance = spread("m", "a1", "a2", "k") + spread("k", "b1", "b2", "m")
    return sums.select(F.try_divide(F.col("a1"), F.col("m") * F.col("k")).alias("auc"), variance.alias("variance"), F.sqrt(variance).alias("std_error"))


def average_precision(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """Mean precision at each positive, by descending score and then ``tie``."""
    numbered = ranks.running(df, [F.col(score).desc(), F.col(tie)], {"_n": F.lit(1).cast("long"), "_hits": F.col(label).cast("long")})
    return numbered.agg(F.avg(F.when(F.col(label) == 1, F.col("_hits") / F.col("_n"))).alias("average_precision"))


def lift_at(df: DataFrame, score: str, label: str, tie: str, shares: Sequence[float]) -> DataFrame:
    """Precision, capture and lift among the top shares of rows."""
    numbered = ranks.row_number(df, [F.col(score).desc(), F.col(tie)], "_n")
    numbered = ranks.with_totals(numbered, F.count(F.lit(1)).alias("_rows"), F.avg(label).alias("_base"), F.sum(label).alias("_all"), of=df)
    cut = numbered.withColumn("top_share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).filter(F.col("_n") <= F.ceil(F.col("_rows") * F.col("top_share")))
    return cut.groupBy("top_share").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("precision"), F.try_divide(F.avg(label), F.max("_base")).alias("lift"), F.try_divide(F.sum(label).cast("double"), F.max("_all")).alias("capture"))


def drivers(df: DataFrame, features: Sequence[str], label: str, least_rows: int = 50, least_values: int = 5) -> DataFrame:
    """Per feature: AUC, the label's rate below the 20th and above the 80th percentile, and their difference."""
    out = None
    for c in features:
        rows = df.filter(F.col(c).isNotNull() & F.col(label).isNotNull()).select(F.col(c).cast("double").alias("v"), F.col(label).alias("y"))
        cut = rows.crossJoin(F.broadcast(quantiles(rows, ["v"], (0.2, 0.8)).select(F.col("q_v").alias("c"))))
        rates = cut.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("values"), F.avg(F.when(F.col("v") <= F.col("c")[0], F.col("y"))).alias("bottom_rate"), F.avg(F.when(F.col("v") >= F.col("c")[1], F.col("y"))).alias("top_rate"))
        one = auc(rows, "v", "y").select("auc").crossJoin(rates).select(F.lit(c).alias("feature"), "n", "values", "auc", "bottom_rate", "top_rate", (F.col("top_rate") - F.col("bottom_rate")).alias("difference"))
        out = one if out is None else out.unionByName(one)
    return out.filter((F.col("n") >= least_rows) & (F.col("values") >= least_values)).drop("values")


def holm_adjusted(df: DataFrame, p: str, tie: str) -> DataFrame:
    """Adds p_holm: the running maximum of the scaled p-values in ascending order."""
    numbered = ranks.with_totals(ranks.row_number(df, [p, tie], "_k"), F.count(F.lit(1)).alias("_m"), of=df)
    scaled = numbered.withColumn("_s", F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_k") + 1))).drop("_k", "_m")
    return ranks.running(scaled, [p, tie], maxes={"p_holm": F.col("_s")}).drop("_s")


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, by the Abramowitz and Stegun formula 7.1.26 (error under 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * x)
    series = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    erf = 1 - series * F.exp(-x * x)
    return (1 + F.signum(z) * erf) / 2


def poisson_draws(clusters: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """Each row once a replicate that draws its cluster, with the number of draws as ``_w``.

    Weights follow a Poisson law of mean one by inverting its distribution at a
    hash of cluster and replicate, so reruns agree and no data are collected.
    """
    draws = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), cluster, "replicate"), 11) * 2.0**-53
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum(((u >= c).cast("int") for c in cuts[1:]), (u >= cuts[0]).cast("int"))
    return draws.withColumn("_w", weight).filter("_w > 0")


def bootstrap_means(groups: DataFrame, cluster: str, total: str, n: str, replicates: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Cluster bootstrap of a mean: one row per replicate and group of ``by``.

    ``groups`` has a row per cluster (and group), with its total and count.
    """
    weighted = poisson_draws(groups, cluster, replicates, seed)
    return weighted.groupBy(*by, "replicate").agg(F.try_divide(F.sum(F.col(total) * F.col("_w")), F.sum(F.col(n) * F.col("_w"))).alias("mean"))


def bootstrap_medians(rows: DataFrame, cluster: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Cluster bootstrap of the median of all rows: (replicate, median).

    Rows are counted by cluster and value first; a replicate's median is found
    among running counts of its values, dealt by ranges, so none gathers in a task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("_cluster"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    drawn = poisson_draws(counts, "_cluster", replicates, seed).groupBy("replicate", "_v").agg(F.sum(F.col("_c") * F.col("_w")).alias("_n"))
    upto = ranks.running(drawn, ["replicate", "_v"], {"_upto": F.col("_n")})
    ends = upto.groupBy(F.col("replicate").alias("_r")).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_all"))
    placed = upto.join(ends, F.col("replicate") == F.col("_r")).withColumn("_at", F.col("_upto") - F.col("_start"))
    at = lambda rank: F.min(F.when(F.col("_at") > rank, F.col("_v")))
    return placed.groupBy("replicate").agg(((at(F.floor((F.col("_all") - 1) / 2)) + at(F.ceil((F.col("_all") - 1) / 2))) / 2).alias("median"))


def paired_differences(events: DataFrame, model: str, cluster: str, value: str) -> DataFrame:
    """(a, b, cluster, difference): a cluster's mean under model a less that under b, for all ordered pairs of models that it has."""
    means = events.filter(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(model).alias("m")).agg(F.avg(value).alias("v"))
    lists = means.groupBy("cluster").agg(F.collect_list(F.struct("m", "v")).alias("all"))  # an entry a model
    pairs = lists.select("cluster", F.explode("all").alias("x"), "all").select("cluster", "x", F.explode("all").alias("y")).filter("x.m <> y.m")
    return pairs.select(F.col("x.m").alias("a"), F.col("y.m").alias("b"), "cluster", (F.col("x.v") - F.col("y.v")).alias("difference"))


def model_overlaps(events: DataFrame, model: str, cluster: str, day: str, days: int = 7) -> DataFrame:
    """(a, b, n, same_day, near): events of model a, those on a day of b's for the same cluster, and those within ``days`` of one.

    Each event is looked up once for every other model, by day and by buckets of
    days, not against all events of its cluster.
    """
    rows = events.select(F.col(model).alias("a"), F.col(cluster).cast("string").alias("c"), F.col(day).alias("day")).withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(rows, "model-events")
    others = rows.select(F.col("a").alias("b")).distinct()
    asked = rows.join(checked_broadcast(others), F.col("a") != F.col("b")).withColumn("_k", F.concat_ws("\x1f", "c", "b"))
    held = rows.select(F.concat_ws("\x1f", "c", "a").alias("_k"), F.col("day").alias("other_day")).distinct()
    near = band_join(asked, held, "_k", "day", "other_day", days, "left_semi").withColumn("_near", F.lit(1))
    same = asked.join(held, (asked["_k"] == held["_k"]) & (F.col("day") == F.col("other_day")), "left_semi").withColumn("_same", F.lit(1))
    every = asked.withColumn("_n", F.lit(1)).unionByName(near, allowMissingColumns=True).unionByName(same, allowMissingColumns=True)
    return every.groupBy("a", "b").agg(F.sum("_n").alias("n"), F.coalesce(F.sum("_same"), F.lit(0)).alias("same_day"), F.coalesce(F.sum("_near"), F.lit(0)).alias("near"))
