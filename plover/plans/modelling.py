"""Model, validation and backtest queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from plover.operators import models, ranks, stats
from plover.operators.joins import checked_broadcast
from plover.operators.quantiles import quantiles
from plover.plans.registry import query
from plover.session import materialize
from plover.sources.tables import PRICES_SQL, prices


def _rows(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("y"), F.col("l_quantity").cast("double").alias("q"), "l_discount", "l_tax", F.col("l_extendedprice").alias("target"))


@query("m01_m05_ridge", """WITH m AS (SELECT corr(l_quantity, l_extendedprice) r1, corr(l_discount, l_extendedprice) r2, corr(l_quantity, l_discount) c, stddev_pop(l_quantity) s1, stddev_pop(l_discount) s2, stddev_pop(l_extendedprice) sy, avg(l_quantity) a1, avg(l_discount) a2, avg(l_extendedprice) ay FROM lineitem),
b AS (SELECT *, sy/s1*(1.5*r1 - c*r2)/(2.25 - c*c) AS b1, sy/s2*(1.5*r2 - c*r1)/(2.25 - c*c) AS b2 FROM m)
SELECT term, round(weight, 3) AS weight FROM b, LATERAL (VALUES ('intercept', ay - b1*a1 - b2*a2), ('quantity', b1), ('discount', b2)) v(term, weight)""", digits=3)
def m01(t):
    """Two standardised features with a penalty of a half: the oracle solves the two equations."""
    intercept, beta = models.ridge(_rows(t), ["q", "l_discount"], "target", 0.5)
    return t.spark.createDataFrame([("intercept", intercept), ("quantity", float(beta[0])), ("discount", float(beta[1]))], "term string, weight double")


@query("m02_m04_elastic_net")
def m02(t):
    features = ["q", "l_discount", "l_tax"]
    intercept, beta = models.elastic_net(_rows(t), features, "target", 100.0, 0.5)
    return t.spark.createDataFrame([(f, float(b)) for f, b in zip(["intercept", *features], [intercept, *beta], strict=True)], "term string, weight double")


@query("m06_preprocess", """WITH b AS (SELECT quantile_cont(c_acctbal, 0.01) lo, quantile_cont(c_acctbal, 0.5) mid, quantile_cont(c_acctbal, 0.99) hi FROM customer WHERE c_custkey % 5 <> 0),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN mid ELSE greatest(lo, least(hi, c_acctbal)) END AS v FROM customer, b) SELECT c_custkey, round((v - avg(v) OVER ())/stddev_pop(v) OVER (), 6) AS v FROM c""")
def m06(t):
    return models.preprocess(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("v")), ["v"])


@query("m09_m10_logistic")
def m09(t):
    """Calibration of a logistic model of early priority by price and size."""
    rows = t.orders.select((F.col("o_totalprice") / 100000).alias("v"), (F.col("o_custkey") % 10 / 10).alias("k"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    intercept, beta = models.logistic(rows, ["v", "k"], "label")
    p = 1 / (1 + F.exp(-models.linear(["v", "k"], intercept, beta)))
    return rows.withColumn("p", p).agg(F.avg("p").alias("mean_p"), F.avg("label").alias("rate"), F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"))


@query("m08_boosted_stumps")
def m08(t):
    rows = t.orders.select("o_totalprice", (F.col("o_custkey") % 10).cast("double").alias("k"), (F.col("o_totalprice") > 150000).cast("int").alias("label"))
    stumps = models.boosted_stumps(rows, ["o_totalprice", "k"], "label", 5)
    return rows.groupBy("label").agg(F.avg(1 / (1 + F.exp(-models.stump_score(stumps)))).alias("mean_p"))


FEATURES = ["q", "l_discount", "l_tax"]


@query("m03_m11_walk_forward")
def m11(t):
    """For each year but the first two: the two best features and the penalty are chosen on the years before, tested on the year."""
    return models.walk_forward(_rows(t), FEATURES, "target", "y", 2, (0.01, 0.1, 1.0))


def _targets(t):
    """Customers with a practical target: whether their later orders reach 250,000."""
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    rows = t.orders.groupBy("o_custkey").agg(
        F.count_if(early).cast("double").alias("n"), F.avg(F.when(early, F.col("o_totalprice"))).alias("mean"), F.max(F.when(early, F.col("o_totalprice"))).alias("top"), F.max(F.when(~early, (F.col("o_totalprice") > 250000).cast("int"))).alias("label")
    )
    met = rows.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).dropna(subset=["mean", "label"])
    return met.select("c_custkey", "c_mktsegment", "n", "mean", "top", "c_acctbal", "label")


@query("m12_m13_practical_targets")
def m12(t):
    """AUC of a ridge score on held-out customers, for all and for each segment; tests hold it against numpy."""
    rows = _targets(t).withColumn("fold", F.pmod(F.xxhash64("c_custkey"), F.lit(3)))
    features = ["n", "mean", "top", "c_acctbal"]
    intercept, beta = models.ridge(rows.filter("fold <> 0"), features, "label", 0.1)
    tested = rows.filter("fold = 0").withColumn("s", F.round(models.linear(features, intercept, beta), 9))
    segments = sorted(r[0] for r in rows.select("c_mktsegment").distinct().collect())
    parts = [("all", tested), *[(s, tested.filter(F.col("c_mktsegment") == s)) for s in segments]]
    return reduce(lambda a, b: a.unionByName(b), [stats.auc(x, "s", "label").select(F.lit(name).alias("segment"), "positives", "negatives", "auc") for name, x in parts])


@query("m07_blended_ranks", """WITH r AS (SELECT o_orderkey, least(h, greatest(l, o_totalprice)) AS v, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1)/2.0 AS rk, count(*) OVER () AS n FROM orders, (SELECT quantile_cont(o_totalprice, 0.01) AS l, quantile_cont(o_totalprice, 0.99) AS h FROM orders)),
z AS (SELECT o_orderkey, (v - avg(v) OVER ())/stddev_pop(v) OVER () AS zr, (rk/n - avg(rk/n) OVER ())/stddev_pop(rk/n) OVER () AS zk FROM r) SELECT o_orderkey, round(0.5*zr + 0.5*zk, 5) AS blend FROM z""", digits=5)
def m07(t):
    """The mean of the z-scores of the clipped value and of its rank share."""
    v = F.col("o_totalprice")
    groups = ranks.by_value(t.orders.select("o_totalprice"), "o_totalprice", {"c": F.lit(1).cast("long")}).select(v.alias("at"), (F.col("below_c") + (F.col("c") + 1) / 2).alias("rk"))
    rows = t.orders.select("o_orderkey", "o_totalprice").join(groups, v == F.col("at"))
    rows = rows.crossJoin(F.broadcast(quantiles(t.orders, ["o_totalprice"], (0.01, 0.99), (), [F.count(F.lit(1)).alias("total")]).select(F.col("q_o_totalprice").alias("b"), "total")))
    rows = rows.select("o_orderkey", F.greatest(F.col("b")[0], F.least(F.col("b")[1], v)).alias("v"), (F.col("rk") / F.col("total")).alias("k"))
    rows = ranks.with_totals(rows, *[f(c).alias(f"{n}{c}") for c in "vk" for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    return rows.select("o_orderkey", (0.5 * (F.col("v") - F.col("mv")) / F.col("dv") + 0.5 * (F.col("k") - F.col("mk")) / F.col("dk")).alias("blend"))


@query("m14_limit_prices", f"""WITH {PRICES_SQL}, f AS (SELECT symbol, i, close, (min(low) OVER w/close - 1)*100 AS drop_pct, year(day)::INT AS y FROM px WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)), k AS (SELECT * FROM f WHERE drop_pct IS NOT NULL),
m AS (SELECT symbol, median(drop_pct) AS forecast FROM k WHERE y < 1996 GROUP BY 1), o AS (SELECT median(k.drop_pct - forecast) AS shift, quantile_cont(k.drop_pct - forecast, 0.2) AS deep, quantile_cont(k.drop_pct - forecast, 0.8) AS near FROM k JOIN m USING (symbol) WHERE y = 1996)
SELECT symbol, round(forecast + shift, 5) AS calibrated, round(100 + forecast + near, 5) AS limit_80, round(100 + forecast + deep, 5) AS limit_20 FROM m, o""", digits=5)
def m14(t):
    """A median forecast of the drop, moved by the median residual of a later year; limits by how likely they fill."""
    from plover.operators.timeseries import by_symbol

    low = F.min("low").over(by_symbol().rowsBetween(1, 60))
    rows = prices(t.lineitem).select("symbol", ((low / F.col("close") - 1) * 100).alias("drop_pct"), F.year("day").alias("y")).filter("drop_pct is not null and y <= 1996")
    rows = materialize(rows, "drops")
    forecast = materialize(quantiles(rows.filter("y < 1996"), ["drop_pct"], (0.5,), ["symbol"]).select("symbol", F.col("q_drop_pct")[0].alias("forecast")), "forecast")
    rest = rows.filter("y = 1996").join(forecast, "symbol").select((F.col("drop_pct") - F.col("forecast")).alias("r"))
    out = forecast.crossJoin(F.broadcast(quantiles(rest, ["r"], (0.2, 0.5, 0.8)).select(F.col("q_r").alias("q"))))
    at = lambda k: F.col("forecast") + F.col("q")[k]
    return out.select("symbol", at(1).alias("calibrated"), (100 + at(2)).alias("limit_80"), (100 + at(0)).alias("limit_20"))


@query("m15_a26_staged_limits", f"WITH {PRICES_SQL}, f AS (SELECT symbol, i, close, min(low) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS low60, lead(close, 60) OVER (PARTITION BY symbol ORDER BY i) AS last FROM px) SELECT symbol, i, round(0.5*(last/close - 1) + CASE WHEN low60 <= close*0.9 THEN 0.3*(last/(close*0.9) - 1) ELSE 0 END + CASE WHEN low60 <= close*0.8 THEN 0.2*(last/(close*0.8) - 1) ELSE 0 END, 6) AS result FROM f WHERE last IS NOT NULL")
def m15(t):
    """Half at the close, the rest at two limits if the low reaches them within 60 rows; unfilled cash earns nothing."""
    from plover.operators.timeseries import by_symbol

    rows = prices(t.lineitem).withColumns({"low60": F.min("low").over(by_symbol().rowsBetween(1, 60)), "last": F.lead("close", 60).over(by_symbol())}).filter("last is not null")
    part = lambda share, level: F.when(F.col("low60") <= F.col("close") * level, share * (F.col("last") / (F.col("close") * level) - 1)).otherwise(0.0)
    return rows.select("symbol", "i", (0.5 * (F.col("last") / F.col("close") - 1) + part(0.3, 0.9) + part(0.2, 0.8)).alias("result"))


@query("m16_m17_gate_backtest", "WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders), th AS (SELECT y.y, quantile_cont(o_totalprice, 0.8) AS q FROM y JOIN orders ON year(o_orderdate) < y.y GROUP BY 1) SELECT y, count(*) AS n, count(*) FILTER (o_totalprice >= q) AS passed, round(avg((o_orderstatus='F')::INT) FILTER (o_totalprice >= q), 6) AS captured FROM orders JOIN th ON year(o_orderdate) = y GROUP BY 1")
def m16(t):
    orders = t.orders.withColumn("oy", F.year("o_orderdate"))
    years = orders.select(F.col("oy").alias("y")).distinct()
    limits = quantiles(orders.join(checked_broadcast(years), F.col("oy") < F.col("y")), ["o_totalprice"], (0.8,), ["y"]).select("y", F.col("q_o_totalprice")[0].alias("q"))
    met = orders.join(checked_broadcast(limits), F.col("oy") == F.col("y"))
    passed = F.col("o_totalprice") >= F.col("q")
    return met.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed"), F.avg(F.when(passed, (F.col("o_orderstatus") == "F").cast("int"))).alias("captured"))


@query("a26_strategy_description", f"WITH {PRICES_SQL}, f AS (SELECT symbol, close, min(low) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS low60, lead(close, 60) OVER (PARTITION BY symbol ORDER BY i) AS last FROM px), r AS (SELECT 1 + (low60 <= close*0.9)::INT + (low60 <= close*0.8)::INT AS filled, floor((0.5*(last/close - 1) + CASE WHEN low60 <= close*0.9 THEN 0.3*(last/(close*0.9) - 1) ELSE 0 END + CASE WHEN low60 <= close*0.8 THEN 0.2*(last/(close*0.8) - 1) ELSE 0 END)*1000000)::BIGINT AS ppm FROM f WHERE last IS NOT NULL) SELECT count(*) AS n, round(avg(ppm), 2) AS mean_ppm, median(ppm) AS median_ppm, round(avg((ppm > 0)::INT), 4) AS win_rate, round(avg(filled), 4) AS mean_tranches, round(avg((filled = 3)::INT), 4) AS all_filled FROM r", digits=4)
def a26(t):
    """How a staged strategy did: mean, median, share of gains, tranches that were filled."""
    from plover.operators.timeseries import by_symbol

    rows = prices(t.lineitem).withColumns({"low60": F.min("low").over(by_symbol().rowsBetween(1, 60)), "last": F.lead("close", 60).over(by_symbol())}).filter("last is not null")
    touched = lambda level: F.col("low60") <= F.col("close") * level
    part = lambda share, level: F.when(touched(level), share * (F.col("last") / (F.col("close") * level) - 1)).otherwise(0.0)
    ppm = F.floor((0.5 * (F.col("last") / F.col("close") - 1) + part(0.3, 0.9) + part(0.2, 0.8)) * 1000000)
    rows = materialize(rows.select(ppm.alias("ppm"), (1 + touched(0.9).cast("int") + touched(0.8).cast("int")).alias("filled")), "results")
    more = [F.count(F.lit(1)).alias("n"), F.round(F.avg("ppm"), 2).alias("mean_ppm"), F.avg((F.col("ppm") > 0).cast("int")).alias("win_rate"), F.avg("filled").alias("mean_tranches"), F.avg((F.col("filled") == 3).cast("int")).alias("all_filled")]
    return quantiles(rows, ["ppm"], (0.5,), (), more).select("n", "mean_ppm", F.col("q_ppm")[0].alias("median_ppm"), "win_rate", "mean_tranches", "all_filled")


_ERF = "1 - (t*(0.254829592 + t*(-0.284496736 + t*(1.421413741 + t*(-1.453152027 + t*1.061405429)))))*exp(-x*x)"


@query("m18_significance", f"""WITH g AS (SELECT c_mktsegment AS segment, count(*) AS n, avg((o_totalprice > 200000)::INT) AS p FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), a AS (SELECT avg((o_totalprice > 200000)::INT) AS base, count(*) AS total FROM orders JOIN customer ON c_custkey = o_custkey),
z AS (SELECT segment, n, p - base AS difference, (p - base)/sqrt(base*(1 - base)*(1.0/n + 1.0/total)) AS z FROM g, a), e AS (SELECT *, abs(z)/sqrt(2.0) AS x, 1/(1 + 0.3275911*abs(z)/sqrt(2.0)) AS t FROM z), q AS (SELECT *, round(1 - ({_ERF}), 9) AS pv FROM e),
s AS (SELECT *, least(1.0, pv*(count(*) OVER () - row_number() OVER (ORDER BY pv, segment) + 1)) AS sc FROM q) SELECT segment, n, round(difference, 5) AS difference, round(z, 5) AS z, round(pv, 5) AS p, round(max(sc) OVER (ORDER BY pv, segment ROWS UNBOUNDED PRECEDING), 5) AS p_holm FROM s""", digits=5)
def m18(t):
    """Each segment's rate against that of all: z, two-sided p from the normal distribution, then Holm's adjustment."""
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("segment"), (F.col("o_totalprice") > 200000).cast("int").alias("y"))
    groups = ranks.with_totals(rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("p0")), F.avg("y").alias("base"), F.count(F.lit(1)).alias("total"), of=rows)
    z = F.try_divide(F.col("p0") - F.col("base"), F.sqrt(F.col("base") * (1 - F.col("base")) * (1 / F.col("n") + 1 / F.col("total"))))
    tested = groups.select("segment", "n", F.round(F.col("p0") - F.col("base"), 6).alias("difference"), z.alias("z")).withColumn("p", F.round(2 * (1 - stats.normal_cdf(F.abs("z"))), 9))
    return stats.holm_adjusted(tested, "p", "segment")


@query("m19_case_replay", "WITH c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) SELECT user_id, event_id, step, round(CASE WHEN best IS NULL THEN 50 ELSE 75*greatest(0, 1 - best/greatest(value, 0.01)) + least(25, step) END, 4) AS score, CASE WHEN best IS NULL OR value > best THEN 'review' ELSE 'store' END AS route FROM c", digits=4)
def m19(t):
    """Each case is scored as it would have been on its day: from what came before it only."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    best = F.max("value").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = t.events.select("user_id", "event_id", "value", F.row_number().over(order).alias("step"), best.alias("best"))
    score = F.when(F.col("best").isNull(), 50.0).otherwise(75 * F.greatest(F.lit(0.0), 1 - F.col("best") / F.greatest("value", F.lit(0.01))) + F.least(F.lit(25), "step"))
    return rows.select("user_id", "event_id", "step", score.alias("score"), F.when(F.col("best").isNull() | (F.col("value") > F.col("best")), "review").otherwise("store").alias("route"))


@query("m20_adaptive_threshold", "WITH r AS (SELECT s_acctbal, row_number() OVER (ORDER BY s_acctbal) AS k, count(*) OVER () AS n FROM supplier) SELECT round(greatest(-2.0, least(2.0, (max(s_acctbal) - 5000)*0.2)) + 5000, 6) AS threshold FROM r WHERE k = ceil(n*0.9)")
def m20(t):
    """A fifth of the way to the target quantile, by two at most."""
    rows = ranks.with_totals(ranks.row_number(t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], "k"), F.count(F.lit(1)).alias("n"), of=t.supplier)
    return rows.filter(F.col("k") == F.ceil(F.col("n") * 0.9)).agg((F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.max("s_acctbal") - 5000) * 0.2)) + 5000).alias("threshold"))


@query("e20_feature_selection", "WITH l AS (SELECT 'q' AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'd', l_discount, l_extendedprice FROM lineitem UNION ALL SELECT 't', l_tax, l_extendedprice FROM lineitem), c AS (SELECT f, abs(corr(x, y)) AS c FROM l GROUP BY 1) SELECT f, round(c, 5) AS strength FROM c ORDER BY c DESC LIMIT 2", digits=5)
def e20(t):
    long = t.lineitem.select(F.expr("stack(3, 'q', cast(l_quantity as double), 'd', l_discount, 't', l_tax) as (f, x)"), F.col("l_extendedprice").alias("y"))
    return long.groupBy("f").agg(F.abs(stats.pearson(F.col("x"), F.col("y"))).alias("strength")).orderBy(F.col("strength").desc()).limit(2)
