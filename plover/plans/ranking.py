"""Scoring and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plover.operators import ranks, stats
from plover.plans.registry import query

WEIGHTS = {"orders_score": 0.3, "value_score": 0.4, "balance_score": 0.2, "recency_score": 0.1}

_SCORED = """
o AS (SELECT o_custkey, count(*)::DOUBLE AS n_orders, round(avg(o_totalprice), 4) AS mean_value, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1),
j AS (SELECT c_custkey, c_mktsegment, n_orders, mean_value, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance,
    date_diff('day', DATE '1992-01-01', last_day)::DOUBLE AS recency, o_custkey IS NOT NULL AS matched FROM customer LEFT JOIN o ON o_custkey = c_custkey),
b AS (SELECT quantile_cont(n_orders, 0.05) FILTER (matched) l1, quantile_cont(n_orders, 0.95) FILTER (matched) h1, quantile_cont(mean_value, 0.05) FILTER (matched) l2,
    quantile_cont(mean_value, 0.95) FILTER (matched) h2, quantile_cont(balance, 0.05) FILTER (matched) l3, quantile_cont(balance, 0.95) FILTER (matched) h3,
    quantile_cont(recency, 0.05) FILTER (matched) l4, quantile_cont(recency, 0.95) FILTER (matched) h4 FROM j),
s AS (SELECT c_custkey, c_mktsegment, matched,
    CASE WHEN matched THEN least(100, greatest(0, (n_orders-l1)/(h1-l1)*100)) END AS orders_score, CASE WHEN matched THEN least(100, greatest(0, (mean_value-l2)/(h2-l2)*100)) END AS value_score,
    CASE WHEN matched AND balance IS NOT NULL THEN least(100, greatest(0, (balance-l3)/(h3-l3)*100)) END AS balance_score, CASE WHEN matched THEN least(100, greatest(0, (recency-l4)/(h4-l4)*100)) END AS recency_score
    FROM j, b),
w AS (SELECT *, (orders_score IS NOT NULL)::INT + (value_score IS NOT NULL)::INT + (balance_score IS NOT NULL)::INT + (recency_score IS NOT NULL)::INT AS n_known,
    0.3*coalesce(orders_score,0) + 0.4*coalesce(value_score,0) + 0.2*coalesce(balance_score,0) + 0.1*coalesce(recency_score,0) AS total,
    (CASE WHEN orders_score IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN value_score IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN balance_score IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN recency_score IS NOT NULL THEN 0.1 ELSE 0 END)::DOUBLE AS weight,
    concat_ws(',', CASE WHEN orders_score IS NULL THEN 'orders_score' END, CASE WHEN value_score IS NULL THEN 'value_score' END, CASE WHEN balance_score IS NULL THEN 'balance_score' END, CASE WHEN recency_score IS NULL THEN 'recency_score' END) AS missing_fields FROM s),
f AS (SELECT c_custkey, c_mktsegment, matched, round(CASE WHEN n_known >= 3 THEN total/weight END, 6) AS total_score, CASE WHEN n_known < 3 THEN 'insufficient_data' WHEN missing_fields = '' THEN 'ok' ELSE 'partial' END AS score_status, missing_fields FROM w)
"""


def scored(t):
    """Customers with four components, each scored 0 to 100, and their weighted score (N08, W32)."""
    orders = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"), stats.rounded(F.avg("o_totalprice"), 4).alias("mean_value"), F.max("o_orderdate").cast("date").alias("last_day"))
    met = t.customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", "c_mktsegment", "n_orders", "mean_value", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        F.datediff("last_day", F.lit("1992-01-01").cast("date")).cast("double").alias("recency"), F.col("o_custkey").isNotNull().alias("matched"),
    )
    met = stats.robust_scores(met, {"n_orders": "orders_score", "mean_value": "value_score", "balance": "balance_score", "recency": "recency_score"}, F.col("matched"))
    return stats.weighted_score(met, WEIGHTS, 3).withColumn("total_score", stats.rounded(F.col("total_score"), 6))


@query(
    "w32_robust_score",
    """WITH o AS (SELECT o_custkey, count(*)::DOUBLE AS n_orders, round(avg(o_totalprice), 4) AS mean_value FROM orders GROUP BY 1),
    j AS (SELECT c_custkey, o_custkey IS NOT NULL AS matched, n_orders, mean_value, CASE WHEN o_custkey IS NOT NULL THEN 1.0::DOUBLE END AS level FROM customer LEFT JOIN o ON o_custkey = c_custkey),
    b AS (SELECT quantile_cont(n_orders, [0.05, 0.95]) AS q1, quantile_cont(mean_value, [0.05, 0.95]) AS q2, count(*) AS n FROM j WHERE matched)
    SELECT c_custkey, matched,
        round(CASE WHEN matched THEN CASE WHEN n < 2 OR q1[1] = q1[2] THEN 50 ELSE least(100, greatest(0, (n_orders - q1[1]) / (q1[2] - q1[1]) * 100)) END END, 6)::DOUBLE AS orders_score,
        round(CASE WHEN matched THEN CASE WHEN n < 2 OR q2[1] = q2[2] THEN 50 ELSE least(100, greatest(0, (mean_value - q2[1]) / (q2[2] - q2[1]) * 100)) END END, 6)::DOUBLE AS value_score,
        CASE WHEN matched THEN 50.0::DOUBLE END AS flat_score FROM j, b""",
)
def w32(t):
    """Two spread components and one that is the same in all matched rows, so that it scores 50."""
    orders = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"), stats.rounded(F.avg("o_totalprice"), 4).alias("mean_value"))
    met = t.customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", F.col("o_custkey").isNotNull().alias("matched"), "n_orders", "mean_value", F.when(F.col("o_custkey").isNotNull(), 1.0).alias("level"),
    )
    met = stats.robust_scores(met, {"n_orders": "orders_score", "mean_value": "value_score", "level": "flat_score"}, F.col("matched"))
    return met.select("c_custkey", "matched", "orders_score", "value_score", "flat_score")


@query("n08_weighted_score", f"WITH {_SCORED} SELECT * FROM f")
def n08(t):
    return scored(t).select("c_custkey", "c_mktsegment", "matched", "total_score", "score_status", "missing_fields")


@query("t01_weighted_ranking", f"WITH {_SCORED} SELECT row_number() OVER (ORDER BY total_score DESC, c_custkey) AS place, c_custkey, total_score, score_status FROM f WHERE matched AND total_score IS NOT NULL")
def t01(t):
    good = scored(t).filter("matched and total_score is not null")
    return ranks.row_number(good.select("c_custkey", "total_score", "score_status"), [F.col("total_score").desc(), F.col("c_custkey")])


@query("t02_top_n_nulls_last", "SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer) ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def t02(t):
    value = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return t.customer.select("c_custkey", value.alias("c_acctbal")).orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(25)


@query(
    "t03_ranked_routing",
    """WITH r AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place, count(*) OVER () AS n FROM supplier),
    rest AS (SELECT s_suppkey, row_number() OVER (ORDER BY sha256('audit|' || s_suppkey), s_suppkey) AS draw FROM r WHERE place > ceil(n*0.2))
    SELECT r.s_suppkey, place, CASE WHEN place <= ceil(n*0.2) THEN 'ranked' WHEN draw <= ceil(n*0.01) THEN 'audit' ELSE 'none' END AS route FROM r LEFT JOIN rest ON rest.s_suppkey = r.s_suppkey""",
)
def t03(t):
    rows = ranks.row_number(t.supplier.select("s_suppkey", "s_acctbal"), [F.col("s_acctbal").desc(), F.col("s_suppkey")])
    rows = ranks.with_totals(rows, F.count(F.lit(1)).alias("n"), of=t.supplier)
    top = F.col("place") <= F.ceil(F.col("n") * 0.2)
    drawn = ranks.row_number(rows.filter(~top).withColumn("hash", F.sha2(F.concat_ws("|", F.lit("audit"), "s_suppkey"), 256)), ["hash", "s_suppkey"], "draw")
    audit = F.when(F.col("draw") <= F.ceil(F.col("n") * 0.01), "audit").otherwise("none")
    return rows.filter(top).select("s_suppkey", "place", F.lit("ranked").alias("route")).unionByName(drawn.select("s_suppkey", "place", audit.alias("route")))


@query("t04_second_stage_top_rate", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_nationkey, c_custkey) AS k, count(*) OVER () AS n FROM customer WHERE c_mktsegment = 'BUILDING') WHERE k <= ceil(n*0.1)")
def t04(t):
    chosen = t.customer.filter("c_mktsegment = 'BUILDING'")
    rows = ranks.row_number(chosen.select("c_custkey", "c_acctbal", "c_nationkey"), [F.col("c_acctbal").desc(), F.col("c_nationkey"), F.col("c_custkey")], "k")
    return ranks.with_totals(rows, F.count(F.lit(1)).alias("n"), of=chosen).filter(F.col("k") <= F.ceil(F.col("n") * 0.1)).select("c_custkey")


@query("t06_tiered_search", "SELECT p_partkey, CASE WHEN lower(p_name)='part 1' THEN 100 WHEN lower(p_name) LIKE 'part 1%' THEN 60 WHEN contains(lower(p_name),'1') THEN 20 ELSE 0 END AS score FROM part ORDER BY score DESC, p_partkey LIMIT 30")
def t06(t):
    name = F.lower("p_name")
    score = F.when(name == "part 1", 100).when(name.startswith("part 1"), 60).when(name.contains("1"), 20).otherwise(0)
    return t.part.select("p_partkey", score.alias("score")).orderBy(F.col("score").desc(), "p_partkey").limit(30)


@query("t07_one_per_key_then_top_k", "WITH d AS (SELECT source, n_chars, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM d WHERE r = 1) WHERE k <= 2")
def t07(t):
    one = t.documents.groupBy("source", "lang").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("m"))).alias("x"))
    rows = one.select("source", (-F.col("x.m")).alias("doc_id"), F.col("x.n_chars").alias("n_chars"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))).filter("k <= 2").drop("k")


@query("t09_universe_expansion", "WITH c AS (SELECT s_suppkey, 0 AS tier, 0.0 AS v FROM supplier WHERE s_nationkey = 0), r AS (SELECT s_suppkey, 1 AS tier, s_acctbal AS v FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM c)) SELECT s_suppkey, tier FROM (SELECT * FROM c UNION ALL SELECT * FROM r) ORDER BY tier, v DESC, s_suppkey LIMIT 9")
def t09(t):
    curated = t.supplier.filter("s_nationkey = 0").select("s_suppkey", F.lit(0).alias("tier"), F.lit(0.0).alias("v"))
    rest = t.supplier.join(curated, "s_suppkey", "left_anti").select("s_suppkey", F.lit(1).alias("tier"), F.col("s_acctbal").alias("v"))
    return curated.unionByName(rest).orderBy("tier", F.col("v").desc(), "s_suppkey").limit(9).select("s_suppkey", "tier")


@query("t12_t13_hash_folds", "SELECT c_custkey, ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM customer")
def t13(t):
    head = F.conv(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 8), 16, 10).cast("long")
    return t.customer.select("c_custkey", (head % 5).alias("fold"))


@query("t14_t05_t11_sort_by_size", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 40")
def t14(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(40)


@query("t10_rejection_mask", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) <= floor(count(*) OVER () * 0.25) AS rejected FROM supplier")
def t10(t):
    rows = ranks.with_totals(ranks.row_number(t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"]), F.count(F.lit(1)).alias("n"), of=t.supplier)
    return rows.select("s_suppkey", (F.col("place") <= F.floor(F.col("n") * 0.25)).alias("rejected"))


@query("w34_deviation_score", "SELECT s_suppkey, round(50 + 10*(s_acctbal - avg(s_acctbal) OVER ())/stddev_samp(s_acctbal) OVER (), 6) AS score FROM supplier")
def w34(t):
    totals = t.supplier.agg(F.avg("s_acctbal").alias("m"), F.stddev_samp("s_acctbal").alias("d"))
    return t.supplier.crossJoin(F.broadcast(totals)).select("s_suppkey", (50 + 10 * F.try_divide(F.col("s_acctbal") - F.col("m"), F.col("d"))).alias("score"))


_ERF = "1 - (t*(0.254829592 + t*(-0.284496736 + t*(1.421413741 + t*(-1.453152027 + t*1.061405429)))))*exp(-x*x)"


@query("w33_n09_normal_score", f"""WITH z AS (SELECT s_suppkey, s_nationkey, (s_acctbal - avg(s_acctbal) OVER ())/stddev_samp(s_acctbal) OVER () AS up, (avg(s_nationkey) OVER () - s_nationkey)/stddev_samp(s_nationkey) OVER () AS down FROM supplier),
l AS (SELECT s_suppkey, s_nationkey, unnest([up, down]) AS z, unnest([0.6, 0.4]) AS w FROM z), e AS (SELECT *, abs(z)/sqrt(2.0) AS x, 1/(1 + 0.3275911*abs(z)/sqrt(2.0)) AS t FROM l)
SELECT s_suppkey, round(sum(w*100*(1 + sign(z)*({_ERF}))/2) + CASE WHEN any_value(s_nationkey) < 5 THEN 3.0 ELSE 0.0 END, 6) AS score FROM e GROUP BY 1""")
def w33(t):
    """Scores by the normal distribution function, one of them reversed, weighted, then points for a flag."""
    totals = [x for c in ("s_acctbal", "s_nationkey") for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"d_{c}"))]
    z = lambda c: F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"d_{c}"))
    score = 60 * stats.normal_cdf(z("s_acctbal")) + 40 * stats.normal_cdf(-z("s_nationkey"))
    return ranks.with_totals(t.supplier, *totals).select("s_suppkey", (score + F.when(F.col("s_nationkey") < 5, 3.0).otherwise(0.0)).alias("score"))
