"""Aggregation and statistics queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plover.operators import ranks, sketches, stats
from plover.operators.joins import checked_broadcast
from plover.operators.quantiles import quantiles
from plover.operators.stability import expanding_correlations, stability
from plover.plans.registry import query
from plover.session import materialize
from plover.sources.tables import PRICES_SQL, prices

_EVENTS_SQL = f"""{PRICES_SQL}, ev AS (SELECT symbol, i, day, year(day)::INT AS year, CASE WHEN symbol % 3 = 0 THEN 'large' WHEN symbol % 3 = 1 THEN 'mid' ELSE 'small' END AS model, close,
    floor((lead(close, 60) OVER (PARTITION BY symbol ORDER BY i) - close)*10000/close)::BIGINT AS ret FROM px)"""


def _events(t):
    """Price rows as events with a 60-row return in whole basis points, so that sums are exact."""
    ahead = F.lead("close", 60).over(Window.partitionBy("symbol").orderBy("i"))
    model = F.when(F.col("symbol") % 3 == 0, "large").when(F.col("symbol") % 3 == 1, "mid").otherwise("small")
    return prices(t.lineitem).select("symbol", "i", "day", F.year("day").alias("year"), model.alias("model"), "close", F.floor((ahead - F.col("close")) * 10000 / F.col("close")).alias("ret"))


_SUMMARY = "count(ret) AS n, round(avg(ret), 6) AS mean, round(median(ret), 6) AS med, round(avg((ret > 0)::INT) FILTER (ret IS NOT NULL), 6) AS win_rate"


def _summary(rows, *by):
    """Count, mean, median and share of gains per group; the median by selection, so no task sees a group."""
    r = F.col("ret")
    out = quantiles(rows, ["ret"], (0.5,), by, [F.avg(r).alias("mean"), F.avg(F.when(r.isNotNull(), (r > 0).cast("int"))).alias("win_rate")])
    return out.select(*by, F.col("n_ret").alias("n"), "mean", F.col("q_ret")[0].alias("med"), "win_rate")


@query("a01_horizon_summary", f"WITH {_EVENTS_SQL} SELECT model, {_SUMMARY} FROM ev GROUP BY 1")
def a01(t):
    return _summary(materialize(_events(t).select("model", "ret"), "events"), "model")


@query("a02_summary_by_period", f"WITH {_EVENTS_SQL}, l AS (SELECT ev.*, unnest(['all', year::VARCHAR, CASE WHEN year < 1995 THEN 'early' ELSE 'late' END]) AS period FROM ev) SELECT model, period, {_SUMMARY} FROM l GROUP BY 1, 2")
def a02(t):
    labels = F.array(F.lit("all"), F.col("year").cast("string"), F.when(F.col("year") < 1995, "early").otherwise("late"))
    rows = materialize(_events(t).select("model", "year", "ret"), "events")
    return _summary(rows.withColumn("period", F.explode(labels)), "model", "period")


@query("a03_without_top_winners", f"WITH {_EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ret DESC, symbol, i) AS rn FROM ev WHERE ret IS NOT NULL) SELECT model, k, {_SUMMARY} FROM r JOIN (VALUES (0), (1), (3), (5), (10)) d(k) ON rn > k GROUP BY 1, 2")
def a03(t):
    """The top ten per model by two-step top-k: first per symbol, then per model, so no window spans all rows."""
    rows = materialize(_events(t).filter("ret is not null").select("symbol", "i", "model", "ret"), "events")
    top = rows.withColumn("r0", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ret").desc(), "i"))).filter("r0 <= 10")
    top = top.withColumn("rn", F.row_number().over(Window.partitionBy("model").orderBy(F.col("ret").desc(), "symbol", "i"))).filter("rn <= 10")
    met = rows.join(top.select(F.col("symbol").alias("s"), F.col("i").alias("j"), "rn"), (F.col("symbol") == F.col("s")) & (F.col("i") == F.col("j")), "left")
    cut = met.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (0, 1, 3, 5, 10)]))).filter(F.coalesce("rn", F.lit(11)) > F.col("k"))
    return _summary(cut, "model", "k")


@query("a05_unpivot_summary", "SELECT measure, count(value) AS n, round(avg(value), 4) AS mean FROM (SELECT 'quantity' AS measure, l_quantity AS value FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY 1", digits=4)
def a05(t):
    long = t.lineitem.select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).unpivot([], ["quantity", "discount", "tax"], "measure", "value")
    return long.groupBy("measure").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


@query("a06_a24_band_by_model", f"WITH {_EVENTS_SQL}, b AS (SELECT *, CASE WHEN close < 300000 THEN 'small' WHEN close < 500000 THEN 'mid' ELSE 'large' END AS band FROM ev) SELECT band, model, count(*) AS n, round(count(*)*1.0/sum(count(*)) OVER (), 6) AS share, round(avg((band = model)::INT), 6) AS routed FROM b GROUP BY 1, 2")
def a06(t):
    band = F.when(F.col("close") < 300000, "small").when(F.col("close") < 500000, "mid").otherwise("large")
    out = _events(t).withColumn("band", band).groupBy("band", "model").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("band") == F.col("model")).cast("int")).alias("routed"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("a07_threshold_simulation", f"WITH {_EVENTS_SQL}, s AS (SELECT * FROM (VALUES ('base', 300000.0, 500000.0), ('wide', 200000.0, 600000.0), ('low', 250000.0, 400000.0)) v(name, lo, hi)) SELECT name, model, {_SUMMARY} FROM ev CROSS JOIN s WHERE model = CASE WHEN close < lo THEN 'small' WHEN close < hi THEN 'mid' ELSE 'large' END GROUP BY 1, 2")
def a07(t):
    sets = t.spark.createDataFrame([("base", 300000.0, 500000.0), ("wide", 200000.0, 600000.0), ("low", 250000.0, 400000.0)], "name string, lo double, hi double")
    band = F.when(F.col("close") < F.col("lo"), "small").when(F.col("close") < F.col("hi"), "mid").otherwise("large")
    return _summary(materialize(_events(t).join(F.broadcast(sets), F.col("model") == band).select("name", "model", "ret"), "events"), "name", "model")


@query("a04_a08_conditional_summary", f"WITH {PRICES_SQL}, f AS (SELECT symbol, floor((lead(close, 5) OVER s - close)*10000/close)::BIGINT r5, floor((lead(close, 20) OVER s - close)*10000/close)::BIGINT r20 FROM px WINDOW s AS (PARTITION BY symbol ORDER BY i)) SELECT symbol, count(r5) n5, round(avg(r5), 6) m5, round(100.0*count(*) FILTER (r5 > 0)/count(r5), 2) w5, count(r20) n20, round(avg(r20), 6) m20, round(100.0*count(*) FILTER (r20 > 0)/count(r20), 2) w20 FROM f GROUP BY 1")
def a08(t):
    by = Window.partitionBy("symbol").orderBy("i")
    rows = prices(t.lineitem)
    for n in (5, 20):
        rows = rows.withColumn(f"r{n}", F.floor((F.lead("close", n).over(by) - F.col("close")) * 10000 / F.col("close")))
    parts = [x for n in (5, 20) for x in (F.count(f"r{n}").alias(f"n{n}"), F.avg(f"r{n}").alias(f"m{n}"), F.round(F.lit(100.0) * F.count_if(F.col(f"r{n}") > 0) / F.count(f"r{n}"), 2).alias(f"w{n}"))]
    return rows.groupBy("symbol").agg(*parts)


@query("a09_a10_a40_a41_coverage", "WITH l AS (SELECT 'text' AS feature, nullif(trim(text), '') AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents) SELECT feature, count(*) AS n, count(v) AS known, count(DISTINCT v) AS n_unique, count(v)*1.0/count(*) >= 0.5 AND count(DISTINCT v) >= 5 AS recommended FROM l GROUP BY 1")
def a09(t):
    long = t.documents.select(F.nullif(F.trim("text"), F.lit("")).alias("text"), "lang", "source").unpivot([], ["text", "lang", "source"], "feature", "v")
    known = F.count("v")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), known.alias("known"), F.countDistinct("v").alias("n_unique")).withColumn("recommended", (F.col("known") / F.col("n") >= 0.5) & (F.col("n_unique") >= 5))


_LONG = "long AS (SELECT 'quantity' AS feature, l_quantity AS x, l_extendedprice AS y, l_suppkey % 5 AS fold FROM lineitem UNION ALL SELECT 'discount', l_discount, l_extendedprice, l_suppkey % 5 FROM lineitem)"


def _long(t):
    return t.lineitem.select("l_quantity", "l_discount", F.col("l_extendedprice").alias("y"), (F.col("l_suppkey") % 5).alias("fold")).select("y", "fold", F.expr("stack(2, 'quantity', l_quantity, 'discount', l_discount) as (feature, x)"))


def _rank_sql(by: str) -> str:
    return f"SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1)/2.0 AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1)/2.0 AS ry FROM long"


@query("a11_pearson_spearman", f"WITH {_LONG}, r AS ({_rank_sql('feature')}) SELECT feature, count(*) AS n, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r GROUP BY 1", digits=5)
def a11(t):
    return stats.correlations(_long(t), ["feature"])


@query("a12_a13_fold_correlations", f"WITH {_LONG}, r AS ({_rank_sql('feature, fold')}), c AS (SELECT feature, fold, round(corr(rx, ry), 5) AS s FROM r GROUP BY 1, 2) SELECT feature, round(median(s), 4) AS mid, min(s) AS low, max(s) AS high, round(avg((s > 0)::INT), 4) AS positive FROM c GROUP BY 1", digits=5)
def a13(t):
    folds = stats.correlations(_long(t), ["feature", "fold"]).withColumn("s", F.round("spearman", 5))
    return folds.groupBy("feature").agg(F.round(F.percentile("s", 0.5), 4).alias("mid"), F.min("s").alias("low"), F.max("s").alias("high"), F.round(F.avg((F.col("s") > 0).cast("int")), 4).alias("positive"))


@query("a14_e26_backward_windows", "WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS start FROM orders) SELECT start, count(*) AS n, round(avg(round(o_totalprice)::BIGINT), 6) AS mean FROM orders JOIN y ON year(o_orderdate) >= start GROUP BY 1")
def a14(t):
    """Windows from each start year to the end: sums per year first, then a running sum backwards."""
    years = t.orders.groupBy(F.year("o_orderdate").alias("start")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.round("o_totalprice").cast("long")).alias("v"))
    back = Window.orderBy(F.col("start").desc())
    return years.select("start", F.sum("c").over(back).alias("n"), (F.sum("v").over(back) / F.sum("c").over(back)).alias("mean"))


_YEARS_SQL = """long AS (SELECT feature, year(l_shipdate)::INT AS y, v AS x, l_extendedprice AS y_value FROM (SELECT l_shipdate, l_extendedprice, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)),
starts AS (SELECT DISTINCT y AS start_year FROM long),
windows AS (SELECT feature, start_year, count(*) AS n, corr(x, y_value) AS pearson FROM long JOIN starts ON y >= start_year GROUP BY 1, 2 HAVING count(*) >= 10),
lagged AS (SELECT *, lag(pearson) OVER (PARTITION BY feature ORDER BY start_year DESC) AS previous FROM windows)"""


def _backward(t):
    """Price against quantity, discount and tax of each line, over years that reach ever further back."""
    long = t.lineitem.select(F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return expanding_correlations(long.unpivot(["year", "y"], ["quantity", "discount", "tax"], "feature", "x"), ["feature"], "year")


@query("a14_backward_correlations", f"WITH {_YEARS_SQL} SELECT feature, start_year, n, round(pearson, 6) AS pearson, round(previous, 6) AS previous, round(pearson - previous, 6) AS change, pearson*previous > 0 AS agrees FROM lagged")
def a14_correlations(t):
    return _backward(t)


@query("a14_backward_stability", f"""WITH {_YEARS_SQL} SELECT feature, count(*) AS windows, count(*) FILTER (pearson > 0) = count(*) OR count(*) FILTER (pearson < 0) = count(*) AS one_sign, round(greatest(count(*) FILTER (pearson > 0), count(*) FILTER (pearson < 0))*1.0/count(*), 6) AS majority,
round(median(pearson), 6) AS median, round(min(pearson), 6) AS least, round(max(pearson), 6) AS most, round(min(abs(pearson)), 6) AS least_abs, round(median(abs(pearson)), 6) AS median_abs FROM windows GROUP BY 1""")
def a14_stability(t):
    return stability(_backward(t), ["feature"])


@query("e26_survivorship_drift", f"""WITH {_EVENTS_SQL}, s AS (SELECT DISTINCT year AS start_year FROM ev), l AS (SELECT start_year, ret FROM ev JOIN s ON year >= start_year WHERE ret IS NOT NULL), q AS (SELECT start_year, quantile_cont(ret, 0.1) AS lo, quantile_cont(ret, 0.9) AS hi FROM l GROUP BY 1)
SELECT start_year, count(*) AS n, round(avg((ret >= 2000)::INT), 6) AS big_rate, round(avg((ret <= -2000)::INT), 6) AS loss_rate, round(avg(ret), 6) AS mean, round(avg(ret) FILTER (ret BETWEEN lo AND hi), 6) AS trimmed_mean FROM l JOIN q USING (start_year) GROUP BY 1""")
def e26(t):
    """How rates and means drift as the history begins later; each row counts for the start years up to its own."""
    rows = materialize(_events(t).filter("ret is not null").select("year", "ret"), "events")
    starts = rows.select(F.col("year").alias("start_year")).distinct()
    long = rows.join(checked_broadcast(starts), F.col("year") >= F.col("start_year")).select("start_year", "ret")
    bounds = quantiles(long, ["ret"], (0.1, 0.9), ["start_year"]).select(F.col("start_year").alias("q_year"), F.col("q_ret")[0].alias("lo"), F.col("q_ret")[1].alias("hi"))
    r = F.col("ret")
    met = long.join(checked_broadcast(bounds), F.col("start_year") == F.col("q_year")).groupBy("start_year")
    return met.agg(F.count(F.lit(1)).alias("n"), F.avg((r >= 2000).cast("int")).alias("big_rate"), F.avg((r <= -2000).cast("int")).alias("loss_rate"), F.avg(r).alias("mean"), F.avg(F.when(r.between(F.col("lo"), F.col("hi")), r)).alias("trimmed_mean"))


@query("a15_group_summary", "SELECT n_regionkey AS industry, count(*) AS n, round(avg(round(c_acctbal*100)::BIGINT), 4) AS mean, round(median(c_acctbal), 6) AS med FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def a15(t):
    met = t.customer.join(checked_broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = met.select(F.col("n_regionkey").alias("industry"), "c_acctbal")
    out = quantiles(rows, ["c_acctbal"], (0.5,), ["industry"], [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.round(F.col("c_acctbal") * 100).cast("long")), 4).alias("mean")])
    return out.select("industry", "n", "mean", F.col("q_c_acctbal")[0].alias("med"))


@query("a16_split_manifest_s04", f"WITH {PRICES_SQL} SELECT symbol, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM px GROUP BY 1")
def a16(t):
    return prices(t.lineitem).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("a17_company_index", "SELECT o_custkey, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS latest, max_by(o_orderkey, struct_pack(a := length(o_orderpriority), b := o_orderkey)) AS complete, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1")
def a17(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.max_by("o_orderkey", F.struct(F.length("o_orderpriority"), "o_orderkey")).alias("complete"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("statuses"))


@query("a18_a38_duplicate_audit", "SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a18(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("content")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("a19_quality_counters", "SELECT metric, value FROM (SELECT count(*)::BIGINT AS n_rows, count(DISTINCT source)::BIGINT AS n_sources, count(*) FILTER (lang = 'en')::BIGINT AS english, count(*) FILTER (n_chars < 100)::BIGINT AS short FROM documents) UNPIVOT (value FOR metric IN (n_rows, n_sources, english, short))")
def a19(t):
    one = t.documents.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") < 100).alias("short"))
    return one.unpivot([], one.columns, "metric", "value")


@query("a21_group_spread", "SELECT s_nationkey, count(*) AS n, round(stddev_samp(s_acctbal), 6) AS sd, round(quantile_cont(s_acctbal, 0.75), 6) AS p75, round(quantile_cont(s_acctbal, 0.9), 6) AS p90, max(s_acctbal) AS top FROM supplier GROUP BY 1 HAVING count(*) >= 2")
def a21(t):
    v = "s_acctbal"
    out = quantiles(t.supplier, [v], (0.75, 0.9), ["s_nationkey"], [F.count(F.lit(1)).alias("n"), F.stddev_samp(v).alias("sd"), F.max(v).alias("top")])
    return out.filter("n >= 2").select("s_nationkey", "n", "sd", F.col(f"q_{v}")[0].alias("p75"), F.col(f"q_{v}")[1].alias("p90"), "top")


@query("a22_a27_a28_a29_capture", "WITH c AS (SELECT o_custkey, max((o_totalprice > 250000)::INT) AS truth, max((o_orderpriority = '1-URGENT')::INT) AS flag FROM orders GROUP BY 1) SELECT sum(truth*flag)::BIGINT AS hits, round(sum(truth*flag)*1.0/sum(flag), 6) AS precision, round(sum(truth*flag)*1.0/sum(truth), 6) AS capture, round(1.25*(sum(truth*flag)*1.0/sum(flag))*(sum(truth*flag)*1.0/sum(truth))/(0.25*(sum(truth*flag)*1.0/sum(flag)) + sum(truth*flag)*1.0/sum(truth)), 6) AS f05 FROM c")
def a22(t):
    c = t.orders.groupBy("o_custkey").agg(F.max((F.col("o_totalprice") > 250000).cast("int")).alias("truth"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("flag"))
    s = c.agg(F.sum(F.col("truth") * F.col("flag")).alias("hits"), F.sum("flag").alias("flagged"), F.sum("truth").alias("true"))
    p, r = F.try_divide(F.col("hits"), F.col("flagged")), F.try_divide(F.col("hits"), F.col("true"))
    return s.select("hits", p.alias("precision"), r.alias("capture"), F.try_divide(1.25 * p * r, 0.25 * p + r).alias("f05"))


@query("a23_a43_ordered_lines", "SELECT s_nationkey, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_acctbal DESC, s_suppkey) AS line FROM supplier GROUP BY 1")
def a23(t):
    rows = F.array_sort(F.collect_list(F.struct((-F.col("s_acctbal")).alias("a"), "s_suppkey")))
    return t.supplier.groupBy("s_nationkey").agg(F.array_join(F.transform(rows, lambda x: x["s_suppkey"].cast("string")), ",").alias("line"))


@query("a25_trimmed_mean", "WITH b AS (SELECT quantile_cont(o_totalprice, 0.1) lo, quantile_cont(o_totalprice, 0.9) hi FROM orders) SELECT count(*) AS n, round(avg(round(o_totalprice*100)::BIGINT), 4) AS mean FROM orders, b WHERE o_totalprice BETWEEN lo AND hi")
def a25(t):
    b = quantiles(t.orders, ["o_totalprice"], (0.1, 0.9)).select(F.col("q_o_totalprice")[0].alias("lo"), F.col("q_o_totalprice")[1].alias("hi"))
    return t.orders.crossJoin(F.broadcast(b)).filter(F.col("o_totalprice").between(F.col("lo"), F.col("hi"))).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.round(F.col("o_totalprice") * 100).cast("long")), 4).alias("mean"))


@query("a30_e27_forecast_errors", "SELECT round(avg(abs(l_tax - l_discount)), 5) AS mae, round(median(abs(l_tax - l_discount)), 5) AS med_ae, round(avg(l_tax - l_discount), 5) AS bias, round(avg(CASE WHEN l_discount >= l_tax THEN 0.2*(l_discount - l_tax) ELSE 0.8*(l_tax - l_discount) END), 5) AS pinball FROM lineitem", digits=5)
def a30(t):
    d = F.col("l_tax") - F.col("l_discount")
    rows = t.lineitem.select(d.alias("d"), F.abs(d).alias("gap"))
    d = F.col("d")
    out = quantiles(rows, ["gap"], (0.5,), (), [F.avg("gap").alias("mae"), F.avg(d).alias("bias"), F.avg(F.when(d <= 0, -0.2 * d).otherwise(0.8 * d)).alias("pinball")])
    return out.select("mae", F.col("q_gap")[0].alias("med_ae"), "bias", "pinball")


@query("a31_w28_calibration_table", "WITH q AS (SELECT ceil(row_number() OVER (ORDER BY o_totalprice, o_orderkey)*5.0/count(*) OVER ())::BIGINT AS bin, o_totalprice, o_orderstatus FROM orders) SELECT bin, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate, min(o_totalprice) AS low FROM q GROUP BY 1")
def a31(t):
    q = stats.quantile_bin(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice", 5, "o_orderkey")
    return q.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate"), F.min("o_totalprice").alias("low"))


@query("a32_family_consolidation", "SELECT n_chars % 97 AS family, max_by(doc_id, struct_pack(a := n_chars, b := -doc_id)) AS representative, count(*) AS members, string_agg(DISTINCT lang, '|' ORDER BY lang) AS countries FROM documents GROUP BY 1")
def a32(t):
    return t.documents.groupBy((F.col("n_chars") % 97).alias("family")).agg(F.max_by("doc_id", F.struct("n_chars", (-F.col("doc_id")).alias("m"))).alias("representative"), F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("countries"))


@query("a33_a34_a35_a36_a44_totals", "SELECT event_type, count(*) AS n, round(coalesce(sum(round(value*100)::BIGINT), 0)/100.0, 2) AS total, count(DISTINCT user_id) AS users, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1", digits=2)
def a33(t):
    stamp = F.col("ts").cast("timestamp")
    rows = t.events.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(F.round(F.col("value") * 100).cast("long")), F.lit(0)) / 100).alias("total"), F.countDistinct("user_id").alias("users"), F.datediff(F.max(stamp), F.min(stamp)).cast("long").alias("days"))


@query("a37_leak_audit", "WITH f AS (SELECT o_custkey % 20 AS bucket, o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) SELECT bucket, max(k) AS top, count(*) AS n, array_to_string(list_sort(list(o_custkey))[1:8], ',') AS samples FROM f GROUP BY 1")
def a37(t):
    one = t.orders.groupBy((F.col("o_custkey") % 20).alias("bucket"), "o_custkey").agg(F.min("o_orderkey").alias("k"))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy("o_custkey"))
    some = F.array_sort(F.collect_list(F.when(F.col("n") <= 8, F.col("o_custkey"))))
    return one.withColumn("n", n).groupBy("bucket").agg(F.max("k").alias("top"), F.count(F.lit(1)).alias("rows"), F.array_join(some, ",").alias("samples")).withColumnRenamed("rows", "n")


@query("a39_year_histogram", "SELECT coalesce(CASE WHEN o_custkey % 11 <> 0 THEN year(o_orderdate)::VARCHAR END, 'none') AS year, count(*) AS n FROM orders GROUP BY 1")
def a39(t):
    return t.orders.groupBy(F.coalesce(F.when(F.col("o_custkey") % 11 != 0, F.year("o_orderdate").cast("string")), F.lit("none")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("a42_bucket_validation", "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT CASE WHEN k <= ceil(n*0.2) THEN 'top20' WHEN k > n - ceil(n*0.2) THEN 'bottom20' ELSE 'mid60' END AS bucket, count(*) AS rows_n, round(avg((o_orderstatus='O')::INT), 6) AS rate FROM r GROUP BY 1")
def a42(t):
    rows = ranks.row_number(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "k")
    rows = ranks.with_totals(rows, F.count(F.lit(1)).alias("n"), of=t.orders)
    fifth = F.ceil(F.col("n") * 0.2)
    return rows.groupBy(F.when(F.col("k") <= fifth, "top20").when(F.col("k") > F.col("n") - fifth, "bottom20").otherwise("mid60").alias("bucket")).agg(F.count(F.lit(1)).alias("rows_n"), F.avg((F.col("o_orderstatus") == "O").cast("int")).alias("rate"))


_LABELLED = "s AS (SELECT l.doc_id, l.quality AS y, d.n_chars AS v FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"


def _labelled(t):
    return t.labels.filter("quality is not null").join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("n_chars").alias("v"))


@query("a45_auc", f"WITH {_LABELLED}, r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1)/2.0 AS rk FROM s) SELECT count(*) FILTER (y=1) AS positives, count(*) FILTER (y=0) AS negatives, round((sum(rk) FILTER (y=1) - count(*) FILTER (y=1)*(count(*) FILTER (y=1)+1)/2.0)/(count(*) FILTER (y=1)*count(*) FILTER (y=0)), 6) AS auc FROM r")
def a45(t):
    return stats.auc(_labelled(t), "v", "y")


@query("a46_m18_delong", f"WITH {_LABELLED}, p AS (SELECT a.y, a.doc_id, avg(CASE WHEN b.v < a.v THEN 1.0 WHEN b.v = a.v THEN 0.5 ELSE 0 END) AS w FROM s a JOIN s b ON a.y <> b.y GROUP BY 1, 2), q AS (SELECT y, CASE WHEN y = 1 THEN w ELSE 1 - w END AS w FROM p) SELECT round(avg(w) FILTER (y=1), 6) AS auc, round(var_samp(w) FILTER (y=1)/count(*) FILTER (y=1) + var_samp(w) FILTER (y=0)/count(*) FILTER (y=0), 6) AS variance, round(sqrt(var_samp(w) FILTER (y=1)/count(*) FILTER (y=1) + var_samp(w) FILTER (y=0)/count(*) FILTER (y=0)), 6) AS std_error FROM q")
def a46(t):
    return stats.delong(_labelled(t), "v", "y")


@query("a47_average_precision", f"WITH {_LABELLED}, r AS (SELECT *, row_number() OVER (ORDER BY v DESC, doc_id) AS k FROM s), c AS (SELECT y, sum(y) OVER (ORDER BY k)*1.0/k AS p FROM r) SELECT round(avg(p) FILTER (y=1), 6) AS average_precision FROM c")
def a47(t):
    return stats.average_precision(_labelled(t), "v", "y", "doc_id")


@query("a48_lift", f"WITH {_LABELLED}, r AS (SELECT *, row_number() OVER (ORDER BY v DESC, doc_id) AS k, count(*) OVER () AS n, avg(y) OVER () AS base, sum(y) OVER () AS total FROM s) SELECT f AS top_share, count(*) AS n, round(avg(y), 6) AS precision, round(avg(y)/max(base), 6) AS lift, round(sum(y)*1.0/max(total), 6) AS capture FROM r JOIN (VALUES (0.1::DOUBLE), (0.2), (0.3)) d(f) ON k <= ceil(n*f) GROUP BY 1")
def a48(t):
    return stats.lift_at(_labelled(t), "v", "y", "doc_id", (0.1, 0.2, 0.3))


_CUT = "(SELECT count(*) AS n, count(DISTINCT v) AS vals, avg(y) FILTER (v <= lo) AS bottom_rate, avg(y) FILTER (v >= hi) AS top_rate, sum(y*(below + (same - 1)/2.0 + 1)) AS ranks, sum(y) AS p FROM (SELECT *, quantile_cont(v, 0.2) OVER () AS lo, quantile_cont(v, 0.8) OVER () AS hi, rank() OVER (ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY v) AS same FROM (SELECT {c}::DOUBLE AS v, y FROM s)))"


@query("a49_drivers", f"WITH s AS (SELECT l.quality AS y, d.n_chars, length(d.source) AS source_chars, l.doc_id % 7 AS other FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL), u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, * FROM {_CUT.format(c=c)}" for c in ('n_chars', 'source_chars', 'other'))}) SELECT feature, n, round((ranks - p*(p + 1)/2.0)/(p*(n - p)), 6) AS auc, round(bottom_rate, 6) AS bottom_rate, round(top_rate, 6) AS top_rate, round(top_rate - bottom_rate, 6) AS difference FROM u WHERE n >= 50 AND vals >= 5")
def a49(t):
    met = t.labels.filter("quality is not null").join(t.documents.select("doc_id", "n_chars", "source"), "doc_id")
    rows = met.select(F.col("quality").alias("y"), "n_chars", F.length("source").alias("source_chars"), (F.col("doc_id") % 7).alias("other"))
    return stats.drivers(rows, ["n_chars", "source_chars", "other"], "y")


@query("a50_paired_difference", "WITH p AS (SELECT o_custkey, avg(round(o_totalprice)::BIGINT) FILTER (o_orderstatus='F') AS f, avg(round(o_totalprice)::BIGINT) FILTER (o_orderstatus='O') AS o FROM orders GROUP BY 1) SELECT o_custkey, round(f - o, 6) AS diff FROM p WHERE f IS NOT NULL AND o IS NOT NULL")
def a50(t):
    rows = t.orders.withColumn("v", F.round("o_totalprice").cast("long")).groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.avg("v"))
    return rows.filter("F is not null and O is not null").select("o_custkey", (F.col("F") - F.col("O")).alias("diff"))


@query("a51_e22_cluster_bootstrap")
def a51(t):
    """Replicate means of a cluster bootstrap; the weights come from a hash that DuckDB lacks."""
    groups = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    draws = stats.bootstrap_means(groups, "o_custkey", "total", "n", 200, 11)
    return draws.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.5).alias("mid"), F.percentile("mean", 0.975).alias("high"), F.count(F.lit(1)).alias("replicates"))


@query("a52_holm", "WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 101)/1010.0::DOUBLE AS p FROM supplier), s AS (SELECT *, least(1.0, p*(count(*) OVER () - row_number() OVER (ORDER BY p, s_suppkey) + 1)) AS x FROM p) SELECT s_suppkey, round(p, 6) AS p, round(max(x) OVER (ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s")
def a52(t):
    return stats.holm_adjusted(t.supplier.select("s_suppkey", (F.col("s_suppkey") * 37 % 101 / 1010.0).alias("p")), "p", "s_suppkey")


@query("a53_a54_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def a54(t):
    return t.lineitem.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("w24_w25_w26_w27_ranks_and_bands", "WITH r AS (SELECT o_orderkey, year(o_orderdate)::INT AS y, o_totalprice, rank() OVER w + (count(*) OVER (PARTITION BY year(o_orderdate), o_totalprice) - 1)/2.0 AS rk, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders WINDOW w AS (PARTITION BY year(o_orderdate) ORDER BY o_totalprice)) SELECT o_orderkey, round(rk, 2) AS average_rank, round(rk/n, 6) AS pct, ceil(5*rk/n)::BIGINT AS quintile, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band FROM r")
def w24(t):
    rows = t.orders.withColumn("y", F.year("o_orderdate"))
    rk, n = stats.average_rank("o_totalprice", ["y"]), F.count(F.lit(1)).over(Window.partitionBy("y"))
    v = F.col("o_totalprice")
    return rows.select("o_orderkey", rk.cast("double").alias("average_rank"), (rk / n).alias("pct"), F.ceil(5 * rk / n).alias("quintile"), F.when(v < 50000, "low").when(v < 200000, "mid").otherwise("high").alias("band"))


@query("a54_merged_sketches", "SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS events, count(DISTINCT ts::DATE) AS batches, true AS count_close, true AS quartiles_close FROM events GROUP BY 1")
def a54_sketches(t):
    """Daily batches leave sketches behind; what is merged from them is held against exact counts and ranks.

    A distinct count is close within 3 %, four standard errors; a quantile if its rank is within 4 % of the rows.
    """
    daily = materialize(sketches.sketched(t.events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "event_id", "value"), "sketches")
    one = sketches.merged(daily, ["event_type"])
    guess = one.select(F.col("event_type").alias("kind"), "rows", sketches.distinct_estimate().alias("guess"), *[sketches.quantile_estimate(s).alias(f"q{k}") for k, s in enumerate((0.25, 0.5, 0.75))])
    met = t.events.join(checked_broadcast(guess), F.col("event_type") == F.col("kind"))
    known = F.count("value")
    close = [(F.count_if(F.col("value") < F.col(f"q{k}")) <= (s + 0.04) * known) & (F.count_if(F.col("value") <= F.col(f"q{k}")) >= (s - 0.04) * known) for k, s in enumerate((0.25, 0.5, 0.75))]
    exact = met.groupBy("event_type").agg(F.max("rows").alias("rows"), F.countDistinct("event_id").alias("events"), F.countDistinct(F.to_date("ts")).alias("batches"), F.max("guess").alias("guess"), (close[0] & close[1] & close[2]).alias("quartiles_close"))
    return exact.select("event_type", "rows", "events", "batches", (F.abs(F.col("guess") - F.col("events")) <= 0.03 * F.col("events") + 1).alias("count_close"), "quartiles_close")
