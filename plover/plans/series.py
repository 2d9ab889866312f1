"""Time-series and window queries over the supplier price series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plover.operators import ranks
from plover.operators import timeseries as ts
from plover.operators.joins import checked_broadcast
from plover.operators.quantiles import quantiles
from plover.plans.registry import query
from plover.sources.tables import BENCHMARK_SQL, PRICES_SQL, prices

#: The input series are noisy and short, so the thresholds are looser than the defaults.
RULES = ts.SignalRules(peak_window=200, least_history=80, drawdown=1.0, low_drawdown=2.0, peak_age=10, range_window=40, most_range=40.0, most_volatility=4.0, density_window=15, density=5, short_window=10, buffer=0.0, breakout_return=0.1, expansion_return=0.3, breakout_volume=0.6, expansion_volume=0.8, close_strength=0.3, confirm_after=2, hold=0.97, cooldown=60)

_FEATURES = f"""{PRICES_SQL},
r AS (SELECT *, (close / lag(close) OVER s) * 100 - 100 AS ret FROM px WINDOW s AS (PARTITION BY symbol ORDER BY i)),
ft AS (SELECT *, max(struct_pack(c := close, k := i)) OVER (s ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS pk, lag(close) OVER s AS previous,
    min(close) OVER (s ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS low_n, max(close) OVER (s ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS high_n,
    max(close) OVER (s ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS high_short, avg(abs(ret)) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS volatility,
    count(CASE WHEN volume > 0 THEN 1 END) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS known_volumes, avg(volume) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean_volume
    FROM r WINDOW s AS (PARTITION BY symbol ORDER BY i)),
st AS (SELECT *, coalesce(i > 80 AND ((1-previous/pk.c)*100 >= 1 OR (1-low_n/pk.c)*100 >= 2) AND i-pk.k >= 10 AND (high_n-low_n)/low_n*100 <= 40 AND volatility <= 4, false)::INT AS setup FROM ft),
sd AS (SELECT *, coalesce(sum(setup) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS setup_days FROM st),
lv AS (SELECT *, high_n*1.0 AS bl, high_short*1.0 AS el, CASE WHEN known_volumes = 20 AND volume > 0 THEN volume/mean_volume END AS vr, CASE WHEN high > low THEN (close-low)/(high-low) ELSE 0.0 END AS strength FROM sd),
tr AS (SELECT *, CASE WHEN setup_days >= 5 AND strength >= 0.3 AND close >= bl AND coalesce(ret,0) >= 0.1 AND vr >= 0.6 THEN 'volume_breakout' WHEN setup_days >= 5 AND strength >= 0.3 AND close >= el AND coalesce(ret,0) >= 0.3 AND vr >= 0.8 THEN 'volume_expansion' END AS trigger FROM lv),
cf AS (SELECT *, CASE trigger WHEN 'volume_breakout' THEN bl ELSE el END AS level, lead(i, 2) OVER s AS confirm_i, lead(day, 2) OVER s AS confirm_day, lead(close, 2) OVER s AS confirm_close, min(close) OVER (s ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS held_low FROM tr WINDOW s AS (PARTITION BY symbol ORDER BY i)),
cand AS (SELECT symbol, confirm_i, confirm_day, trigger, level, confirm_close FROM cf WHERE trigger IS NOT NULL AND confirm_i IS NOT NULL AND confirm_close >= close AND held_low >= level*0.97)
"""
_SIGNALS = f"""WITH RECURSIVE {_FEATURES},
keep AS (SELECT symbol, min(confirm_i) AS k FROM cand GROUP BY 1 UNION ALL SELECT keep.symbol, min(c.confirm_i) FROM keep JOIN cand c ON c.symbol = keep.symbol AND c.confirm_i >= keep.k + 60 GROUP BY keep.symbol, keep.k)
"""


@query("w01_clean_series", "SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice - 20000 AS close, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_partkey DESC) AS n FROM lineitem WHERE l_extendedprice > 20000) WHERE n = 1")
def w01(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") - 20000).alias("close"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey").alias("ingest"))
    return ts.clean_series(rows).withColumn("i", F.col("i").cast("long"))


@query("w02_moving_average", f"WITH {PRICES_SQL} SELECT symbol, i, round(CASE WHEN count(*) OVER w = 25 THEN avg(close) OVER w END, 6) AS ma25 FROM px WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)")
def w02(t):
    return prices(t.lineitem).select("symbol", "i", ts.moving_average("close", 25).alias("ma25"))


@query("w03_date_slice_s02", f"WITH {PRICES_SQL} SELECT symbol, day, close FROM px WHERE day BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'")
def w03(t):
    return prices(t.lineitem).filter(F.col("day").between("1995-03-01", "1995-06-30")).select("symbol", "day", "close")


@query("w04_daily_return", f"WITH {PRICES_SQL} SELECT symbol, i, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY i) * 100 - 100, 6) AS ret FROM px")
def w04(t):
    return prices(t.lineitem).select("symbol", "i", ts.daily_return().alias("ret"))


@query("w05_setup_detection", f"WITH {_FEATURES} SELECT symbol, i, (i - pk.k)::BIGINT AS peak_age, setup, setup_days FROM sd")
def w05(t):
    return ts.setups(prices(t.lineitem), RULES).select("symbol", "i", F.col("peak_age").cast("long").alias("peak_age"), "setup", "setup_days")


@query("w06_triggers", f"WITH {_FEATURES} SELECT symbol, i, trigger, round(level, 6) AS level FROM cf WHERE trigger IS NOT NULL")
def w06(t):
    found = ts.setup_triggers(prices(t.lineitem), RULES)
    return found.filter("trigger is not null").select("symbol", "i", "trigger", "level")


@query("w07_confirmation", f"WITH {_FEATURES} SELECT symbol, confirm_i, trigger FROM cand")
def w07(t):
    return ts.confirmed(prices(t.lineitem), RULES).select("symbol", "confirm_i", "trigger")


@query("w08_signals_with_cooldown", f"{_SIGNALS} SELECT c.symbol, c.confirm_i, c.confirm_day, c.trigger, round(c.level, 6) AS level, c.confirm_close FROM cand c JOIN keep ON keep.symbol = c.symbol AND keep.k = c.confirm_i")
def w08(t):
    return ts.signals(prices(t.lineitem), RULES)


@query("w09_signals_by_model", f"{_SIGNALS}, m AS (SELECT unnest([0.0, 300000.0, 600000.0]) AS least) SELECT least, c.trigger, count(*) AS n FROM cand c JOIN keep ON keep.symbol = c.symbol AND keep.k = c.confirm_i JOIN m ON c.confirm_close >= least GROUP BY ALL")
def w09(t):
    models = t.spark.createDataFrame([(0.0,), (300000.0,), (600000.0,)], "least double")
    found = ts.signals(prices(t.lineitem), RULES)
    return found.join(F.broadcast(models), F.col("confirm_close") >= F.col("least")).groupBy("least", "trigger").agg(F.count(F.lit(1)).alias("n"))


@query("w10_trough_since_peak", f"WITH {PRICES_SQL}, p AS (SELECT *, max(struct_pack(h := high, k := i)) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM px) SELECT symbol, i, pk.h AS peak_high, pk.k AS peak_i, min(low) OVER (PARTITION BY symbol, pk.k ORDER BY i) AS trough FROM p WHERE pk IS NOT NULL")
def w10(t):
    """Expanding peak of highs, and the running low since that peak, by peak segment."""
    peak = F.max(F.struct("high", "i")).over(ts.by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    rows = prices(t.lineitem).withColumn("pk", peak).filter("pk is not null")
    segment = Window.partitionBy("symbol", "pk.i").orderBy("i")
    return rows.select("symbol", "i", F.col("pk.high").alias("peak_high"), F.col("pk.i").alias("peak_i"), F.min("low").over(segment).alias("trough"))


@query("w11_best_of_modes", f"WITH {PRICES_SQL}, a AS (SELECT symbol, max(i) AS i, 'general' AS mode, 0 AS pref FROM px WHERE high > close GROUP BY 1 UNION ALL SELECT symbol, max(i), 'ipo', 1 FROM px WHERE volume > 30 GROUP BY 1) SELECT symbol, i, mode FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC, pref) AS n FROM a) WHERE n = 1")
def w11(t):
    rows = prices(t.lineitem)
    one = rows.filter("high > close").groupBy("symbol").agg(F.max("i").alias("i")).select("symbol", "i", F.lit("general").alias("mode"), F.lit(0).alias("pref"))
    two = rows.filter("volume > 30").groupBy("symbol").agg(F.max("i").alias("i")).select("symbol", "i", F.lit("ipo").alias("mode"), F.lit(1).alias("pref"))
    best = one.unionByName(two).groupBy("symbol").agg(F.max(F.struct("i", (-F.col("pref")).alias("p"), "mode")).alias("b"))
    return best.select("symbol", "b.i", "b.mode")


@query("w12_peak_warning", f"""WITH {PRICES_SQL}, f AS (SELECT *, min(close) OVER (s ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS low120, avg(close) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ma20, count(*) OVER (s ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS n FROM px WINDOW s AS (PARTITION BY symbol ORDER BY i))
SELECT symbol, i, round(60*least(1, greatest(0, (close/low120 - 1)*10)) + 40*least(1, greatest(0, (close/ma20 - 1)*50)), 4) AS heat, (close/low120 - 1)*10 >= 0.8 AS overheated FROM f WHERE n = 120""", digits=4)
def w12(t):
    low, mean, n = (F.min("close").over(ts.by_symbol().rowsBetween(-120, -1)), F.avg("close").over(ts.by_symbol().rowsBetween(-20, -1)), F.count(F.lit(1)).over(ts.by_symbol().rowsBetween(-120, -1)))
    rows = prices(t.lineitem).withColumns({"low120": low, "ma20": mean, "n": n}).filter("n = 120")
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    rise = (F.col("close") / F.col("low120") - 1) * 10
    return rows.select("symbol", "i", (60 * clamp(rise) + 40 * clamp((F.col("close") / F.col("ma20") - 1) * 50)).alias("heat"), (rise >= 0.8).alias("overheated"))


_LEADS = ", ".join(f"round((lead(close, {n}) OVER s / close - 1)*100, 6) AS ret_{n}, round(CASE WHEN lead(close, {n}) OVER s IS NOT NULL THEN (max(close) OVER (s ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)/close - 1)*100 END, 6) AS mfe_{n}, round(CASE WHEN lead(close, {n}) OVER s IS NOT NULL THEN (min(close) OVER (s ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)/close - 1)*100 END, 6) AS mae_{n}" for n in (5, 20, 60))


@query("w13_forward_returns", f"WITH {PRICES_SQL} SELECT symbol, i, {_LEADS} FROM px WINDOW s AS (PARTITION BY symbol ORDER BY i)")
def w13(t):
    out = ts.forward_metrics(prices(t.lineitem), (5, 20, 60))
    return out.select("symbol", "i", *[f"{k}_{n}" for n in (5, 20, 60) for k in ("ret", "mfe", "mae")])


@query("w14_w15_forward_by_highs_and_lows", f"WITH {PRICES_SQL} SELECT symbol, i, round(CASE WHEN lead(close, 126) OVER s IS NOT NULL THEN greatest(0, (max(high) OVER (s ROWS BETWEEN 1 FOLLOWING AND 126 FOLLOWING)/close - 1)*100) END, 6) AS best, round(CASE WHEN lead(close, 126) OVER s IS NOT NULL THEN least(0, (min(low) OVER (s ROWS BETWEEN 1 FOLLOWING AND 126 FOLLOWING)/close - 1)*100) END, 6) AS worst FROM px WINDOW s AS (PARTITION BY symbol ORDER BY i)")
def w14(t):
    out = ts.forward_metrics(prices(t.lineitem), (126,), "high", "low")
    best = F.when(F.col("mfe_126").isNotNull(), F.greatest(F.lit(0.0), "mfe_126"))
    return out.select("symbol", "i", best.alias("best"), F.when(F.col("mae_126").isNotNull(), F.least(F.lit(0.0), "mae_126")).alias("worst"))


@query("w16_post_signal_evaluation", f"""{_SIGNALS}, sg AS (SELECT c.* FROM cand c JOIN keep ON keep.symbol = c.symbol AND keep.k = c.confirm_i),
ev AS (SELECT sg.symbol, confirm_i, confirm_close, max(CASE WHEN i <= confirm_i THEN close END) AS peak, min(CASE WHEN i > confirm_i THEN close END) AS later_low FROM sg JOIN px ON px.symbol = sg.symbol GROUP BY 1, 2, 3)
SELECT symbol, confirm_i, round((later_low/confirm_close - 1)*100, 6) AS drop_pct, CASE WHEN later_low IS NULL THEN 'open' WHEN later_low/confirm_close >= 0.95 THEN 'bottom' WHEN later_low/confirm_close >= 0.85 THEN 'near' ELSE 'failed' END AS verdict FROM ev""")
def w16(t):
    series = prices(t.lineitem)
    met = ts.signals(series, RULES).select("symbol", "confirm_i", "confirm_close").join(series.select("symbol", "i", "close"), "symbol")
    out = met.groupBy("symbol", "confirm_i", "confirm_close").agg(F.min(F.when(F.col("i") > F.col("confirm_i"), F.col("close"))).alias("low"))
    ratio = F.col("low") / F.col("confirm_close")
    verdict = F.when(F.col("low").isNull(), "open").when(ratio >= 0.95, "bottom").when(ratio >= 0.85, "near").otherwise("failed")
    return out.select("symbol", "confirm_i", ((ratio - 1) * 100).alias("drop_pct"), verdict.alias("verdict"))


@query("w17_first_touch_limit", f"WITH {PRICES_SQL} SELECT a.symbol, a.i, min(b.i - a.i) FILTER (b.low <= a.close*0.9)::INT AS touch_after FROM px a LEFT JOIN px b ON b.symbol = a.symbol AND b.i BETWEEN a.i+1 AND a.i+20 GROUP BY 1, 2")
def w17(t):
    return ts.first_touch(prices(t.lineitem), 0.1, 20).select("symbol", "i", F.col("touch_after").cast("int").alias("touch_after"))


@query("w17_w18_holding_variants", f"""{_SIGNALS}, {BENCHMARK_SQL}, e AS (SELECT c.symbol, c.confirm_i AS pos, c.confirm_close AS price, c.confirm_day AS day FROM cand c JOIN keep ON keep.symbol = c.symbol AND keep.k = c.confirm_i),
ends AS (SELECT symbol, max_by(close, i) AS last FROM px GROUP BY 1), fin AS (SELECT max_by(index_close, day) AS index_last FROM bench),
reach AS (SELECT e.symbol, e.pos, min(p.i) AS reach_i FROM e JOIN px p ON p.symbol = e.symbol AND p.i >= e.pos AND p.low <= e.price*(1 - 0.1::DOUBLE) GROUP BY 1, 2),
based AS (SELECT e.*, b.index_close FROM e ASOF LEFT JOIN bench b ON b.day >= e.day),
hv AS (SELECT b.symbol, b.pos, reach_i, round((last/price - 1)*100, 2) AS immediate, CASE WHEN reach_i IS NOT NULL THEN round((last/(price*(1 - 0.1::DOUBLE)) - 1)*100, 2) END AS at_limit, round((last/d.close - 1)*100, 2) AS delayed, round((index_last/index_close - 1)*100, 2) AS "index"
    FROM based b JOIN ends USING (symbol) LEFT JOIN px d ON d.symbol = b.symbol AND d.i = b.pos + 20 LEFT JOIN reach q ON q.symbol = b.symbol AND q.pos = b.pos, fin),
long AS (SELECT symbol, pos, k, row_number() OVER (PARTITION BY symbol, pos ORDER BY v DESC, k) AS place FROM (SELECT symbol, pos, unnest([0, 1, 2, 3]) AS k, unnest([immediate, at_limit, delayed, "index"]) AS v FROM hv) WHERE v IS NOT NULL),
wide AS (SELECT symbol, pos, max(place) FILTER (k = 0) AS immediate_rank, max(place) FILTER (k = 1) AS at_limit_rank, max(place) FILTER (k = 2) AS delayed_rank, max(place) FILTER (k = 3) AS index_rank FROM long GROUP BY 1, 2)
SELECT hv.symbol || ':' || hv.pos AS event, hv.symbol, reach_i, immediate, at_limit, delayed, "index", immediate_rank::INT AS immediate_rank, at_limit_rank::INT AS at_limit_rank, delayed_rank::INT AS delayed_rank, index_rank::INT AS index_rank FROM hv JOIN wide USING (symbol, pos)""", digits=2)
def w17_variants(t):
    """Signals bought at once, at a limit, 20 rows later or in the index instead, ranked by what they made."""
    from plover.session import materialize
    from plover.sources.tables import benchmark_prices

    # The variants read prices and signals several times, so both are made once.
    series = materialize(prices(t.lineitem), "prices")
    events = ts.signals(series, RULES).select(F.concat_ws(":", "symbol", "confirm_i").alias("event"), "symbol", F.col("confirm_i").alias("at"), F.col("confirm_close").alias("price"), F.col("confirm_day").alias("day"))
    return ts.holding_variants(materialize(events, "signals"), series, benchmark_prices(t.lineitem), "event")


@query("w20_e16_year_end_returns", f"WITH {PRICES_SQL}, y AS (SELECT symbol, year(day)::INT AS year, max_by(close, day) AS year_close FROM px GROUP BY 1, 2) SELECT px.symbol, px.i, round((year_close/close - 1)*100, 6) AS to_year_end FROM px JOIN y ON y.symbol = px.symbol AND y.year = year(day)")
def w20(t):
    series = prices(t.lineitem)
    ends = ts.year_end(series).withColumnRenamed("symbol", "s")
    met = series.join(ends, (F.col("symbol") == F.col("s")) & (F.year("day") == F.col("year")))
    return met.select("symbol", "i", ((F.col("year_close") / F.col("close") - 1) * 100).alias("to_year_end"))


@query("w19_first_drop_after_peak", f"WITH {PRICES_SQL}, p AS (SELECT symbol, max(struct_pack(c := close, k := i)) AS pk FROM px GROUP BY 1) SELECT p.symbol, min(day) AS drop_day FROM p LEFT JOIN px ON px.symbol = p.symbol AND i > pk.k AND close <= pk.c*0.97 GROUP BY 1")
def w19(t):
    series = prices(t.lineitem)
    peaks = series.groupBy(F.col("symbol").alias("s")).agg(F.max(F.struct("close", "i")).alias("pk"))
    hit = F.when((F.col("i") > F.col("pk.i")) & (F.col("close") <= F.col("pk.close") * 0.97), F.col("day"))
    return series.join(peaks, F.col("symbol") == F.col("s")).groupBy("symbol").agg(F.min(hit).alias("drop_day"))


@query("w21_benchmark_horizon", f"WITH {BENCHMARK_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM bench) SELECT day, round((lead(index_close, 60) OVER (ORDER BY i)/index_close - 1)*100, 6) AS ret_60 FROM n")
def w21(t):
    from plover.sources.tables import benchmark_prices

    order = Window.partitionBy("market").orderBy("day")
    return benchmark_prices(t.lineitem).select("day", ((F.lead("index_close", 60).over(order) / F.col("index_close") - 1) * 100).alias("ret_60"))


@query("w22_liquidity", f"WITH {PRICES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS k FROM px) SELECT symbol, round(median(close*volume) FILTER (k <= 60), 4) AS median_value, max_by(close, i) AS last_close, count(*) AS n_rows FROM r GROUP BY 1", digits=4)
def w22(t):
    return ts.liquidity(prices(t.lineitem))


@query("w23_trend_summary", f"""WITH {PRICES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS k FROM px)
SELECT symbol, count(*) AS points, max_by(close, i) AS latest, round(avg(close) FILTER (k <= 4), 6) AS recent_avg, round(avg(close) FILTER (k BETWEEN 5 AND 8), 6) AS earlier_avg,
    round((avg(close) FILTER (k <= 4) - avg(close) FILTER (k BETWEEN 5 AND 8))/avg(close) FILTER (k BETWEEN 5 AND 8)*100, 6) AS change_pct, max(close) AS peak, round(max_by(close, i)/max(close), 6) AS latest_to_peak,
    round(regr_slope(close, -k) FILTER (k <= 4), 6) AS slope, round((max_by(close, i) - avg(close) FILTER (k BETWEEN 2 AND 53))/stddev_pop(close) FILTER (k BETWEEN 2 AND 53), 6) AS z_score, avg((close = 0)::INT) AS zero_share FROM r GROUP BY 1""")
def w23(t):
    return ts.trend_summary(prices(t.lineitem), "close")


@query("w29_share_of_history", """WITH h AS (SELECT s_nationkey AS g, s_acctbal AS v FROM supplier WHERE s_suppkey % 2 = 0), n AS (SELECT s_suppkey, s_nationkey AS g, s_acctbal AS v FROM supplier WHERE s_suppkey % 2 = 1)
SELECT s_suppkey, round(coalesce(100.0*(SELECT count(*) FROM h WHERE h.g = n.g AND h.v <= n.v)/nullif((SELECT count(*) FROM h WHERE h.g = n.g), 0), 100.0*(SELECT count(*) FROM h WHERE h.v <= n.v)/nullif((SELECT count(*) FROM h), 0), 50), 6) AS percentile FROM n""")
def w29(t):
    """Share of the frozen history at or below: of the group, else of all, else neutral.

    Counts come from one sorted union per level, not from a range join.
    """
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("v"), (F.col("s_suppkey") % 2 == 0).cast("int").alias("old"))
    old = F.col("old").cast("long")
    everywhere = ranks.by_value(rows, "v", {"o": old}).select(F.col("v").alias("av"), (F.col("below_o") + F.col("o")).alias("b"))
    upto, whole = Window.partitionBy("g").orderBy("v"), Window.partitionBy("g")
    out = rows.withColumns({"a": F.sum("old").over(upto), "an": F.sum("old").over(whole)}).filter("old = 0").join(everywhere, F.col("v") == F.col("av"))
    out = ranks.with_totals(out, F.sum("old").alias("bn"), of=rows)
    share = F.coalesce(F.try_divide(100.0 * F.col("a"), F.col("an")), F.try_divide(100.0 * F.col("b"), F.col("bn")), F.lit(50.0))
    return out.select("s_suppkey", share.alias("percentile"))


@query("w30_expanding_thresholds", "WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders) SELECT y.year, round(quantile_cont(o_totalprice, 0.8), 6) AS threshold, count(*) AS n FROM y JOIN orders ON year(o_orderdate) < y.year GROUP BY 1")
def w30(t):
    """Quantiles of all earlier years: each row goes to the later years, a handful."""
    orders = t.orders.select(F.year("o_orderdate").alias("y"), "o_totalprice")
    years = orders.select(F.col("y").alias("year")).distinct()
    out = quantiles(orders.join(checked_broadcast(years), F.col("y") < F.col("year")), ["o_totalprice"], (0.8,), ["year"], [F.count(F.lit(1)).alias("n")])
    return out.select("year", F.col("q_o_totalprice")[0].alias("threshold"), "n")


@query("w31_reversals", f"WITH {PRICES_SQL}, d AS (SELECT symbol, i, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY i)) AS d FROM px), m AS (SELECT symbol, (d <> lag(d) OVER (PARTITION BY symbol ORDER BY i))::INT AS turn FROM d WHERE d <> 0) SELECT symbol, coalesce(sum(turn), 0)::BIGINT AS reversals, count(*) AS moves FROM m GROUP BY 1")
def w31(t):
    return ts.sign_changes(prices(t.lineitem), "close")


@query("w35_slope_correction", "WITH s AS (SELECT regr_slope(c_acctbal, c_nationkey) AS b, avg(c_nationkey) AS m FROM customer) SELECT c_custkey, round(c_acctbal - b*(c_nationkey - m), 6) AS corrected FROM customer, s")
def w35(t):
    line = t.customer.agg(F.regr_slope("c_acctbal", "c_nationkey").alias("b"), F.avg("c_nationkey").alias("m"))
    return t.customer.crossJoin(F.broadcast(line)).select("c_custkey", (F.col("c_acctbal") - F.col("b") * (F.col("c_nationkey") - F.col("m"))).alias("corrected"))


@query("w36_search_order", "SELECT s_suppkey, row_number() OVER (ORDER BY (s_acctbal >= 0)::INT, s_nationkey, (s_suppkey - 37 + 1000) % 1000, s_suppkey) AS place FROM supplier")
def w36(t):
    rows = t.supplier.select("s_suppkey", (F.col("s_acctbal") >= 0).cast("int").alias("fine"), "s_nationkey", F.pmod(F.col("s_suppkey") - 37, F.lit(1000)).alias("turn"))
    return ranks.row_number(rows, ["fine", "s_nationkey", "turn", "s_suppkey"]).select("s_suppkey", "place")


@query("w37_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def w37(t):
    stamp = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t.events.withColumn("u", stamp)
    return rows.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("u").rangeBetween(-3_600_000_000, 0)).alias("n"))


@query("e51_daily_signals", f"""{_SIGNALS}, l AS (SELECT symbol, max(i) AS last_i, max(day) AS last_day FROM px GROUP BY 1), sg AS (SELECT c.symbol, max(c.confirm_i) AS signal_i FROM cand c JOIN keep ON keep.symbol = c.symbol AND keep.k = c.confirm_i GROUP BY 1)
SELECT l.symbol, last_day, signal_i, CASE WHEN last_day < DATE '1998-06-01' THEN 'inactive' WHEN signal_i IS NULL THEN 'none' WHEN last_i - signal_i <= 400 THEN 'fresh' ELSE 'old' END AS status FROM l LEFT JOIN sg USING (symbol)""")
def e51(t):
    """Each symbol's last signal, with whether the symbol is active and the signal fresh enough to be sent."""
    series = prices(t.lineitem)
    last = series.groupBy("symbol").agg(F.max("i").alias("last_i"), F.max("day").alias("last_day"))
    found = ts.signals(series, RULES).groupBy(F.col("symbol").alias("s")).agg(F.max("confirm_i").alias("signal_i"))
    met = last.join(found, F.col("symbol") == F.col("s"), "left")
    status = F.when(F.col("last_day") < F.lit("1998-06-01").cast("date"), "inactive").when(F.col("signal_i").isNull(), "none").when(F.col("last_i") - F.col("signal_i") <= 400, "fresh").otherwise("old")
    return met.select("symbol", "last_day", "signal_i", status.alias("status"))


_KINDS = f"""{_FEATURES}, ev AS (SELECT c.symbol, c.confirm_day AS day, c.trigger AS model, floor((p.close - c.confirm_close)*10000/c.confirm_close)::BIGINT AS ret FROM cand c LEFT JOIN px p ON p.symbol = c.symbol AND p.i = c.confirm_i + 60)"""


def _kinds(t):
    """Confirmed triggers as events of two models, with the return of the 60 rows after them in basis points."""
    series = prices(t.lineitem)
    later = series.select(F.col("symbol").alias("s"), F.col("i").alias("k"), F.col("close").alias("later"))
    found = ts.confirmed(series, RULES).select("symbol", "confirm_i", F.col("confirm_day").alias("day"), F.col("trigger").alias("model"), "confirm_close")
    met = found.join(later, (F.col("symbol") == F.col("s")) & (F.col("confirm_i") + 60 == F.col("k")), "left")
    return met.select("symbol", "day", "model", F.floor((F.col("later") - F.col("confirm_close")) * 10000 / F.col("confirm_close")).alias("ret"))


@query("e22_model_pairs", f"""WITH {_KINDS}, m AS (SELECT DISTINCT model FROM ev),
o AS (SELECT a.model AS a, m.model AS b, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM ev x WHERE x.symbol = a.symbol AND x.model = m.model AND x.day = a.day)) AS same_day,
    count(*) FILTER (EXISTS (SELECT 1 FROM ev x WHERE x.symbol = a.symbol AND x.model = m.model AND abs(date_diff('day', x.day, a.day)) <= 7)) AS near FROM ev a JOIN m ON m.model <> a.model GROUP BY 1, 2),
v AS (SELECT symbol, model, avg(ret) AS v FROM ev WHERE ret IS NOT NULL GROUP BY 1, 2), d AS (SELECT x.model AS a, y.model AS b, count(*) AS paired, avg(x.v - y.v) AS difference FROM v x JOIN v y ON x.symbol = y.symbol AND x.model <> y.model GROUP BY 1, 2)
SELECT a, b, n, same_day, near, round(near*1.0/n, 6) AS near_share, paired, round(difference, 4) AS difference FROM o LEFT JOIN d USING (a, b)""")
def e22_pairs(t):
    """How far two models find the same signals, and what each symbol made under one and the other."""
    from plover.operators import stats
    from plover.session import materialize

    events = materialize(_kinds(t), "events")
    pairs = stats.paired_differences(events, "model", "symbol", "ret").groupBy(F.col("a").alias("p_a"), F.col("b").alias("p_b")).agg(F.count(F.lit(1)).alias("paired"), F.round(F.avg("difference"), 4).alias("difference"))
    out = stats.model_overlaps(events, "model", "symbol", "day").join(pairs, (F.col("a") == F.col("p_a")) & (F.col("b") == F.col("p_b")), "left")
    return out.select("a", "b", "n", "same_day", "near", (F.col("near") / F.col("n")).alias("near_share"), "paired", "difference")


@query("e22_paired_intervals")
def e22_intervals(t):
    """Bootstrap intervals over symbols: of the paired differences, and of each model's median; the draws come from a hash that DuckDB lacks."""
    from plover.operators import stats
    from plover.operators.quantiles import quantiles
    from plover.session import materialize

    events = materialize(_kinds(t).filter("ret is not null"), "events")
    pairs = stats.paired_differences(events, "model", "symbol", "ret").withColumn("one", F.lit(1))
    means = stats.bootstrap_means(pairs, "cluster", "difference", "one", 500, 22, ["a", "b"]).select(F.concat_ws(" - ", "a", "b").alias("what"), F.col("mean").alias("v"))
    models = [r["model"] for r in events.select("model").distinct().limit(50).collect()]  # a model each, not rows
    for m in sorted(models):
        medians = stats.bootstrap_medians(events.filter(F.col("model") == m), "symbol", "ret", 200, 22)
        means = means.unionByName(medians.select(F.lit(f"median {m}").alias("what"), F.col("median").alias("v")))
    out = quantiles(materialize(means, "replicates"), ["v"], (0.025, 0.5, 0.975), ["what"])
    return out.select("what", F.col("n_v").alias("replicates"), *[F.col("q_v")[k].alias(c) for k, c in enumerate(("low", "mid", "high"))])
