"""Composite queries: several operators in one plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plover.operators import joins, ranks
from plover.operators.timeseries import by_symbol, year_end
from plover.operators.candidates import contained_pairs, match_key
from plover.plans.registry import query
from plover.sources.tables import BENCHMARK_SQL, PRICES_SQL, benchmark_prices, prices


@query("e17_e13_event_assembly", f"""WITH {PRICES_SQL}, f AS (SELECT symbol, i, day, close, lead(close, 20) OVER s AS later, max(high) OVER (s ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS top FROM px WINDOW s AS (PARTITION BY symbol ORDER BY i)),
y AS (SELECT symbol, year(day)::INT AS year, max_by(close, day) AS year_close FROM px GROUP BY 1, 2)
SELECT f.symbol, f.i, round((later/f.close - 1)*100, 6) AS ret, round((top/f.close - 1)*100, 6) AS mfe, round((year_close/f.close - 1)*100, 6) AS to_year_end, later IS NULL AS open FROM f JOIN y ON y.symbol = f.symbol AND y.year = year(f.day)""")
def e17(t):
    series = prices(t.lineitem)
    rows = series.withColumns({"later": F.lead("close", 20).over(by_symbol()), "top": F.max("high").over(by_symbol().rowsBetween(1, 20))})
    ends = year_end(series).withColumnRenamed("symbol", "s")
    met = rows.join(ends, (F.col("symbol") == F.col("s")) & (F.year("day") == F.col("year")))
    pct = lambda x: (F.col(x) / F.col("close") - 1) * 100
    return met.select("symbol", "i", pct("later").alias("ret"), pct("top").alias("mfe"), pct("year_close").alias("to_year_end"), F.col("later").isNull().alias("open"))


@query("j37_w18_benchmark_leg", f"""WITH {PRICES_SQL}, {BENCHMARK_SQL}, f AS (SELECT symbol, i, day, close, lead(close, 20) OVER s AS later, lead(day, 20) OVER s AS later_day FROM px WINDOW s AS (PARTITION BY symbol ORDER BY i)),
e AS (SELECT * FROM f WHERE later IS NOT NULL)
SELECT e.symbol, e.i, round((later/close - 1)*100 - (b1.index_close/b0.index_close - 1)*100, 6) AS excess, later/close > b1.index_close/b0.index_close AS beats FROM e ASOF JOIN bench b0 ON b0.day <= e.day ASOF JOIN bench b1 ON b1.day <= e.later_day""")
def j37(t):
    bench = benchmark_prices(t.lineitem)
    rows = prices(t.lineitem).withColumns({"later": F.lead("close", 20).over(by_symbol()), "later_day": F.lead("day", 20).over(by_symbol())}).filter("later is not null").select("symbol", "i", "day", "close", "later", "later_day")
    one = joins.asof_dated(rows, bench, "day", "day", ["index_close"]).withColumnRenamed("index_close", "b0").filter("b0 is not null")
    two = joins.asof_dated(one, bench, "later_day", "day", ["index_close"]).withColumnRenamed("index_close", "b1").filter("b1 is not null")
    own, other = F.col("later") / F.col("close"), F.col("b1") / F.col("b0")
    return two.select("symbol", "i", ((own - 1) * 100 - (other - 1) * 100).alias("excess"), (own > other).alias("beats"))


@query("e25_a24_segment_study", "WITH r AS (SELECT o_orderkey, o_totalprice, o_orderstatus, year(o_orderdate)::INT AS y, rank() OVER w + (count(*) OVER (PARTITION BY year(o_orderdate), o_totalprice) - 1)/2.0 AS rk, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders WINDOW w AS (PARTITION BY year(o_orderdate) ORDER BY o_totalprice)) SELECT y, ceil(5*rk/n)::BIGINT AS quintile, count(*) AS events, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM r GROUP BY 1, 2")
def e25(t):
    from plover.operators.stats import average_rank

    rows = t.orders.withColumn("y", F.year("o_orderdate"))
    rank, n = average_rank("o_totalprice", ["y"]), F.count(F.lit(1)).over(Window.partitionBy("y"))
    return rows.withColumn("quintile", F.ceil(5 * rank / n)).groupBy("y", "quintile").agg(F.count(F.lit(1)).alias("events"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate"))


@query("e28_j36_rematch_counts", "SELECT CASE WHEN n.n_nationkey IS NOT NULL THEN 'matched' WHEN source LIKE 'src%' THEN 'unmatched_known_form' ELSE 'unmatched' END AS bucket, count(*) AS n FROM documents d LEFT JOIN nation n ON 'src' || n.n_nationkey = d.source AND n.n_nationkey >= 5 GROUP BY 1")
def e28(t):
    """Counts by outcome when unmatched rows meet a new master."""
    master = t.nation.filter("n_nationkey >= 5").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("alias"))
    met = t.documents.select("source").join(master, F.col("alias") == F.col("source"), "left")
    bucket = F.when(F.col("alias").isNotNull(), "matched").when(F.col("source").startswith("src"), "unmatched_known_form").otherwise("unmatched")
    return met.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("e31_detail_merge", "SELECT a.doc_id, CASE WHEN length(b.text) > length(a.text) THEN b.text ELSE a.text END = a.text AS kept_own, greatest(a.n_chars, coalesce(b.n_chars, 0)) AS n_chars FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1")
def e31(t):
    """Of two records the longer text wins and counts take the maximum."""
    rows = t.documents.select("doc_id", "text", "n_chars")
    more = t.documents.select((F.col("doc_id") - 1).alias("m_id"), F.col("text").alias("m_text"), F.col("n_chars").alias("m_chars"))
    met = rows.join(more, F.col("doc_id") == F.col("m_id"), "left")
    own = F.coalesce(F.length("m_text") <= F.length("text"), F.lit(True)) | (F.col("m_text") == F.col("text"))
    return met.select("doc_id", own.alias("kept_own"), F.greatest("n_chars", F.coalesce("m_chars", F.lit(0))).alias("n_chars"))


@query("e35_peak_scores_from_json", "WITH e AS (SELECT user_id, event_id, greatest(json_extract(props, '$.k')::BIGINT, json_extract(json_object('a', value), '$.a')::DOUBLE) AS peak, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL) SELECT user_id, event_id, round(peak, 4) AS peak FROM e WHERE n <= 3", digits=4)
def e35(t):
    """The greatest of two scores read from JSON, for each user's last three events."""
    rows = t.events.withColumn("a", F.from_json("props", "k double")["k"]).withColumn("b", F.from_json(F.to_json(F.struct("value")), "value double")["value"]).filter("a is not null")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc()))
    return rows.withColumn("n", n).filter("n <= 3").select("user_id", "event_id", F.greatest("a", "b").alias("peak"))


@query("e41_e47_alias_table", "SELECT DISTINCT s_nationkey AS company, lower(s_name) AS alias FROM supplier WHERE length(s_name) >= 4")
def e41(t):
    rows = t.supplier.select(F.col("s_nationkey").alias("company"), F.lower("s_name").alias("alias")).filter(F.length("alias") >= 4)
    return rows.groupBy("company", "alias").agg(F.count(F.lit(1)).alias("n")).drop("n")


@query("e49_mutual_containment", "WITH n AS (SELECT DISTINCT 'The ' || p_name || ' ' || p_size // 10 AS selected, replace(lower('The ' || p_name || ' ' || p_size // 10), ' ', '') AS a FROM part UNION SELECT DISTINCT p_name, replace(lower(p_name), ' ', '') FROM part), m AS (SELECT p_partkey, replace(lower(p_name || ' ' || p_size), ' ', '') AS b FROM part) SELECT selected, count(p_partkey) AS companies, coalesce(min(p_partkey), -1) AS hit, CASE WHEN min(p_partkey) IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status FROM n LEFT JOIN m ON contains(a, b) OR contains(b, a) GROUP BY 1")
def e49(t):
    """Selected names against the whole master, either of which may contain the other once normalised."""
    whole = F.concat_ws(" ", F.lit("The"), "p_name", F.floor(F.col("p_size") / 10).cast("string"))
    names = t.part.select(whole.alias("selected")).union(t.part.select("p_name")).distinct().withColumn("a", match_key(F.col("selected")))
    master = t.part.select("p_partkey", match_key(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("b"))
    one, two = names.select(F.col("a").alias("inner")), master.select(F.col("b").alias("inner"))
    held = contained_pairs(one, two.withColumnRenamed("inner", "outer")).select(F.col("inner").alias("x"), F.col("outer").alias("y"))
    pairs = held.unionByName(contained_pairs(two, one.withColumnRenamed("inner", "outer")).select(F.col("outer").alias("x"), F.col("inner").alias("y"))).distinct()
    met = names.join(pairs, F.col("a") == F.col("x"), "left").join(master, F.col("y") == F.col("b"), "left")
    hit = F.min("p_partkey")
    return met.groupBy("selected").agg(F.count("p_partkey").alias("companies"), F.coalesce(hit, F.lit(-1)).alias("hit"), F.when(hit.isNull(), "NOT_FOUND").otherwise("FOUND").alias("status"))


@query("e15_j38_cap_estimates", f"WITH {PRICES_SQL}, l AS (SELECT symbol, max_by(close, i) AS last FROM px GROUP BY 1) SELECT px.symbol, px.i, round(1000000*close/last, 4) AS cap FROM px JOIN l USING (symbol)", digits=4)
def e15(t):
    series = prices(t.lineitem)
    last = series.groupBy(F.col("symbol").alias("s")).agg(F.max_by("close", "i").alias("last"))
    return series.join(last, F.col("symbol") == F.col("s")).select("symbol", "i", (1000000 * F.col("close") / F.col("last")).alias("cap"))


@query("e11_event_window_union", "SELECT event_id, user_id, 'curated' AS origin FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, user_id, 'read' FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type <> 'error'")
def e11(t):
    """Curated events, and those of a window of dates that aren't among them."""
    curated = t.events.filter("event_type = 'error'").select("event_id", "user_id", F.lit("curated").alias("origin"))
    inside = F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz") - F.expr("interval 1 microsecond"))
    found = t.events.filter(inside).select("event_id", "user_id", F.lit("read").alias("origin"))
    return curated.unionByName(found.join(curated, "event_id", "left_anti"))


@query("e21_e23_e24_report", f"WITH {PRICES_SQL}, f AS (SELECT symbol, floor((lead(close, 20) OVER (PARTITION BY symbol ORDER BY i) - close)*10000/close)::BIGINT AS r FROM px), g AS (SELECT symbol, count(r) AS n, avg(r) AS mean FROM f GROUP BY 1) SELECT symbol, n, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean DESC, symbol) AS place FROM g WHERE n > 0")
def e21(t):
    ahead = F.floor((F.lead("close", 20).over(by_symbol()) - F.col("close")) * 10000 / F.col("close"))
    means = prices(t.lineitem).withColumn("r", ahead).groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mean")).filter("n > 0")
    return ranks.row_number(means, [F.col("mean").desc(), F.col("symbol")])


@query("t08_diverse_pick")
def t08(t):
    """Per language five documents of different events, from new sources first, of all documents; tests hold the fold against plain Python."""
    from plover.operators.text import diverse_pick

    rows = t.documents.select("lang", "doc_id", F.col("n_chars").cast("double").alias("score"), F.col("source").alias("domain"), F.lower("text").alias("title"))
    return diverse_pick(rows, "lang", 5).select("lang", "place", "doc_id")
