"""State queries: upserts, ledgers, cooldowns, merges, outboxes, budgets, alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plover.operators import backfill
from plover.operators import state as st
from plover.operators.timeseries import greedy_cooldown
from plover.plans.registry import query


@query("d02_d10_insert_or_ignore", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT p_partkey, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def d10(t):
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return st.insert_or_ignore(old, t.part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")), ["k"])


@query("d03_d19_d20_ledger", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def d03(t):
    done = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).join(done, "o_orderkey", "left_anti").select("o_orderkey")


@query("d04_corroborated_windows", "SELECT event_type, time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, count(DISTINCT user_id) AS sources, count(DISTINCT floor(value)::BIGINT) AS titles, count(*) AS n, CASE WHEN max((user_id = 7)::INT) = 1 THEN 'trusted_source' ELSE 'independent_sources' END AS reason FROM events GROUP BY 1, 2 HAVING max((user_id = 7)::INT) = 1 OR (count(DISTINCT user_id) >= 2 AND count(DISTINCT floor(value)::BIGINT) >= 2)")
def d04(t):
    rows = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.floor("value").alias("title"))
    out = st.corroborated(rows, "event_type", "ts", "user_id", "title", 90, F.col("user_id") == 7)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("d05_alert_cooldown", """WITH RECURSIVE e AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT AS s FROM events WHERE event_type = 'click'), keep AS (SELECT user_id, min(s) AS k FROM e GROUP BY 1 UNION ALL SELECT keep.user_id, min(e.s) FROM keep JOIN e ON e.user_id = keep.user_id AND e.s >= keep.k + 21600 GROUP BY keep.user_id, keep.k) SELECT user_id, k AS s FROM keep""")
def d05(t):
    rows = t.events.filter("event_type = 'click'").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s")).distinct()
    return greedy_cooldown(rows, "user_id", "s", 21600, []).select("user_id", "s")


@query("d07_exponential_cooldown", "WITH r AS (SELECT event_id, user_id, (floor(value)::BIGINT % 3 = 0)::INT AS f, sum(1 - (floor(value)::BIGINT % 3 = 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT event_id, k::BIGINT AS failures, CASE WHEN k > 0 THEN least(240.0, 15*pow(2, k-1)) ELSE 0.0 END AS wait FROM s")
def d07(t):
    rows = t.events.select("event_id", "user_id", (F.floor("value") % 3 == 0).alias("failed"))
    return st.exponential_cooldown(rows, "user_id", "event_id", F.col("failed"), 15, 240).select("event_id", "failures", "wait")


@query("d09_s34_upsert", "SELECT coalesce(s_suppkey, p_partkey) AS k, coalesce(p_retailprice, s_acctbal) AS v, CASE WHEN coalesce(length(p_name), -1) > coalesce(length(s_name), -1) THEN p_name ELSE s_name END AS n FROM supplier FULL JOIN part ON p_partkey = s_suppkey")
def d09(t):
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_name").alias("n"))
    new = t.part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"), F.col("p_name").alias("n"))
    return st.upsert(old, new, ["k"], {"v": "new", "n": "longest"})


def _halves(t, key, **aggregates):
    """A table of users as known before 15 January, and what the later events bring."""
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    build = lambda rows: rows.groupBy(key).agg(*[v.alias(k) for k, v in aggregates.items()])
    return build(t.events.filter(early)), build(t.events.filter(~early))


@query("e36_digest_candidates", "SELECT user_id, max(value) AS best_score, min(ts) AS first_seen, max(ts) AS last_seen, coalesce(max(event_id) FILTER (ts < TIMESTAMP '2024-01-15'), max(event_id)) AS run_id FROM events GROUP BY 1", digits=4)
def e36(t):
    """A candidate keeps its highest score, its first and last time and the run that first brought it."""
    old, new = _halves(t, "user_id", best_score=F.max("value"), first_seen=F.min("ts"), last_seen=F.max("ts"), run_id=F.max("event_id"))
    return st.upsert(old, new, ["user_id"], {"best_score": "max", "first_seen": "min", "last_seen": "max", "run_id": "old"})


@query("e37_minimal_store", "WITH h AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING max(o_totalprice) >= 200000) SELECT coalesce(c_custkey, o_custkey) AS k, c_name AS name, coalesce(h.top, c_acctbal) AS score, h.n AS seen FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN h ON o_custkey = c_custkey")
def e37(t):
    """Only rows above a threshold enter the store; names stay, scores and counts follow the newest run."""
    old = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), F.lit(None).cast("long").alias("seen"))
    high = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("seen"), F.max("o_totalprice").alias("score")).filter("score >= 200000")
    return st.upsert(old, high.withColumn("name", F.lit(None).cast("string")), ["k"], {"name": "fill", "score": "new", "seen": "new"})


@query("e38_window_records", "WITH w AS (SELECT ts::DATE AS day, event_type, event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY ts::DATE) AS errors FROM events) SELECT day, count(*) AS records, max(errors) AS errors, CASE WHEN max(errors) > 60 THEN 'retry' ELSE 'done' END AS status, min(event_id) FILTER (event_type = 'error') AS first_retry FROM w GROUP BY 1")
def e38(t):
    """One status row per window; a window with many errors is queued again once, under its first error."""
    error = F.col("event_type") == "error"
    rows = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("records"), F.count_if(error).alias("errors"), F.min(F.when(error, F.col("event_id"))).alias("first_retry"))
    return rows.withColumn("status", F.when(F.col("errors") > 60, "retry").otherwise("done"))


@query("e39_search_state", "SELECT user_id, max(ts) AS last_attempt, max(ts) FILTER (event_type <> 'error') AS last_success, max_by(CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END, struct_pack(a := ts, b := event_id)) AS error FROM events GROUP BY 1")
def e39(t):
    """A failed attempt keeps the time of the last good one."""
    ok = F.when(F.col("event_type") != "error", F.col("ts"))
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_attempt"), F.max(ok).alias("last_success"), F.max_by(F.when(F.col("event_type") == "error", "failed").otherwise(""), F.struct("ts", "event_id")).alias("error"))


@query("s36_d08_paper_sources", "WITH r AS (SELECT doc_id, source, lang, text, sha256(coalesce(text, '')) AS paper FROM documents) SELECT source, doc_id AS source_id, paper, count(*) OVER (PARTITION BY paper) AS records, min(doc_id) OVER (PARTITION BY paper) AS paper_id, CASE WHEN row_number() OVER (PARTITION BY paper ORDER BY doc_id) = 1 THEN 'inserted' ELSE 'merged' END AS outcome FROM r")
def s36(t):
    """Every source record with the paper that it belongs to: the first one of a paper inserts it, later ones merge."""
    rows = t.documents.select("source", F.col("doc_id").alias("source_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("paper"))
    papers = rows.groupBy(F.col("paper").alias("p")).agg(F.count(F.lit(1)).alias("records"), F.min("source_id").alias("paper_id"))
    outcome = F.when(F.col("source_id") == F.col("paper_id"), "inserted").otherwise("merged")
    return rows.join(papers, F.col("paper") == F.col("p")).select("source", "source_id", "paper", "records", "paper_id", outcome.alias("outcome"))


@query("d11_outbox", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01')")
def d11(t):
    queue = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey")
    sent = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    base = t.orders.filter(F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz")).select("o_orderkey")
    return st.pending(queue, sent, base, "o_orderkey")


_COSTS = "k AS (SELECT event_id, user_id, year(ts)::INT AS year, ts, length(props)*100 AS tokens_in, floor(value)::BIGINT AS tokens_out FROM events), c AS (SELECT *, (tokens_in*3 + tokens_out*15)*150 AS micro FROM k)"


def _costs(t):
    rows = t.events.select("event_id", "user_id", F.year("ts").alias("year"), "ts", (F.length("props") * 100).alias("tokens_in"), F.floor("value").alias("tokens_out"))
    return rows.withColumn("micro", (F.col("tokens_in") * 3 + F.col("tokens_out") * 15) * 150)  # millionths of a yen


@query("e33_cost_ledger", f"WITH {_COSTS} SELECT year, user_id, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(micro)::BIGINT/1000000.0, 6) AS yen FROM c GROUP BY 1, 2")
def e33(t):
    """Yearly ledger of calls, tokens and yen, from rates per million tokens and the exchange rate."""
    return _costs(t).groupBy("year", "user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (F.sum("micro") / 1000000).alias("yen"))


@query("d12_e34_budget", f"WITH {_COSTS}, r AS (SELECT *, sum(micro) OVER w AS spent, 2000000 AS reserve FROM c WINDOW w AS (PARTITION BY user_id, year ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, spent::BIGINT AS spent, spent + reserve <= 20000000 AS allowed FROM r")
def d12(t):
    """A call is allowed while what is spent and a reserve stay within the year's budget; once stopped, it stays so."""
    return st.within_budget(_costs(t), ["event_id"], "micro", 20000000 - 2000000, ["user_id", "year"]).select("event_id", "spent", "allowed")


@query("d13_d22_latest_state", "SELECT user_id, max_by(event_type, event_id) AS state, CASE WHEN max_by(event_type, event_id) = 'click' THEN 'interrupted' ELSE 'done' END AS status FROM events GROUP BY 1")
def d13(t):
    last = st.latest(t.events, ["user_id"], F.col("event_id").desc())
    return last.select("user_id", F.col("event_type").alias("state"), F.when(F.col("event_type") == "click", "interrupted").otherwise("done").alias("status"))


@query("d14_s25_e29_windows", "WITH g AS (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE AS day), p AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT g.day FROM g LEFT JOIN p USING (day) WHERE p.n IS NULL")
def d14(t):
    """Days of the whole period that no run has processed."""
    day = F.col("o_orderdate").cast("date")
    grid = t.orders.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return grid.join(t.orders.filter("o_orderstatus = 'P'").select(day.alias("day")), "day", "left_anti")


_CAPPED_SQL = """k AS (SELECT DISTINCT o_orderpriority AS k FROM orders), span AS (SELECT DATE '1998-12-31' AS last, date_diff('day', DATE '1992-01-01', DATE '1998-12-31') AS d),
daily AS (SELECT o_orderpriority AS k, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') AS off, count(*) AS n FROM orders GROUP BY ALL),
grid AS (SELECT k, off, sum(coalesce(n, 0)) OVER (PARTITION BY k ORDER BY off) AS upto FROM (SELECT k.k, t.off FROM k, span, range(0, d + 1) t(off)) LEFT JOIN daily USING (k, off)),
w(k, a, size) AS (SELECT k, c*64, 64 FROM k, span, range(0, d//64 + 1) t(c)
    UNION ALL SELECT w.k, w.a + h*(w.size//2), w.size//2 FROM w JOIN span ON true JOIN grid g1 ON g1.k = w.k AND g1.off = least(w.a + w.size - 1, d) LEFT JOIN grid g0 ON g0.k = w.k AND g0.off = w.a - 1 JOIN (VALUES (0), (1)) v(h) ON true
    WHERE w.size > 2 AND w.a <= d AND g1.upto - coalesce(g0.upto, 0) > 12),
n AS (SELECT w.*, d, last, g1.upto - coalesce(g0.upto, 0) AS n FROM w JOIN span ON true JOIN grid g1 ON g1.k = w.k AND g1.off = least(w.a + w.size - 1, d) LEFT JOIN grid g0 ON g0.k = w.k AND g0.off = w.a - 1 WHERE w.a <= d)"""


@query("d14_capped_windows", f"""WITH RECURSIVE {_CAPPED_SQL}
SELECT k AS o_orderpriority, row_number() OVER (PARTITION BY k ORDER BY a) AS place, (last - least(a + size - 1, d)::INT)::VARCHAR AS first_day, (last - a::INT)::VARCHAR AS last_day, n::BIGINT AS n, n > 12 AS capped FROM n WHERE n <= 12 OR size = 2""")
def d14_capped(t):
    """Backfill windows of each priority, newest first, halved from 64 days while a search would find more than 12 orders."""
    out = backfill.capped_windows(t.orders, t.orders.select("o_orderpriority"), "o_orderpriority", "o_orderdate", "1992-01-01", "1998-12-31", 12)
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("last_day")))
    return out.select("o_orderpriority", place.alias("place"), F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n", "capped")


@query("d20_next_dates", "WITH g AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY))::DATE AS day), p AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1) SELECT day, CASE WHEN n IS NULL THEN 'new' ELSE 'retry' END AS why FROM g LEFT JOIN p USING (day) WHERE n IS NULL OR errors*5 > n")
def d20(t):
    """The dates that a continuous walker visits next: never seen, or with too many errors."""
    grid = t.spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-10").cast("date"))).alias("day"))
    seen = t.events.groupBy(F.col("ts").cast("date").alias("d")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    met = grid.join(seen, F.col("day") == F.col("d"), "left").filter("n is null or errors * 5 > n")
    return met.select("day", F.when(F.col("n").isNull(), "new").otherwise("retry").alias("why"))


_BATCHES = "px AS (SELECT l_suppkey AS symbol, l_shipdate::DATE AS day, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2), old AS (SELECT * FROM px WHERE day < DATE '1997-06-01' AND symbol % 10 <> 0), lastd AS (SELECT symbol, max(day) AS last FROM old GROUP BY 1)"


@query("d17_incremental_refresh", f"WITH {_BATCHES}, n AS (SELECT px.*, last FROM px LEFT JOIN lastd USING (symbol) WHERE last IS NULL OR day > last) SELECT symbol, count(*) AS added, min(day) AS first_added, any_value(last) AS last_known, any_value(last) IS NOT NULL AS history_known, max(day) >= DATE '1998-11-01' AS complete FROM n GROUP BY 1")
def d17(t):
    """Only rows after a symbol's last known day are added; new symbols get their whole history."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("day")).agg(F.max("l_extendedprice").alias("close"))
    known = rows.filter((F.col("day") < F.lit("1997-06-01").cast("date")) & (F.col("symbol") % 10 != 0))
    added = st.newer_rows(known, rows, "symbol", "day")
    return added.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("added"), F.min("day").alias("first_added"), F.any_value("last_known").alias("last_known"),
        F.any_value("last_known").isNotNull().alias("history_known"), (F.max("day") >= F.lit("1998-11-01").cast("date")).alias("complete"),
    )


@query("d15_content_store", "SELECT sha256(text) AS content, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(*) AS observations FROM documents GROUP BY 1")
def d15(t):
    return st.seen_times(t.documents.select(F.sha2("text", 256).alias("content"), "doc_id"), ["content"], "doc_id")


@query("d21_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def d21(t):
    return t.events.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


@query("d23_status_delta", "SELECT event_id, event_type, previous FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE event_type IS DISTINCT FROM previous")
def d23(t):
    return st.status_changes(t.events, "user_id", "event_id", "event_type").select("event_id", "event_type", "previous")


@query("e12_refresh_gate", "SELECT user_id FROM events GROUP BY 1 HAVING date_diff('hour', max(ts), TIMESTAMP '2024-01-30 00:00:00') > 6")
def e12(t):
    newest = t.events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("at"))
    hours = F.floor(F.unix_timestamp(F.lit("2024-01-30 00:00:00").cast("timestamp")) / 3600) - F.floor(F.unix_timestamp("at") / 3600)
    return newest.filter(hours > 6).select("user_id")


@query("e32_review_cache_hit", "SELECT d.doc_id, l.quality IS NOT NULL AND d.doc_id % 3 <> 0 AS cached, CASE WHEN d.doc_id % 3 <> 0 THEN l.quality END AS review FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def e32(t):
    """A review counts only for the same service, id, model, prompt version and hash of the input.

    Every third text has changed since it was reviewed.
    """
    known = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "text"), "doc_id")
    as_key = lambda text: [F.lit("quality").alias("service"), F.lit("m1").alias("model"), F.lit("p1").alias("prompt"), F.sha2(text, 256).alias("input_hash")]
    cache = known.select("doc_id", *as_key(F.col("text")), F.col("quality").alias("review"))
    now = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    out = st.cached(t.documents.select("doc_id", *as_key(now)), cache, ["service", "doc_id", "model", "prompt", "input_hash"], "review")
    return out.select("doc_id", "cached", "review")


@query("e45_reviewer_gates", "SELECT event_id, CASE WHEN length(props) < 8 THEN 'no_evidence' WHEN value/200 < 0.75 THEN 'below_threshold' WHEN n > 5 THEN 'over_budget' ELSE 'review' END AS gate FROM (SELECT *, count(*) FILTER (value/200 >= 0.75 AND length(props) >= 8) OVER (PARTITION BY ts::DATE ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events)")
def e45(t):
    """Alerts that a reviewer is asked about: with evidence, a confidence of 0.75, and five a day at most."""
    good = (F.length("props") >= 8) & (F.col("value") / 200 >= 0.75)
    n = F.count_if(good).over(Window.partitionBy(F.col("ts").cast("date")).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    gate = F.when(F.length("props") < 8, "no_evidence").when(F.col("value") / 200 < 0.75, "below_threshold").when(n > 5, "over_budget").otherwise("review")
    return t.events.select("event_id", gate.alias("gate"))


@query("e43_daily_headlines", "WITH e AS (SELECT event_id, ts::DATE AS day, event_type, value FROM events), c AS (SELECT day, max_by(event_id, struct_pack(v := value, i := event_id)) AS pick FROM e WHERE event_type = 'purchase' AND day < DATE '2024-01-20' GROUP BY 1), f AS (SELECT day, max_by(event_id, struct_pack(v := value, i := -event_id)) AS pick FROM e GROUP BY 1) SELECT f.day, coalesce(c.pick, f.pick) AS event_id, CASE WHEN c.pick IS NULL THEN 'rules' ELSE 'cache' END AS origin FROM f LEFT JOIN c USING (day)")
def e43(t):
    """Each day's headline as selected and cached before, else by the rules."""
    rows = t.events.select("event_id", F.col("ts").cast("date").alias("day"), "event_type", "value")
    cache = rows.filter((F.col("event_type") == "purchase") & (F.col("day") < F.lit("2024-01-20").cast("date"))).groupBy(F.col("day").alias("d")).agg(F.max_by("event_id", F.struct("value", "event_id")).alias("chosen"))
    rules = rows.groupBy("day").agg(F.max_by("event_id", F.struct("value", (-F.col("event_id")).alias("m"))).alias("best"))
    return rules.join(cache, F.col("day") == F.col("d"), "left").select("day", F.coalesce("chosen", "best").alias("event_id"), F.when(F.col("chosen").isNull(), "rules").otherwise("cache").alias("origin"))


@query("e44_scout_new_minutes", "WITH m AS (SELECT date_trunc('minute', ts) AS stamp, event_type, user_id, event_id FROM events), done AS (SELECT DISTINCT stamp FROM m WHERE event_type = 'signup'), n AS (SELECT * FROM m WHERE stamp NOT IN (SELECT stamp FROM done) AND event_type IN ('error', 'click')), w AS (SELECT event_type, time_bucket(INTERVAL 90 MINUTE, stamp, TIMESTAMP '1970-01-01') AS window_start, count(DISTINCT user_id) AS sources, count(*) AS n FROM n GROUP BY 1, 2) SELECT event_type, window_start, sources, n FROM w WHERE sources >= 2")
def e44(t):
    """Stamps that no run has seen, the titles that a rule takes, then windows with two sources."""
    rows = t.events.withColumn("stamp", F.date_trunc("minute", F.col("ts").cast("timestamp"))).select("stamp", "event_type", "user_id", "event_id")
    new = rows.join(rows.filter("event_type = 'signup'").select("stamp"), "stamp", "left_anti").filter(F.col("event_type").isin("error", "click"))
    out = st.corroborated(new, "event_type", "stamp", "user_id", "event_id", 90, F.lit(False))
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "sources", "n")


@query("e46_interest_cache", "WITH w AS (SELECT user_id, count(*) AS points, max(ts) AS stamp, round(avg(value), 4) AS mean FROM events GROUP BY 1), age AS (SELECT *, date_diff('day', stamp::DATE, DATE '2024-02-03') AS days FROM w) SELECT c_custkey, CASE WHEN user_id IS NULL THEN 'missing' WHEN days <= 7 THEN 'cache' ELSE 'stale' END AS origin, CASE WHEN days <= 7 THEN mean END AS mean, CASE WHEN days <= 7 THEN points END AS points FROM customer LEFT JOIN age ON user_id = c_custkey", digits=4)
def e46(t):
    """Interest summaries that are at most seven days old are taken from the cache and joined to members."""
    cache = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.max("ts").alias("at"), F.round(F.avg("value"), 4).alias("mean"))
    met = t.customer.select("c_custkey").join(cache, F.col("user_id") == F.col("c_custkey"), "left")
    fresh = F.datediff(F.lit("2024-02-03").cast("date"), F.col("at").cast("date")) <= 7
    origin = F.when(F.col("user_id").isNull(), "missing").when(fresh, "cache").otherwise("stale")
    return met.select("c_custkey", origin.alias("origin"), F.when(fresh, F.col("mean")).alias("mean"), F.when(fresh, F.col("points")).alias("points"))


@query("e40_diagnosis_rules", "SELECT user_id, CASE WHEN avg(value) > 60 THEN 'critical' WHEN count(*) > 80 THEN 'busy' WHEN count(*) < 40 THEN 'quiet' ELSE 'normal' END AS status FROM events GROUP BY 1")
def e40(t):
    n, v = F.count(F.lit(1)), F.avg("value")
    return t.events.groupBy("user_id").agg(F.when(v > 60, "critical").when(n > 80, "busy").when(n < 40, "quiet").otherwise("normal").alias("status"))


@query("d01_event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def d01(t):
    from plover.streaming.windows import hourly_counts

    return hourly_counts(t.spark, f"{t.sf_dir}/events.parquet")


@query("d01_lookback_batches", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def d01_lookback(t):
    """Six batches of five days, each with the day before it read again; an event counts once."""
    from plover.session import scratch_path
    from plover.streaming.windows import lookback_counts, read_slices

    folder = scratch_path(t.spark, "slices")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    for k in range(6):
        first = -(10**6) if k == 0 else 5 * k - 1
        last = 10**6 if k == 5 else 5 * k + 4
        t.events.filter(day.between(first, last)).select("event_id", "ts", "event_type").coalesce(1).write.mode("append").parquet(folder)
    stream = read_slices(t.spark, folder, "event_id long, ts timestamp_ntz, event_type string")
    return lookback_counts(stream, scratch_path(t.spark, "windows"), scratch_path(t.spark, "windows-state"), "7 days")


@query("d06_interval_controller")
def d06(t):
    """The adaptive interval of each user, as a fold over the events in order; tests hold it against plain Python."""
    from plover.operators.controller import intervals

    rows = t.events.select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("event_type") == "error").alias("limited"))
    return intervals(rows)


@query("d16_d18_resume", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(sum(round(o_totalprice*100)::BIGINT)/100.0, 2) AS total, CASE WHEN year(any_value(o_orderdate)) <= 1994 THEN 'resumed' ELSE 'computed' END AS origin FROM orders GROUP BY 1", digits=2)
def d16(t):
    """Windows staged under the same settings are resumed; missing windows and those of other settings are computed.

    The years to 1994 were staged under these settings, 1995 under older ones.
    """
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    yearly = lambda rows: rows.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), (F.sum(cents) / 100).alias("total"))
    now, before = st.fingerprint({"version": 2, "unit": "cents"}), st.fingerprint({"version": 1, "unit": "cents"})
    year = F.year("o_orderdate")
    staged = st.stage(yearly(t.orders.filter(year <= 1994)), "year", now, st.new_stage(t.spark, "windows"))
    staged = st.stage(yearly(t.orders.filter(year == 1995)), "year", before, staged)
    done = st.staged_windows(t.spark, staged, now)
    rest = t.orders.withColumn("year", year).join(done.select("year").distinct(), "year", "left_anti")
    return done.withColumn("origin", F.lit("resumed")).unionByName(yearly(rest).withColumn("origin", F.lit("computed")))
