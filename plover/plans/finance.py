"""Queries on companies and their figures: sizes on a date, corrections of pay, scores of patents, a model against the index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plover.operators import joins, models, stats
from plover.operators.quantiles import quantiles
from plover.operators.scoring import Profile, Technology, best_profile, compact_text, technology_score
from plover.plans.registry import query
from plover.session import materialize
from plover.sources.tables import BENCHMARK_SQL, PRICES_SQL, benchmark_prices, prices

_SIZES_SQL = """sizes AS (SELECT o_custkey AS cust, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE o_orderdate::DATE END AS known, max(round(o_totalprice)::BIGINT)*1000 AS cap FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY 1, 2),
e AS (SELECT o_orderkey, o_custkey AS cust, o_orderdate::DATE AS day FROM orders)"""


@query("j13_sizes_with_lookahead", f"""WITH {_SIZES_SQL}, best AS (SELECT o_orderkey, arg_max(cap, coalesce(known, DATE '0001-01-01')) AS cap, max(known) AS known, count(*) AS n FROM e JOIN sizes USING (cust) WHERE known IS NULL OR known <= day GROUP BY 1),
held AS (SELECT DISTINCT cust FROM sizes)
SELECT e.o_orderkey, cap, CASE WHEN n IS NOT NULL AND known IS NULL THEN 'static_lookahead_risk' WHEN n IS NOT NULL THEN 'point_in_time' WHEN h.cust IS NOT NULL THEN 'future_row_rejected' ELSE 'missing' END AS source,
    CASE WHEN cap IS NULL THEN '' WHEN cap < 100000000 THEN 'small' WHEN cap < 300000000 THEN 'mid' ELSE 'large' END AS size FROM e LEFT JOIN best USING (o_orderkey) LEFT JOIN held h ON h.cust = e.cust""")
def j13_sizes(t):
    """The last size known on each order's day; one without a date is used but marked, and sizes of later days are turned away."""
    done = t.orders.filter("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '3-MEDIUM')").join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    known = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("o_orderdate").cast("date"))
    sizes = done.groupBy(F.col("o_custkey").alias("cust"), known.alias("known")).agg((F.max(F.round("o_totalprice").cast("long")) * 1000).alias("cap"))
    sizes = materialize(sizes, "sizes")
    events = t.orders.select("o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("date").alias("day"))
    dated = joins.sweep_join(events, sizes.filter("known is not null"), "cust", "day", "known", ["known"], ["cap"], "o_orderkey")
    static = sizes.filter("known is null").groupBy(F.col("cust").alias("s_cust")).agg(F.max("cap").alias("s_cap"))
    held = sizes.select(F.col("cust").alias("h_cust")).distinct()
    met = dated.join(static, F.col("cust") == F.col("s_cust"), "left").join(held, F.col("cust") == F.col("h_cust"), "left")
    source = F.when(F.col("cap").isNotNull(), "point_in_time").when(F.col("s_cap").isNotNull(), "static_lookahead_risk").when(F.col("h_cust").isNotNull(), "future_row_rejected").otherwise("missing")
    cap = F.coalesce("cap", "s_cap")
    return met.select("o_orderkey", cap.alias("cap"), source.alias("source"), F.when(cap.isNull(), "").when(cap < 100000000, "small").when(cap < 300000000, "mid").otherwise("large").alias("size"))


#: Hours of overtime a month that an industry is taken to have; 18 for others.
_HOURS = {"AUTOMOBILE": 24.0, "BUILDING": 22.0, "FURNITURE": 12.0, "MACHINERY": 20.0}


@query("w35_pay_corrections", f"""WITH hours AS (SELECT o_custkey, count(*)*1.5 - 4 AS overtime FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS pay, c_nationkey AS age, overtime, c_mktsegment AS industry FROM customer LEFT JOIN hours ON o_custkey = c_custkey),
fit AS (SELECT regr_slope(pay, age) AS slope, avg(age) AS mean_age FROM c WHERE pay > 0 AND age > 0),
a AS (SELECT *, pay - slope*(CASE WHEN age IS NULL OR age = 0 THEN mean_age ELSE age END - mean_age) AS age_adjusted, coalesce(overtime, CASE industry {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _HOURS.items())} ELSE 18.0 END) AS assumed FROM c, fit)
SELECT c_custkey, round(age_adjusted, 4) AS age_adjusted, round(assumed, 4) AS assumed, round(age_adjusted/(1 + greatest(assumed, 0)*12*1.25/1920*0.65), 4) AS without_overtime FROM a""", digits=4)
def w35_corrections(t):
    """Pay moved to the mean age along a line fitted to all, then without overtime, for which the industry's hours stand in."""
    hours = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg((F.count(F.lit(1)) * 1.5 - 4).alias("overtime"))
    rows = t.customer.join(hours, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("pay"), F.col("c_nationkey").alias("age"), "overtime", F.col("c_mktsegment").alias("industry"))
    fit = rows.filter("pay > 0 and age > 0").agg(F.regr_slope("pay", "age").alias("slope"), F.avg("age").alias("mean_age"))
    age = F.when(F.coalesce("age", F.lit(0)) == 0, F.col("mean_age")).otherwise(F.col("age"))
    fallback = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _HOURS.items() for x in pair]), F.col("industry")), F.lit(18.0))
    out = rows.crossJoin(F.broadcast(fit)).withColumn("age_adjusted", F.col("pay") - F.col("slope") * (age - F.col("mean_age"))).withColumn("assumed", F.coalesce("overtime", fallback))
    return out.select("c_custkey", "age_adjusted", "assumed", (F.col("age_adjusted") / (1 + F.greatest("assumed", F.lit(0.0)) * 12 * 1.25 / 1920 * 0.65)).alias("without_overtime"))


_PATENTS_SQL = """fam AS (SELECT sha256(text) AS family, count(*) AS size, count(DISTINCT lang) AS countries, count(DISTINCT source) AS applicants FROM documents GROUP BY 1),
cited AS (SELECT sha256(substr(text, 1, 40)) AS head, count(*) - 1 AS citations FROM documents GROUP BY 1),
pat AS (SELECT doc_id, source, text, size, countries, applicants, citations, length(text) - length(replace(text, '.', '')) AS claims, CASE WHEN contains(lower(text), 'license') THEN 'granted' WHEN contains(lower(text), 'the') THEN 'pending' ELSE '' END AS status
    FROM documents JOIN fam ON family = sha256(text) JOIN cited ON head = sha256(substr(text, 1, 40))),
scored AS (SELECT *, least(25, 7*log2(greatest(1, size))) + least(15, 4.0*countries) + least(25, 6*log2(1 + citations)) + least(15, 0.75*claims) + CASE WHEN contains(status, 'grant') THEN 12 WHEN status <> '' THEN 5 ELSE 0 END + CASE WHEN text = '' THEN 0 WHEN claims > 0 THEN 8 ELSE 4 END AS metadata FROM pat)"""


def _patents(t):
    """Documents as patents: copies are a family, texts of one beginning cite each other, sentences are claims, sources apply."""
    rows = t.documents.withColumns({"family": F.sha2("text", 256), "head": F.sha2(F.substring("text", 1, 40), 256)})
    families = rows.groupBy(F.col("family").alias("f")).agg(F.count(F.lit(1)).alias("size"), F.countDistinct("lang").alias("countries"), F.countDistinct("source").alias("applicants"))
    cited = rows.groupBy(F.col("head").alias("h")).agg((F.count(F.lit(1)) - 1).alias("citations"))
    low = F.lower("text")
    status = F.when(low.contains("license"), "granted").when(low.contains("the"), "pending").otherwise("")
    claims = F.length("text") - F.length(F.replace(F.col("text"), F.lit("."), F.lit("")))
    met = rows.join(families, F.col("family") == F.col("f")).join(cited, F.col("head") == F.col("h")).withColumns({"claims": claims, "status": status})
    detail = F.when(F.col("text") == "", 0.0).when(F.col("claims") > 0, 8.0).otherwise(4.0)
    legal = F.when(F.col("status").contains("grant"), 12.0).when(F.col("status") != "", 5.0).otherwise(0.0)
    score = F.least(F.lit(25.0), 7 * F.log2(F.greatest(F.lit(1), "size"))) + F.least(F.lit(15.0), 4.0 * F.col("countries")) + F.least(F.lit(25.0), 6 * F.log2(1 + F.col("citations"))) + F.least(F.lit(15.0), 0.75 * F.col("claims")) + legal + detail
    return met.withColumn("metadata", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


@query("n05_metadata_score", f"WITH {_PATENTS_SQL} SELECT doc_id, size AS family_size, countries, citations, claims::INT AS claims, status, round(greatest(0, least(100, metadata)), 6) AS score FROM scored")
def n05(t):
    return _patents(t).select("doc_id", F.col("size").alias("family_size"), "countries", "citations", F.col("claims").cast("int").alias("claims"), "status", F.col("metadata").alias("score"))


@query("n06_materiality", f"""WITH {_PATENTS_SQL}, caps AS (SELECT 'src' || c_nationkey AS company, sum(o_totalprice)*100000 AS cap FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 18 GROUP BY 1)
SELECT doc_id, CASE WHEN cap IS NULL THEN 'unmatched' WHEN cap < 3e12 THEN 'small' WHEN cap < 5e12 THEN 'mid' ELSE 'large' END AS band,
    round(CASE WHEN cap IS NULL THEN 0 ELSE greatest(0, least(100, (0.55*greatest(0, least(100, metadata)) + 0.45*50)*CASE WHEN cap < 3e12 THEN 1.25 WHEN cap < 5e12 THEN 1.0 ELSE 0.75 END*(0.65 + 0.35/greatest(1, applicants)))) END, 6) AS score FROM scored LEFT JOIN caps ON company = source""")
def n06(t):
    """Metadata and a neutral novelty, weighed by the company's size and its share of the applicants; 0 without a company."""
    nation = F.concat(F.lit("src"), F.col("c_nationkey").cast("string"))
    caps = t.orders.join(t.customer.filter("c_nationkey < 18"), F.col("c_custkey") == F.col("o_custkey")).groupBy(nation.alias("company")).agg((F.sum("o_totalprice") * 100000).alias("cap"))
    met = _patents(t).join(joins.checked_broadcast(caps), F.col("company") == F.col("source"), "left")
    band = F.when(F.col("cap").isNull(), "unmatched").when(F.col("cap") < 3e12, "small").when(F.col("cap") < 5e12, "mid").otherwise("large")
    factor = F.when(F.col("cap") < 3e12, 1.25).when(F.col("cap") < 5e12, 1.0).otherwise(0.75)
    score = (0.55 * F.col("metadata") + 0.45 * 50) * factor * (0.65 + 0.35 / F.greatest(F.lit(1), "applicants"))
    return met.select("doc_id", band.alias("band"), F.when(F.col("cap").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).alias("score"))


_TARGET = Technology(("THE", "AND"), ("IN",), ("T", "EN"), ("O", "DE"), ("with that", "license"), ("tion", "ing"), ("idiot", "password"))


@query("n04_technology_score", r"""WITH p AS (SELECT doc_id, lower(text) AS t, regexp_replace(lower(text), '[^0-9a-z\x{3040}-\x{30ff}\x{3400}-\x{9fff}]', '', 'g') AS k, list_transform(regexp_extract_all(substr(text, 1, 200), '[A-Za-z]{2,}')[1:5], lambda w: upper(w)) AS codes, CASE n_regionkey WHEN 0 THEN 'der' WHEN 1 THEN 'the' WHEN 2 THEN 'que' WHEN 3 THEN 'los' WHEN 4 THEN 'und' END AS tag
    FROM documents LEFT JOIN nation ON 'src' || n_nationkey = source),
h AS (SELECT *, (len(list_filter(codes, lambda c: starts_with(c, 'THE'))) > 0)::INT AS c1, (len(list_filter(codes, lambda c: starts_with(c, 'AND'))) > 0)::INT AS c2, (len(list_filter(codes, lambda c: starts_with(c, 'IN'))) > 0)::INT AS i1, (len(list_filter(codes, lambda c: starts_with(c, 'T'))) > 0)::INT AS b1, (len(list_filter(codes, lambda c: starts_with(c, 'EN'))) > 0)::INT AS b2,
    (len(list_filter(codes, lambda c: starts_with(c, 'O'))) > 0)::INT AS b3, (len(list_filter(codes, lambda c: starts_with(c, 'DE'))) > 0)::INT AS b4, (contains(t, 'with that') OR contains(k, 'withthat'))::INT + (contains(t, 'license') OR contains(k, 'license'))::INT AS kw, (contains(t, 'tion') OR contains(k, 'tion'))::INT + (contains(t, 'ing') OR contains(k, 'ing'))::INT AS bk,
    coalesce((contains(t, tag) OR contains(k, tag))::INT, 0) + CASE WHEN tag IS NOT NULL THEN (contains(t, 'for') OR contains(k, 'for'))::INT ELSE 0 END AS tg, contains(t, 'idiot')::INT + contains(t, 'password')::INT AS ex FROM p)
SELECT doc_id, round(greatest(0, least(100, CASE WHEN c1 + c2 > 0 THEN least(55, 35 + 7*(c1 + c2)) ELSE 0 END + CASE WHEN i1 > 0 THEN 12 ELSE 0 END + CASE WHEN b1 + b2 + b3 + b4 > 0 THEN least(30, 12 + 4*(b1 + b2 + b3 + b4)) ELSE 0 END + least(30, 6*kw) + least(24, 3*bk) + least(20, 5*tg) - least(50, 15*ex)))::DOUBLE, 4) AS score FROM h""")
def n04_technology(t):
    """Documents as patents whose first words are their codes; tags belong to the source's region."""
    found = F.regexp_extract_all(F.substring("text", 1, 200), F.lit("([A-Za-z]{2,})"), F.lit(1))
    region = F.element_at(F.array(*[F.lit(x) for x in ("der", "the", "que", "los", "und")]), F.col("n_regionkey") + 1)
    tags = F.when(F.col("n_regionkey").isNotNull(), F.array(region, F.lit("for")))
    makers = t.nation.select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("maker"), "n_regionkey")
    rows = t.documents.join(joins.checked_broadcast(makers), F.col("maker") == F.col("source"), "left").withColumns({"codes": found, "compact": compact_text(F.col("text"))})
    return rows.select("doc_id", technology_score(F.slice("codes", 1, 3), F.slice("codes", 4, 2), F.col("text"), F.col("compact"), tags, _TARGET).alias("score"))


_PROFILES = (
    Profile("english", required_groups=(("the", "that"),), strong=("of", "and", "with"), related=("for", "are", "was"), industry=("license",), categories=("en",), excluded=("idiot",)),
    Profile("german", required_title=("der", "die", "das"), strong=("und", "nicht"), related=("ist", "mit"), categories=("de",)),
    Profile("open", strong=("token", "secret"), related=("key",)),
)


def _hits_sql(where: str, terms: tuple[str, ...]) -> str:
    return "(" + (" + ".join(f"regexp_matches({where}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms) or "0") + ")"


def _profile_sql(p: Profile) -> str:
    """The score of one profile as SQL, from counts of hits."""
    band = lambda n, base, step, cap: f"CASE WHEN {n} > 0 THEN least({cap}, {base} + {step}*{n}) ELSE 0 END"
    either = " + ".join(f"(regexp_matches(t, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') OR regexp_matches(a, '(^|[^a-z0-9]){w}([^a-z0-9]|$)'))::INT" for w in p.strong + p.related)
    needs = [f"{_hits_sql('t', p.required_title)} > 0"] * bool(p.required_title) + [f"{_hits_sql('x', g)} > 0" for g in p.required_groups]
    parts = [
        "15" if needs else "0", f"CASE WHEN {_hits_sql('c', p.categories)} > 0 THEN 25 ELSE 0 END", band(_hits_sql("t", p.strong), 15, 5, 25), band(_hits_sql("a", p.strong), 8, 3, 20), band(_hits_sql("t", p.related), 5, 2, 10),
        band(_hits_sql("a", p.related), 3, 1, 10), f"CASE WHEN {either} >= 3 THEN 10 ELSE 0 END", band(_hits_sql("x", p.industry), 4, 2, 10), "CASE WHEN a <> '' THEN 5 ELSE 0 END", "-" + band(_hits_sql("x", p.excluded), 20, 5, 40),
    ]
    return f"CASE WHEN {' AND '.join(needs) or 'true'} THEN greatest(0, least(100, {' + '.join(parts)})) ELSE 0 END".replace("+ -", "- ")


@query("n13_paper_profiles", f"""WITH p AS (SELECT doc_id, lower(substr(text, 1, 60)) AS t, lower(substr(text, 61)) AS a, lower(substr(text, 1, 60)) || ' ' || lower(substr(text, 61)) AS x, lang AS c FROM documents),
s AS (SELECT doc_id, {', '.join(f'{_profile_sql(p)} AS s{k}' for k, p in enumerate(_PROFILES))} FROM p)
SELECT doc_id, greatest(s0, s1, s2)::DOUBLE AS score, CASE WHEN s0 >= greatest(s1, s2) THEN 'english' WHEN s1 >= s2 THEN 'german' ELSE 'open' END AS profile FROM s""")
def n13_profiles(t):
    """Each paper's best reader: required groups, strong and related terms in title and abstract, field, use, exclusions."""
    best = best_profile(F.substring("text", 1, 60), F.expr("substring(text, 61)"), F.col("lang"), _PROFILES)
    return t.documents.select("doc_id", best.alias("b")).select("doc_id", "b.score", "b.profile")


@query("m17_model_against_index", f"""WITH {PRICES_SQL}, {BENCHMARK_SQL}, f AS (SELECT symbol, i, day, volume, close, lead(close, 60) OVER s AS later, lead(day, 60) OVER s AS later_day FROM px WINDOW s AS (PARTITION BY symbol ORDER BY i)),
r AS (SELECT f.*, floor((later/close - 1)*1000000)::BIGINT AS stock, floor((b.index_close/a.index_close - 1)*1000000)::BIGINT AS idx FROM f JOIN bench a ON a.day = f.day JOIN bench b ON b.day = later_day WHERE later IS NOT NULL),
q AS (SELECT quantile_cont(volume, 0.8) AS cut FROM r), l AS (SELECT unnest(['all', CASE WHEN volume >= cut THEN 'top20' ELSE 'rest' END]) AS selection, stock, idx FROM r, q)
SELECT selection, count(*) AS events, round(avg(stock), 3) AS stock_mean, round(median(stock), 3) AS stock_median, round(avg(idx), 3) AS index_mean, round(avg(stock - idx), 3) AS excess_mean, round(avg((stock > idx)::INT), 6) AS outperformed, round(avg((stock < 0)::INT), 6) AS loss_rate, round(avg((stock >= 100000)::INT), 6) AS gain_rate FROM l GROUP BY 1""")
def m17(t):
    """What the top fifth by the model's score, here the volume, made in 60 rows, beside the index over the same days; in millionths."""
    by = Window.partitionBy("symbol").orderBy("i")
    rows = prices(t.lineitem).withColumns({"later": F.lead("close", 60).over(by), "later_day": F.lead("day", 60).over(by)}).filter("later is not null")
    index = materialize(benchmark_prices(t.lineitem).select("day", "index_close"), "index")
    first, last = (index.select(F.col("day").alias(f"{c}_day"), F.col("index_close").alias(f"{c}_index")) for c in "ab")
    met = rows.join(joins.checked_broadcast(first), F.col("day") == F.col("a_day")).join(joins.checked_broadcast(last), F.col("later_day") == F.col("b_day"))
    ppm = lambda a, b: F.floor((F.col(a) / F.col(b) - 1) * 1000000)
    met = materialize(met.select("volume", ppm("later", "close").alias("stock"), ppm("b_index", "a_index").alias("idx")), "returns")
    cut = quantiles(met, ["volume"], (0.8,)).select(F.col("q_volume")[0].alias("cut"))
    labels = F.array(F.lit("all"), F.when(F.col("volume") >= F.col("cut"), "top20").otherwise("rest"))
    long = met.crossJoin(F.broadcast(cut)).select(F.explode(labels).alias("selection"), "stock", "idx")
    s, x = F.col("stock"), F.col("idx")
    rate = lambda hit: F.avg(hit.cast("int"))
    more = [F.round(F.avg(s), 3).alias("stock_mean"), F.round(F.avg(x), 3).alias("index_mean"), F.round(F.avg(s - x), 3).alias("excess_mean"), rate(s > x).alias("outperformed"), rate(s < 0).alias("loss_rate"), rate(s >= 100000).alias("gain_rate")]
    out = quantiles(long, ["stock"], (0.5,), ["selection"], more)
    return out.select("selection", F.col("n_stock").alias("events"), "stock_mean", F.round(F.col("q_stock")[0], 3).alias("stock_median"), "index_mean", "excess_mean", "outperformed", "loss_rate", "gain_rate")


@query("m10_chronological_validation")
def m10(t):
    """A logistic model fitted to the first four fifths of the days and held against the base rate on the rest; the fit is iterative."""
    rows = t.orders.select(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("day"), (F.col("o_totalprice") / 100000).alias("v"), (F.year("o_orderdate") - 1995).cast("double").alias("k"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    rows = materialize(rows, "samples")
    cut = quantiles(rows, ["day"], (0.8,)).first()["q_day"][0]
    return models.validated_logistic(rows, ["v", "k"], "label", F.col("day") <= F.lit(cut))


@query("a15_industry_correlations", """WITH o AS (SELECT o_custkey, count(*) AS orders, sum(round(o_totalprice)::BIGINT) AS total FROM orders GROUP BY 1), m AS (SELECT c_mktsegment AS industry, c_acctbal AS y, orders, total FROM customer LEFT JOIN o ON o_custkey = c_custkey),
l AS (SELECT industry, unnest(['orders', 'total']) AS feature, unnest([orders::DOUBLE, total::DOUBLE]) AS x, y FROM m)
SELECT industry, feature, count(*) AS companies, count(x) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS med, round(CASE WHEN count(x) >= 10 AND min(x) < max(x) THEN corr(x, y) END, 4) AS pearson FROM l GROUP BY 1, 2""", digits=4)
def a15(t):
    """Figures of each industry and their correlation with the balance, with ten pairs at least."""
    orders = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("total"))
    met = t.customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_mktsegment").alias("industry"), F.col("c_acctbal").alias("y"), "orders", "total")
    long = materialize(met.unpivot(["industry", "y"], ["orders", "total"], "feature", "x"), "figures")
    y = F.when(F.col("x").isNotNull(), F.col("y"))
    r = F.when((F.count("x") >= 10) & (F.min("x") < F.max("x")), stats.pearson(F.col("x"), y))
    out = quantiles(long, ["x"], (0.5,), ["industry", "feature"], [F.count(F.lit(1)).alias("companies"), F.avg("x").alias("mean"), r.alias("pearson")])
    return out.select("industry", "feature", "companies", F.col("n_x").alias("n"), "mean", F.col("q_x")[0].alias("med"), "pearson")


@query("a19_collection_quality", """WITH d AS (SELECT d.*, l.doc_id IS NOT NULL AS labelled, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
same AS (SELECT count(*) FILTER (n > 1) AS groups, coalesce(sum(n - 1), 0) AS extra, max(n) AS largest FROM (SELECT count(*) AS n FROM documents GROUP BY text)),
ids AS (SELECT count(*) FILTER (n > 1) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id)),
s AS (SELECT count(*)::DOUBLE AS rows, count(DISTINCT doc_id)::DOUBLE AS distinct_ids, count(DISTINCT source)::DOUBLE AS sources, count(DISTINCT lang)::DOUBLE AS languages, count(*) FILTER (text IS NULL OR trim(text) = '')::DOUBLE AS blank_texts, count(*) FILTER (length(text) < 200)::DOUBLE AS short_texts, count(*) FILTER (length(text) > 10000)::DOUBLE AS long_texts,
    count(*) FILTER (source IS NULL)::DOUBLE AS no_source, count(*) FILTER (lang IS NULL)::DOUBLE AS no_language, count(*) FILTER (n_chars IS DISTINCT FROM length(text))::DOUBLE AS wrong_counts, count(*) FILTER (labelled)::DOUBLE AS labelled, count(*) FILTER (quality = 1)::DOUBLE AS good, count(*) FILTER (toxic = 1)::DOUBLE AS toxic, sum(n_chars)::DOUBLE AS characters, max(n_chars)::DOUBLE AS longest FROM d),
w AS (SELECT s.*, same.groups::DOUBLE AS copied_groups, extra::DOUBLE AS copies, largest::DOUBLE AS largest_group, ids.groups::DOUBLE AS repeated_ids, labelled/rows AS labelled_share, good/labelled AS good_share, toxic/labelled AS toxic_share, short_texts/rows AS short_share, extra/rows AS copy_share, characters/rows AS mean_length FROM s, same, ids)
SELECT metric, round(value, 6) AS value FROM w UNPIVOT (value FOR metric IN (COLUMNS(*)))""")
def a19(t):
    """Counts and rates of a collection, one row each."""
    n = F.count(F.lit(1))
    share = lambda c: F.count_if(c)
    met = t.documents.join(t.labels.select(F.col("doc_id").alias("l_id"), "quality", "toxic"), F.col("doc_id") == F.col("l_id"), "left")
    s = met.agg(
        n.alias("rows"), F.countDistinct("doc_id").alias("distinct_ids"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"),
        share(F.col("text").isNull() | (F.trim("text") == "")).alias("blank_texts"), share(F.length("text") < 200).alias("short_texts"), share(F.length("text") > 10000).alias("long_texts"),
        share(F.col("source").isNull()).alias("no_source"), share(F.col("lang").isNull()).alias("no_language"), share(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("wrong_counts"),
        share(F.col("l_id").isNotNull()).alias("labelled"), share(F.col("quality") == 1).alias("good"), share(F.col("toxic") == 1).alias("toxic"), F.sum("n_chars").alias("characters"), F.max("n_chars").alias("longest"),
    )
    groups = t.documents.groupBy(F.sha2("text", 256)).agg(n.alias("k")).agg(F.count_if(F.col("k") > 1).alias("copied_groups"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("copies"), F.max("k").alias("largest_group"))
    ids = t.documents.groupBy("doc_id").agg(n.alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated_ids"))
    w = s.crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(ids))  # a row each
    rates = {"labelled_share": ("labelled", "rows"), "good_share": ("good", "labelled"), "toxic_share": ("toxic", "labelled"), "short_share": ("short_texts", "rows"), "copy_share": ("copies", "rows"), "mean_length": ("characters", "rows")}
    w = w.withColumns({c: F.try_divide(F.col(a), F.col(b)) for c, (a, b) in rates.items()})
    w = w.select(*[F.col(c).cast("double").alias(c) for c in w.columns])
    return w.unpivot([], w.columns, "metric", "value").filter("value is not null")
