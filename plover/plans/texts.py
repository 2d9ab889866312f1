"""Text and scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plover.operators import text as tx
from plover.plans.registry import query

_GRAMS = """g AS (SELECT p_partkey AS k, substr(s, i::INT, 3) AS gram, count(*) AS cnt FROM (SELECT p_partkey, regexp_replace(lower(p_name || p_type), '\\s', '', 'g') AS s FROM part), unnest(range(1, length(s) - 1)) u(i) GROUP BY ALL)"""


def _grams(t):
    return tx.char_grams(t.part, "p_partkey", F.concat("p_name", "p_type")).withColumnRenamed("p_partkey", "k")


@query("n01_char_grams", f"WITH {_GRAMS} SELECT k, gram, cnt FROM g")
def n01(t):
    return _grams(t)


_COS = f"""WITH {_GRAMS}, pr AS (SELECT p_partkey AS a, p_partkey - 1 AS b FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part)), nm AS (SELECT k, sqrt(sum(cnt*cnt)) AS n FROM g GROUP BY 1),
d AS (SELECT a, b, sum(x.cnt*y.cnt) AS dot FROM pr JOIN g x ON x.k = a JOIN g y ON y.k = b AND y.gram = x.gram GROUP BY 1, 2)
SELECT pr.a, pr.b, round(coalesce(dot/(na.n*nb.n), 0), 6) AS cosine FROM pr LEFT JOIN d USING (a, b) JOIN nm na ON na.k = pr.a JOIN nm nb ON nb.k = pr.b"""


def _cosines(t):
    keys = t.part.select("p_partkey")
    pairs = keys.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - 1).alias("b")).join(keys.select(F.col("p_partkey").alias("b")).hint("merge"), "b", "left_semi").select("a", "b")
    return tx.cosine_pairs(_grams(t), pairs, "k", "a", "b")


@query("n02_sparse_cosine", _COS)
def n02(t):
    return _cosines(t)


@query("n04_n13_keyword_scores", "SELECT doc_id, least(40, 15*(contains(t,'the')::INT + contains(t,'ing')::INT + contains(t,'tion')::INT)) + least(20, 10*(contains(t,'license')::INT + contains(t,'token')::INT)) - least(30, 30*contains(t,'idiot')::INT) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def n04(t):
    groups = {"strong": (("the", "ing", "tion"), 15, 40), "related": (("license", "token"), 10, 20)}
    low = F.lower("text")
    score = tx.keyword_score(low, groups) - F.least(F.lit(30), F.size(tx.term_hits(low, ("idiot",))) * 30)
    return t.documents.select("doc_id", score.cast("int").alias("score"))


@query("n05_n06_metadata_score", "SELECT p_partkey, round(least(30, 10*log2(1 + p_size)) + CASE WHEN p_retailprice > 1500 THEN 20 WHEN p_retailprice > 1000 THEN 10 ELSE 0 END, 6) AS score FROM part")
def n05(t):
    v = F.col("p_retailprice")
    return t.part.select("p_partkey", (F.least(F.lit(30.0), 10 * F.log2(1 + F.col("p_size"))) + F.when(v > 1500, 20).when(v > 1000, 10).otherwise(0)).alias("score"))


@query("n07_weighted_route", "SELECT c_custkey, round(0.5*s + 0.3*n + 0.2*m, 6) AS final, CASE WHEN 0.5*s + 0.3*n + 0.2*m >= 60 THEN 'review' WHEN ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT % 100 < 5 THEN 'audit' ELSE 'store' END AS route FROM (SELECT c_custkey, (c_custkey % 101)::DOUBLE AS s, (c_nationkey*4)::DOUBLE AS n, (c_custkey % 7 * 10)::DOUBLE AS m FROM customer)")
def n07(t):
    """The random audit is a draw by hash, so reruns agree."""
    final = 0.5 * (F.col("c_custkey") % 101) + 0.3 * (F.col("c_nationkey") * 4) + 0.2 * (F.col("c_custkey") % 7 * 10)
    draw = F.conv(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return t.customer.select("c_custkey", final.alias("final"), F.when(final >= 60, "review").when(draw < 5, "audit").otherwise("store").alias("route"))


@query("n10_event_score", "SELECT user_id, least(100, max(length(event_type)) + CASE WHEN count(DISTINCT event_type) > 1 THEN 25 ELSE 0 END + CASE WHEN count(*) > 50 THEN 5 ELSE 0 END) AS score FROM events GROUP BY 1")
def n10(t):
    g = t.events.groupBy("user_id").agg(F.max(F.length("event_type")).alias("severity"), F.countDistinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.least(F.lit(100), F.col("severity") + F.when(F.col("kinds") > 1, 25).otherwise(0) + F.when(F.col("n") > 50, 5).otherwise(0)).alias("score"))


@query("n11_n12_title_rules", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '\bthe\b') THEN 'article' END, CASE WHEN regexp_matches(t, 'licen[cs]e') THEN 'license' END, CASE WHEN regexp_matches(t, '\d{6,}') THEN 'digits' END], lambda x: x IS NOT NULL), ',') AS labels FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE NOT regexp_matches(t, '\b(may|could)\b')")
def n12(t):
    low = F.lower("text")
    rows = t.documents.filter(~low.rlike(r"\b(may|could)\b"))
    return rows.select("doc_id", F.array_join(tx.rule_labels(low, {"article": r"\bthe\b", "license": "licen[cs]e", "digits": r"\d{6,}"}), ",").alias("labels"))


@query("n16_json_access", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY 1")
def n16(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


@query("n17_n18_dates_and_math", "SELECT o_orderkey, year(o_orderdate)::INT AS y, last_day(o_orderdate::DATE) AS month_end, (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE AS later, round(log10(o_totalprice), 6) AS l10, floor(sqrt(o_totalprice))::BIGINT AS root FROM orders")
def n17(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.year(day).alias("y"), F.last_day(day).alias("month_end"), F.add_months(day, 3).alias("later"), F.log10("o_totalprice").alias("l10"), F.floor(F.sqrt("o_totalprice")).alias("root"))


@query("n19_array_functions", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority))[1] AS first_priority, round(quantile_cont(o_totalprice, 0.25), 6) AS q25 FROM orders GROUP BY 1")
def n19(t):
    return t.orders.groupBy("o_custkey").agg(F.element_at(F.array_sort(F.collect_set("o_orderpriority")), 1).alias("first_priority"), F.percentile("o_totalprice", 0.25).alias("q25"))


@query("n21_relative_interest", "SELECT user_id, event_id, round(100*value/nullif(max(value) OVER (PARTITION BY user_id), 0), 4) AS relative FROM events", digits=4)
def n21(t):
    return t.events.select("user_id", "event_id", F.try_divide(100 * F.col("value"), F.max("value").over(Window.partitionBy("user_id"))).alias("relative"))


@query("p37_weighted_classes", """WITH c AS (SELECT * FROM (VALUES ('metal', 'steel', 3), ('metal', 'brass', 2), ('metal', 'tin', 1), ('size', 'large', 2), ('size', 'small', 2), ('finish', 'polished', 1), ('finish', 'plated', 1)) v(class, keyword, weight)),
p AS (SELECT p_partkey, class, sum(weight*least(3, len(string_split(lower(p_type || ' ' || p_name), keyword)) - 1)) AS points FROM part JOIN c ON contains(lower(p_type || ' ' || p_name), keyword) GROUP BY 1, 2)
SELECT p_partkey, class, points::BIGINT AS points, row_number() OVER (PARTITION BY p_partkey ORDER BY points DESC, class) AS place, round(points*1.0/sum(points) OVER (PARTITION BY p_partkey), 6) AS share FROM p""")
def p37(t):
    classes = t.spark.createDataFrame([("metal", "steel", 3), ("metal", "brass", 2), ("metal", "tin", 1), ("size", "large", 2), ("size", "small", 2), ("finish", "polished", 1), ("finish", "plated", 1)], "class string, keyword string, weight int")
    return tx.weighted_classes(t.part, "p_partkey", F.concat_ws(" ", "p_type", "p_name"), classes)


@query("s22_inverted_index_text", "SELECT p_partkey, regexp_replace(trim(p_type), ' +', ' ', 'g') AS text FROM part")
def s22(t):
    words = F.split(F.regexp_replace(F.trim("p_type"), " +", " "), " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i) == w))))
    return tx.inverted_to_text(t.part.select("p_partkey", index.alias("index")), "p_partkey", "index")


@query("e10_event_dedupe", "SELECT ts::DATE AS day, substr(event_type || ' of ' || floor(value)::BIGINT, 1, 120) AS title, user_id, min(event_id) AS event_id FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3")
def e10(t):
    """One event per date, first 120 characters of the title, and source; rows without a date are dropped."""
    title = F.concat(F.col("event_type"), F.lit(" of "), F.floor("value").cast("string"))
    return t.events.filter("ts is not null").groupBy(F.col("ts").cast("date").alias("day"), F.substring(title, 1, 120).alias("title"), "user_id").agg(F.min("event_id").alias("event_id"))


@query("e18_e19_derived_features", "SELECT p_partkey, round(ln(1 + greatest(p_retailprice, 0)), 6) AS log_price, round(p_retailprice/nullif(p_size, 0), 6) AS per_size FROM part")
def e18(t):
    return t.part.select("p_partkey", F.log1p(F.greatest("p_retailprice", F.lit(0.0))).alias("log_price"), F.try_divide("p_retailprice", F.col("p_size")).alias("per_size"))


@query("e30_name_search_list", "SELECT s_nationkey, array_to_string(list(s_name ORDER BY length(s_name), s_name)[1:3], '|') AS names FROM supplier GROUP BY 1")
def e30(t):
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.length("s_name"), "s_name"))
    some = t.supplier.withColumn("n", n).filter("n <= 3")
    names = F.transform(F.array_sort(F.collect_list(F.struct("n", "s_name"))), lambda x: x["s_name"])
    return some.groupBy("s_nationkey").agg(F.array_join(names, "|").alias("names"))


@query("e14_e42_nested_assembly", "SELECT o_custkey, count(*) AS points, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1")
def e14(t):
    """Each customer's series as an array of structs, then read back from it."""
    nested = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice"))).alias("series"))
    return nested.select("o_custkey", F.size("series").cast("long").alias("points"), F.col("series")[0]["day"].alias("first_day"), F.element_at("series", -1)["day"].alias("last_day"))
