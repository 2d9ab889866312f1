"""Work that grows no faster than the input, on copies and on keys beyond those of the given tables."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plover.operators import aliases, candidates, models, novelty, stats, text
from plover.operators import timeseries as ts
from plover.plans import registry
from plover.sources import markup


def test_copies_of_jobs_and_masters_make_no_pairs(spark):
    jobs = spark.range(300).selectExpr("id as key", "'Abc' as company", "'x' as location", "cast(null as string) as number")
    master = spark.range(400).selectExpr("1000 - id as number", "'abc d' as company", "'xy' as address")
    scores, _ = candidates.company_candidates(jobs, master)
    assert [(r["rows"], r["first"]) for r in scores.collect()] == [(400, 601)]
    got = candidates.resolve_numbers(jobs, master).select("status", "candidates", "confidence", "shown").distinct().collect()
    assert len(got) == 1 and tuple(got[0])[:3] == ("ambiguous", 400, 0.865)
    assert [got[0]["shown"].count(f'"number":{k},') for k in (601, 605, 606)] == [1, 1, 0]


def test_ngrams_are_neither_broadcast_nor_in_one_task(spark):
    texts = spark.range(300).selectExpr("id as k", "concat('name ', id) as s").coalesce(1)
    grams = text.char_grams(texts, "k", F.col("s"))
    assert grams.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    out = text.cosine_pairs(grams, spark.range(1, 300).selectExpr("id as a", "id - 1 as b"), "k", "a", "b")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 299


def differences(spark, name, folder, tables):
    """Rows of a registered query and of its SQL that the other side lacks."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = Counter(cursor.fetchall())
    got = Counter(tuple(r) for r in registry.QUERIES[name](spark, str(folder)).select(*columns).collect())
    return list((want - got).items()) + list((got - want).items())


def test_tickers_of_keys_beyond_four_digits(spark, tmp_path):
    suppliers = "SELECT range::BIGINT AS s_suppkey FROM range(8990, 9050) UNION ALL SELECT range FROM range(98990, 99050)"
    assert differences(spark, "p16_p17_tickers", tmp_path, {"supplier": suppliers}) == []


def test_means_are_rounded_as_sql_rounds(spark):
    ties = [298245.50125, 182615.15625, 230486.50375, -7.00005, 0.00015, 2.5]
    want = [duckdb.sql(f"SELECT round({x}::DOUBLE, 4)").fetchall()[0][0] for x in ties]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(ties)], "k int, x double").withColumn("r", stats.rounded(F.col("x"), 4)).orderBy("k").collect()
    assert [r["r"] for r in got] == want
    parts = spark.createDataFrame([(55.5, 55.5, 55.5, 55.5)], "a double, b double, c double, d double")
    assert stats.weighted_score(parts, {"a": 0.3, "b": 0.4, "c": 0.2, "d": 0.1}, 3).first()["total_score"] == 0.3 * 55.5 + 0.4 * 55.5 + 0.2 * 55.5 + 0.1 * 55.5


def test_items_with_the_same_terms_are_compared_once(spark, monkeypatch):
    words = ["red bolt", "red nut", "blue gear"]
    items = spark.range(900).selectExpr("id as key", "'m' as group")
    grams = text.char_grams(items.withColumn("s", F.element_at(F.array(*map(F.lit, words)), (F.col("key") % 3 + 1).cast("int"))), "key", F.col("s"))
    seen, plain = [], novelty._nearest_of
    monkeypatch.setattr(novelty, "_nearest_of", lambda some, g: seen.append(some.count()) or plain(some, g))
    got = {r["key"]: r["near"] for r in novelty.nearest_earlier(items, grams).collect()}
    assert seen == [3] and sorted(got) == list(range(1, 900)) and all(got[k] == 1 for k in range(3, 900))
    assert 0 < got[1] < 1 and got[2] < got[1]


def test_picks_from_the_head_leave_no_whole_pass(spark, monkeypatch):
    data = [("a", k, float(-k), f"site{k}", f"word{k} other{k}") for k in range(40)] + [("b", k, float(-k), "one", f"word{k} other{k}") for k in range(40)]
    rows = spark.createDataFrame(data, "g string, doc_id int, score double, domain string, title string")
    seen, plain = [], text._picks
    monkeypatch.setattr(text, "HEAD", 3)
    monkeypatch.setattr(text, "_picks", lambda some, *a: seen.append(sorted(r[0] for r in some.select("g").distinct().collect())) or plain(some, *a))
    got = {(r["g"], r["place"]): r["doc_id"] for r in text.diverse_pick(rows, "g", 2).collect()}
    assert seen == [["a", "b"], ["b"]] and got == {("a", 1): 0, ("a", 2): 1, ("b", 1): 0, ("b", 2): 1}


def test_rows_of_the_review_queue_meet_no_candidates(spark, tmp_path):
    tables = {
        "supplier": "SELECT range::BIGINT AS s_suppkey, (range % 3)::INT AS s_nationkey FROM range(60)",
        "customer": "SELECT range::BIGINT AS c_custkey, (range % 2)::INT AS c_nationkey, 7990.0::DOUBLE + range * 40 AS c_acctbal FROM range(50)",
    }
    assert differences(spark, "e09_review_queue", tmp_path, tables) == []
    plan = registry.QUERIES["e09_review_queue"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.index("Join ") < plan.index("Aggregate ")


def test_a_page_is_parsed_once(spark):
    pages = spark.range(3).selectExpr("concat('<tr><th>従業員数</th><th>平均年間給与（千円）</th></tr><tr><td>', id, '</td><td>9,000</td></tr>') as html")
    out = pages.select(markup.employee_table(F.col("html")).alias("x")).select("x.*")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert sorted(map(tuple, out.collect())) == [(float(k), None, 9_000_000.0) for k in range(3)]


@pytest.mark.parametrize("block", [3, 50_000])
def test_first_aliases_are_found_without_a_shuffle(spark, block, monkeypatch):
    monkeypatch.setattr(aliases, "ROWS", 10)
    docs = spark.range(200).selectExpr("id", "concat('one two ', if(id % 2 = 0, 'three', '')) as text")
    table = spark.createDataFrame([(f"c{k}", w, n) for k in range(40) for n, w in ((2, "one"), (1, "three"))], "company string, alias string, rank int")
    found = aliases.alias_matches(docs, table, "id", "text", True, block)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("key", "company", "alias").collect())) == sorted((i, f"c{k}", "one" if i % 2 else "three") for i in range(200) for k in range(40))


def test_hits_are_handed_on_in_short_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(aliases, "ROWS", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["a word"] * 500)], ["key", "text"])
    out = list(aliases._firsts([(k, "word", k) for k in range(40)], True)(iter([batch])))
    assert sum(map(len, out)) == 500 * 40 and max(map(len, out)) <= 140


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_peaks_come_from_short_frames(spark, n):
    data = [(s, i, None if (i * 7 + s) % 5 == 0 else float((i * i * 13 + s) % 11)) for s in range(2) for i in range(1, 61)]
    series = spark.createDataFrame(data, "symbol int, i int, close double")
    plain = series.withColumn("p", F.max(F.struct("close", "i")).over(ts.by_symbol().rowsBetween(-n, -1)))
    got = ts.prior_max(series, F.struct("close", "i"), n, "p")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    prices = spark.createDataFrame([], "symbol int, i int, day date, close double, high double, low double, volume double")
    assert "-500, -1" not in ts.setup_features(prices, ts.SignalRules())._jdf.queryExecution().optimizedPlan().toString()


def test_holding_variants_make_prices_and_signals_once(spark):
    plan = registry.QUERIES["w17_w18_holding_variants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_latest_sizes_are_found_in_one_sorted_series(spark, tmp_path):
    lines = "SELECT (range % 3)::BIGINT AS l_suppkey, DATE '1995-01-20' + (range * 7 % 200)::INT AS l_shipdate, (100 + range % 50)::DOUBLE AS l_extendedprice, 2.0::DOUBLE AS l_quantity FROM range(150)"
    assert differences(spark, "j13_point_in_time_size", tmp_path, {"lineitem": lines}) == []
    plan = registry.QUERIES["j13_point_in_time_size"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation ") == 1


def test_more_texts_are_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(text, "TEXTS", 10)
    grams = text.char_grams(spark.range(300).selectExpr("id as k", "concat('name ', id) as s"), "k", F.col("s"))
    assert grams.select(F.spark_partition_id().alias("p")).distinct().count() > 20
    assert grams.filter("gram = 'nam'").count() == 300


def test_more_years_are_no_more_passes(spark, tmp_path):
    jobs = []
    for years in (4, 8):
        lines = f"SELECT range::BIGINT AS l_orderkey, 1 AS l_linenumber, make_timestamp(1990 + (range % {years})::INT, 5, 1, 0, 0, 0.0) AS l_shipdate, (range * 7 % 50)::DOUBLE AS l_quantity, (range % 11)::DOUBLE / 100 AS l_discount, (range % 9)::DOUBLE / 100 AS l_tax, (range * 31 % 997)::DOUBLE AS l_extendedprice FROM range(400)"
        duckdb.sql(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet'")
        spark.sparkContext.setJobGroup(f"walk-{years}", "")
        assert len(registry.QUERIES["m03_m11_walk_forward"](spark, str(tmp_path)).collect()) == years - 2
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk-{years}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2


def test_ranks_of_growing_windows_match_numpy(spark):
    rng = np.random.default_rng(5)
    a, b, y, t = rng.integers(0, 6, 300), rng.normal(size=300), rng.integers(0, 40, 300), rng.choice([1, 2, 4, 5], 300)
    data = [(int(w), None if k % 3 == 0 else float(u), None if w < 4 else float(v), 1.0, None if k % 7 == 0 else float(z)) for k, (u, v, z, w) in enumerate(zip(a, b, y, t, strict=True))]
    rows = spark.createDataFrame([*data, (None, 1.0, 1.0, 1.0, 1.0)], "t int, a double, b double, c double, y double")
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    want = {}
    for f, name in ((1, "a"), (2, "b")):
        for cut in (2, 4, 5):
            met = np.array([(r[f], r[4]) for r in data if r[0] < cut and r[f] is not None and r[4] is not None])
            if len(met):
                want[name, cut] = np.corrcoef(rank(met[:, 0]), rank(met[:, 1]))[0, 1]
    got = stats.growing_spearman(rows, ["a", "b", "c"], "y", "t", [2, 4, 5])
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    tested = {r["t"]: r for r in models.walk_forward(rows, ["a", "b", "c"], "y", "t", 2, (0.1, 1.0)).collect()}
    assert {k: (r["n"], r["features"]) for k, r in tested.items()} == {4: (int((t == 4).sum()), "a"), 5: (int((t == 5).sum()), "a")}
    assert tested[4]["penalty"] == 0.1  # nothing is known of time 3


def test_names_that_no_alias_is_like_make_no_keys(spark, monkeypatch):
    from plover.operators import fuzzy

    cut = []
    plain = fuzzy._keys
    monkeypatch.setattr(fuzzy, "_keys", lambda tokens, seen, key, share: cut.append((key, tokens.select(key).distinct().count())) or plain(tokens, seen, key, share))
    # Too long, of other characters, and one that is near.
    texts = [*(f"customer number {k:05}" for k in range(300)), *(f"{k:07}" for k in range(200)), "standxrd"]
    names = spark.createDataFrame([(x,) for x in texts], "name string")
    types = spark.createDataFrame([("standard",), ("economy",)], "alias string")
    assert [tuple(r) for r in fuzzy.near_pairs(names, types, 0.65).collect()] == [("standxrd", "standard")]
    assert dict(cut) == {"name": 1, "alias": 1}


def test_only_parts_that_are_asked_for_are_indexed(spark, monkeypatch):
    sizes, plain = [], candidates._parts
    monkeypatch.setattr(candidates, "_parts", lambda text, some: sizes.append(tuple(some)) or plain(text, some))
    pairs = lambda a, b: sorted(map(tuple, candidates.contained_pairs(spark.createDataFrame([(x,) for x in a], "inner string"), spark.createDataFrame([(x,) for x in b], "outer string")).collect()))
    assert pairs(["standard", "a much longer name than any"], ["no standard here", "sta", None, ""]) == [("standard", "no standard here")]
    assert set(sizes) == {(3,)}
    some = ["a", "日本", "𠮷野家", "x", "ab", "abc", "cab", "", None]
    outer = ["ab", "abcab", "日本電気", "吉", "the 𠮷野家", "bc"]
    assert pairs(some, outer) == sorted((x, y) for x in some for y in outer if x and x in y)
    assert pairs([], outer) == pairs(some, []) == []
