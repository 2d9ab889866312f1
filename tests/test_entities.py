"""Novelty, quantiles, aliases, identities, candidates, sweeps, windows and look-back streams against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plover.functions import clean
from plover.operators import aliases, backfill, candidates, identity, joins, models, novelty, quantiles, sketches, stability, stats
from plover.operators import text as tx
from plover.operators import timeseries as ts
from plover.session import scratch_path
from plover.sources import readers
from plover.streaming import windows


# Novelty


def cosine(a, b):
    dot = sum(n * b[g] for g, n in a.items())
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if a and b else 0.0


@pytest.mark.parametrize("run", [3, 1000])
def test_novelty_is_that_of_all_pairs(spark, monkeypatch, run):
    monkeypatch.setattr(novelty, "RUN", run)
    rng = random.Random(run)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    rows = []
    for k in range(260):
        group = rng.choice(["hot", "hot", "hot", "cold", "rare", None]) if k else "once"
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 12]))) if k % 9 else rows[k // 2][2] if k else "x"
        rows.append((k, group, text, [rng.choice(["A61K 8", "h04l", "G06-F", ""]) for _ in range(rng.randrange(3))], [rng.choice(["B01D", "C07"])] if k % 3 else None))
    rows += [(1000, "other", None, None, None), (1001, "other", "zzz", ["a61k/99"], [])]
    items = spark.createDataFrame(rows, "key long, group string, text string, codes array<string>, more_codes array<string>")
    got = {r["key"]: (r["near"], r["fresh"], r["novelty"]) for r in novelty.novelty(items, tx.char_grams(items, "key", F.col("text"))).collect()}
    grams = {k: Counter(s[j : j + 3] for j in range(len(s) - 2)) for k, s in ((r[0], "".join((r[2] or "").lower().split())) for r in rows)}
    root = lambda c: "".join(x for x in c.upper() if x.isascii() and x.isalnum())[:4]
    for key, group, _, codes, more in rows:
        before = [r for r in rows if group is not None and r[1] == group and r[0] < key]
        mine = {root(c) for c in [*(codes or []), *(more or [])]} - {""}
        fresh = len(mine - {root(c) for r in before for c in r[3] or []}) if group is not None else 0
        near = max((cosine(grams[key], grams[r[0]]) for r in before), default=None)
        want = 25 if group is None else 50 if near is None else min(100, 75 * (1 - near) + min(25, 10 * fresh))
        assert got[key][1] == fresh and (got[key][0] is None) == (near is None)
        assert near is None or math.isclose(got[key][0], near, abs_tol=1e-9)
        assert math.isclose(got[key][2], want, abs_tol=1e-6)


# Quantiles


@pytest.mark.parametrize(("accuracy", "gathered"), [(4, 0), (10_000, 0), (10_000, 10**6)])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, gathered):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "GATHERED", gathered - 1)
    rng = np.random.default_rng(accuracy)
    groups = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "same": np.full(400, 7.0), None: rng.exponential(size=101)}
    rows = [(g, float(v), float(-v)) for g, x in groups.items() for v in x] + [("none", None, None), ("one", None, 3.0)]
    shares = (0.0, 0.05, 0.5, 0.801, 1.0)
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    got = {r["g"]: r for r in quantiles.quantiles(df, ["v", "w"], shares, ["g"], [F.count(F.lit(1)).alias("rows")]).collect()}
    assert set(got) == {*groups, "none"} and got["none"]["n_v"] == 0 and got["none"]["q_v"] is None
    for g, x in groups.items():
        assert got[g]["n_v"] == len(x) and np.allclose(got[g]["q_v"], np.quantile(x, shares))
        assert np.allclose(got[g]["q_w"], np.quantile([-v for v in x] + ([3.0] if g == "one" else []), shares))
    whole = quantiles.quantiles(df, ["v"], shares).first()
    assert np.allclose(whole["q_v"], np.quantile(np.concatenate(list(groups.values())), shares))
    empty = quantiles.quantiles(df.limit(0), ["v"], shares).first()
    assert empty["n_v"] == 0 and set(empty["q_v"] or [None]) == {None}


# Aliases


@pytest.mark.parametrize("block", [2, 50_000])
def test_aliases_match_plain_containment(spark, block):
    texts = [(1, "Acme Corp and ACME  holdings"), (2, "nothing"), (None, "the acme"), (3, None), (3, "ﬁne Acmeish é"), (4, "x" * 5000 + " Borealis"), (5, "")]
    names = [("a", "acme holdings", 1), ("a", "acme", 2), ("b", "Borealis", 1), ("b", "", 0), ("c", "acme", 1), ("d", "fine", 1), ("e", None, 1), ("f", "100%_x", 1), ("a", "acme", 2)]
    docs = spark.createDataFrame([(*r, "p") for r in texts], "id long, text string, place string")
    table = spark.createDataFrame(names, "company string, alias string, rank int")
    for whole_words in (False, True):
        got = sorted((str(r["key"]), r["company"], r["alias"]) for r in aliases.alias_matches(docs, table, "id", "text", whole_words, block).collect())
        want = [("1", "a", "acme holdings"), ("1", "c", "acme"), ("4", "b", "Borealis"), ("None", "a", "acme"), ("None", "c", "acme"), ("3", "d", "fine")]
        want += [] if whole_words else [("3", "a", "acme"), ("3", "c", "acme")]
        assert got == sorted(want)
    assert aliases.alias_matches(docs, table.limit(0), "id").count() == 0 and aliases.alias_matches(docs.limit(0), table, "id").count() == 0


# Identity


def test_identities_follow_the_key_cascade(spark):
    rows = [
        # rec, source, source_id, doi, arxiv, title, author
        (1, "x", "1", "10.1/A", "", "One", "Ann"), (2, "y", "7", "https://doi.org/10.1/a", "2001.1v3", "Other", "Bo"), (3, "z", "9", None, "arXiv:2001.1", "Third", "Cy"),
        (4, "x", "1", "10.9/z", "", "Moved", "Ann"), (5, "w", "1", "", "", "One!", "ann"), (6, "w", "2", "10.5/q", "", "one", "Ann"), (7, "w", "3", "", "", "Lone", ""), (8, "w", "4", "", "", "Lone", None),
        (9, None, None, "", "", "late", "Dee"), (10, "v", "1", "10.7/k", "", "Late", "Dee"), (11, "v", "2", "", "", "LATE", "Dee"),
    ]
    records = spark.createDataFrame([(*r, "a" * (r[0] % 4), "j" if r[0] > 2 else "", f"2020-01-{r[0]:02}") for r in rows], "rec long, source string, source_id string, doi string, arxiv string, title string, author string, abstract string, journal string, updated_at string")
    resolved = identity.resolve_identities(records)
    assert {r["rec"]: r["root"] for r in resolved.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 9}
    papers = {r["root"]: r for r in identity.merge_papers(resolved).collect()}
    first = papers[1]
    assert (first["paper_id"], first["records"], first["source_records"], first["doi"], first["arxiv"], first["abstract"], first["journal"], first["updated_at"]) == ("doi:10.1/a", 5, 4, "10.1/a", "2001.1", "aaa", "j", "2020-01-05")
    assert papers[9]["paper_id"].startswith("paper:") and papers[10]["paper_id"] == "doi:10.7/k"
    assert identity.resolve_identities(records.limit(0)).count() == 0


# Candidates


def overlap(job, master):
    if not job or not master:
        return 0.0
    if job in master or master in job:
        return 1.0
    return next((min(n / len(job), 1.0) for n in (6, 5, 4, 3) if any(job[k : k + n] in master for k in range(len(job) - n + 1))), 0.0)


def test_candidates_match_all_pairs(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abc 株") for _ in range(rng.randrange(0, 6)))
    jobs = [(k, name(), name() + "tokyo", "1" * 13 if k % 11 == 0 else None) for k in range(120)] + [(500, None, None, "12"), (501, "株式会社", "x", None), (502, "100%_a", "p", None)]
    master = [(1000 + k, name(), rng.choice(["tokyo abc", "osaka", "", None])) for k in range(150)] + [(2000, "x100%_ab", "p"), (2001, None, "p")]
    js = spark.createDataFrame(jobs, "key long, company string, location string, number string")
    ms = spark.createDataFrame(master, "number long, company string, address string")
    plain = lambda s: (s or "").replace("株式会社", "").replace(" ", "").lower()
    want = defaultdict(list)
    for key, company, place, number in jobs:
        for m, other, address in master if not (number and len(number) == 13) else []:
            a, b = plain(company), plain(other)
            if a and b and (a in b or b in a):
                want[key].append((-round((1.0 if a == b else 0.82) * 0.75 + overlap(plain(place), plain(address)) * 0.25, 3), m))
    got = {r["key"]: r for r in candidates.resolve_numbers(js, ms).collect()}
    assert len(got) == len(jobs)
    for key, _, _, number in jobs:
        r, found = got[key], sorted(want[key])
        assert r["candidates"] == len(found)
        if number and len(number) == 13:
            assert (r["status"], r["number"], r["confidence"]) == ("already_present", number, 1.0)
        elif not found:
            assert r["status"] == "not_found" and r["shown"] is None
        else:
            sure = -found[0][0] >= 0.92 and round(-found[0][0] + (found[1][0] if len(found) > 1 else 0), 6) >= 0.05
            assert r["status"] == ("estimated" if sure else "ambiguous") and r["confidence"] == -found[0][0] and r["number"] == (str(found[0][1]) if sure else None)
            assert r["shown"].count('"number"') == min(5, len(found))


# Sweeps


def test_sweep_finds_the_greatest_known_row(spark):
    rng = random.Random(6)
    facts = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), rng.randrange(5), rng.randrange(9) if rng.random() < 0.9 else None) for _ in range(200)]
    rows = [(k, rng.choice(["a", "a", "b", "c", None]), rng.randrange(-3, 55)) for k in range(150)]
    left = spark.createDataFrame(rows, "id long, k string, t int")
    right = spark.createDataFrame([(*f, "x") for f in facts], "k string, t int, score int, value int, id string")
    got = {r["id"]: (r["score"], r["value"]) for r in joins.sweep_join(left, right, "k", "t", "t", ["score", "t"], ["score", "value"], "id").collect()}
    for k, by, at in rows:
        known = [(s, t, -1 if v is None else v) for f, t, s, v in facts if by is not None and f == by and t <= at]
        want = max(known, default=None)
        assert got[k] == ((None, None) if want is None else (want[0], None if want[2] < 0 else want[2]))


# Windows


def test_expanding_correlations_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(y), float(x), float(x * (1 if y > 2003 else -1) + rng.normal())) for g in "ab" for y in range(2000, 2008) for x in rng.normal(size=20) + 1e6]
    rows += [("flat", 2000 + k, 1.0, float(k)) for k in range(8)] + [("a", 2001, None, 1.0)]
    got = {(r["g"], r["start_year"]): r for r in stability.expanding_correlations(spark.createDataFrame(rows, "g string, year int, x double, y double"), ["g"], "year").collect()}
    assert {k[0] for k in got} == {"a", "b"}
    for g in "ab":
        last = None
        for start in range(2007, 1999, -1):
            some = [(x, y) for h, year, x, y in rows if h == g and year >= start and x is not None]
            r = got[g, start]
            assert r["n"] == len(some) and math.isclose(r["pearson"], np.corrcoef(*zip(*some, strict=True))[0, 1], abs_tol=1e-7)
            assert (r["previous"] is None) == (last is None) and (last is None or math.isclose(r["previous"], last, abs_tol=1e-9))
            last = r["pearson"]


def test_capped_windows_cover_the_period_and_keep_the_cap(spark):
    rng = random.Random(5)
    found = [("hot", f"2020-03-{d:02}") for d in (3, 3, 3, 3, 3, 4) for _ in range(10)] + [("k", f"2020-0{rng.randrange(1, 4)}-{rng.randrange(1, 28):02}") for _ in range(60)] + [("k", "1999-01-01"), (None, "2020-01-05")]
    keys = spark.createDataFrame([("hot",), ("k",), ("none",), (None,)], "k string")
    rows = backfill.capped_windows(spark.createDataFrame(found, "k string, d string"), keys, "k", "d", "2020-01-01", "2020-03-31", 5, least_days=1, levels=4).collect()
    for key in ("hot", "k", "none"):
        mine = sorted((str(r["first_day"]), str(r["last_day"]), r["n"], r["capped"]) for r in rows if r["k"] == key)
        assert mine[0][0] == "2020-01-01" and mine[-1][1] == "2020-03-31"
        assert all(np.datetime64(a[1]) + 1 == np.datetime64(b[0]) for a, b in zip(mine, mine[1:], strict=False))
        assert all(n == sum(k == key and a <= d <= b for k, d in found) and capped == (n > 5) and (not capped or a == b) for a, b, n, capped in mine)
    assert {r["k"] for r in rows} == {"hot", "k", "none"} and [r["n"] for r in rows if r["k"] == "none"] == [0] * 6


# Sketches


def test_merged_sketches_are_close_to_exact_counts(spark):
    batches = [spark.range(a, a + 30_000).select(F.lit("g").alias("g"), "id", (F.col("id") * 7 % 40_009).alias("v")) for a in (0, 20_000, 40_000)]
    stored = batches[0].limit(0)
    stored = sketches.sketched(stored, ["g"], "id", "v")
    for b in batches:
        stored = stored.unionByName(sketches.sketched(b, ["g"], "id", "v"))
    r = sketches.merged(stored, ["g"]).select("rows", sketches.distinct_estimate().alias("n"), sketches.quantile_estimate(0.5).alias("q")).first()
    values = np.sort(np.concatenate([np.arange(a, a + 30_000) * 7 % 40_009 for a in (0, 20_000, 40_000)]))
    assert r["rows"] == 90_000 and abs(r["n"] - 70_000) < 0.03 * 70_000 and abs(np.searchsorted(values, r["q"]) / len(values) - 0.5) < 0.04


# Streams


def test_lookback_batches_count_each_event_once_and_resume(spark):
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "state"))
    day = lambda k, hour=0: f"2024-01-{k:02} {hour:02}:30:00"
    schema = "event_id long, ts timestamp_ntz, event_type string"

    def batch(rows):
        made = spark.createDataFrame([(i, t, "a" if i % 2 else "b") for i, t in rows], "event_id long, ts string, event_type string")
        made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)

    batch([(1, day(1)), (2, day(1, 5)), (3, day(2, 3))])
    batch([(3, day(2, 3)), (4, day(2, 3)), (5, day(3))])
    run = lambda: {(r["event_type"], str(r["window_start"])): r["n"] for r in windows.lookback_counts(windows.read_slices(spark, folder, schema), out, checkpoint, "2 days").collect()}
    assert run() == {("a", "2024-01-01 00:00:00"): 1, ("b", "2024-01-01 05:00:00"): 1, ("a", "2024-01-02 03:00:00"): 1, ("b", "2024-01-02 03:00:00"): 1, ("a", "2024-01-03 00:00:00"): 1}
    batch([(5, day(3)), (7, day(2, 3)), (8, day(6))])  # a late row inside the overlap, and one seen before the restart
    batch([(9, day(1)), (8, day(6)), (10, day(6, 1))])  # too late by now: dropped
    again = run()
    assert again[("a", "2024-01-02 03:00:00")] == 2 and again[("a", "2024-01-03 00:00:00")] == 1 and again[("b", "2024-01-06 00:00:00")] == 1 and again[("b", "2024-01-06 01:00:00")] == 1
    assert again[("a", "2024-01-01 00:00:00")] == 1


# Long series


def long_series(spark, n=700, symbols=("a", "b")):
    rng = random.Random(4)
    rows = []
    for s in symbols:
        price = 100.0
        for i in range(1, (n if s == "a" else n // 3) + 1):
            price = max(1.0, price * (1 + rng.uniform(-0.04, 0.042)))
            rows.append((s, i, f"2020-{i:04}", round(price, 2), round(price * 1.01, 2), round(price * 0.98, 2), float(rng.randrange(0, 50))))
    return spark.createDataFrame(rows, "symbol string, i int, day string, close double, high double, low double, volume double"), rows


def test_pieces_give_what_whole_symbols_give(spark):
    series, _ = long_series(spark)
    rules = ts.SignalRules(peak_window=60, least_history=20, drawdown=1.0, low_drawdown=2.0, peak_age=3, range_window=15, most_range=60.0, most_volatility=9.0, density_window=6, density=2, short_window=5, buffer=0.0, breakout_return=0.1, expansion_return=0.3, breakout_volume=0.2, expansion_volume=0.3, close_strength=0.1)
    run = lambda s: ts.confirmations(ts.triggers(ts.setup_features(s, rules), rules), rules)
    columns = ["symbol", "i", "trigger", "level", "setup_days", "confirm_i", "held_low", "peak_age"]
    want = sorted(map(tuple, run(series).select(*columns).collect()))
    assert len(want) > 10
    for size in (7, 64, 10_000):
        assert sorted(map(tuple, ts.in_pieces(series, run, 60 + 6 + 1, 2, size).select(*columns).collect())) == want


@pytest.mark.parametrize("block", [3, 512])
def test_first_reach_is_the_first_row_under_the_level(spark, block):
    series, rows = long_series(spark, 200)
    rng = random.Random(block)
    events = [(k, rng.choice("abz"), rng.randrange(1, 220), rng.uniform(20, 160)) for k in range(150)]
    df = spark.createDataFrame(events, "k long, symbol string, at int, lv double")
    got = {r["k"]: r["reach_i"] for r in ts.first_reach(df, series, "low", "k", "at", "lv", block).collect()}
    assert got == {k: min((r[1] for r in rows if r[0] == s and r[1] >= at and r[5] <= lv), default=None) for k, s, at, lv in events}


def test_cooldown_streams_over_batches(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(400) if rng.random() < 0.95 else None, rng.randrange(5)) for _ in range(500)]
    got = sorted(map(tuple, ts.greedy_cooldown(spark.createDataFrame(rows, "k string, at int, v int"), "k", "at", 10, ["v"]).collect()))
    want, last = [], {}
    for k, at, v in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        if k not in last or at - last[k] >= 10:
            last[k] = at
            want.append((k, at, v))
    assert got == want


# Bootstrap and pairs of models


def test_bootstrap_replicates_equal_numpy_under_the_same_draws(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdefg"), float(rng.randrange(20))) for _ in range(90)] + [("a", None)]
    df = spark.createDataFrame(rows, "c string, v double")
    draws = defaultdict(dict)
    for r in stats.poisson_draws(df.select(F.col("c").alias("_cluster")).distinct(), "_cluster", 40, 5).collect():
        draws[r["replicate"]][r["_cluster"]] = r["_w"]
    got = {r["replicate"]: r["median"] for r in stats.bootstrap_medians(df, "c", "v", 40, 5).collect()}
    want = {k: np.median([v for c, v in rows if v is not None for _ in range(w.get(c, 0))]) for k, w in draws.items()}
    assert got == want
    groups = df.groupBy(F.col("c").alias("_cluster")).agg(F.sum("v").alias("t"), F.count("v").alias("n"))
    means = {r["replicate"]: r["mean"] for r in stats.bootstrap_means(groups, "_cluster", "t", "n", 40, 5).collect()}
    assert all(math.isclose(means[k], np.mean([v for c, v in rows if v is not None for _ in range(w.get(c, 0))])) for k, w in draws.items())


def test_model_overlaps_and_differences(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xyz"), rng.choice("st"), f"2021-0{rng.randrange(1, 4)}-{rng.randrange(1, 29):02}", float(rng.randrange(9))) for _ in range(60)]
    df = spark.createDataFrame(rows, "m string, c string, d string, v double").withColumn("d", F.to_date("d"))
    days = lambda a, b: abs(int((np.datetime64(a) - np.datetime64(b)).astype(int)))
    got = {(r["a"], r["b"]): (r["n"], r["same_day"], r["near"]) for r in stats.model_overlaps(df, "m", "c", "d").collect()}
    for a in "xyz":
        for b in set("xyz") - {a}:
            mine, other = [r for r in rows if r[0] == a], [r for r in rows if r[0] == b]
            hit = lambda r, n, other=other: any(o[1] == r[1] and days(o[2], r[2]) <= n for o in other)
            assert got[a, b] == (len(mine), sum(hit(r, 0) for r in mine), sum(hit(r, 7) for r in mine))
    found = {(r["a"], r["b"], r["cluster"]): r["difference"] for r in stats.paired_differences(df, "m", "c", "v").collect()}
    mean = lambda m, c: np.mean([r[3] for r in rows if r[0] == m and r[1] == c])
    assert len(found) == 12 and all(math.isclose(v, mean(a, c) - mean(b, c)) for (a, b, c), v in found.items())


# Files, names and validation


@pytest.mark.parametrize(("encoding", "headers"), [("utf-8", "法人番号,企業名"), ("utf-8-sig", "法人番号,企業名"), ("cp932", "法人番号,企業名"), ("cp932", "number,company"), ("utf-8", "number,company")])
def test_csv_falls_back_by_headers_and_rows(spark, tmp_path, encoding, headers):
    lines = [headers, *[f"{k},plain" for k in range(50)], '1,"ソ表 ""引用"", \\"', "2,㈱①能"]
    (tmp_path / "in.csv").write_bytes("\n".join(lines).encode(encoding))
    rows = readers.read_csv(spark, f"file://{tmp_path}/in.csv", ("UTF-8", "cp932", "shift_jis"))
    got = readers.with_aliases(rows, {"number": ["法人番号"], "company": ["企業名"]}).collect()
    assert len(got) == 52 and {r["company"] for r in got} == {"plain", 'ソ表 "引用", \\', "㈱①能"}


def test_name_keys_follow_their_own_rules(spark):
    import re
    import unicodedata

    names = ["株式会社　テスト・ホールディングス", "㈱テスト", "（株）ＡＢＣ商事", "Acme Holdings, Inc.", "ACME co.,ltd.", "K.K. Foo", "Fookk", "合名会社ソ-ー表", "", None, "有限会社 A/B\\C_d"]
    nfkc = lambda s: unicodedata.normalize("NFKC", s or "")

    def women(s):
        s = nfkc(s).lower()
        for x in clean.WOMEN_FORMS:
            s = s.replace(x, "")
        return re.sub(r"[\s　・･,，.．\-ー―_/／\\()（）\[\]【】]", "", s)

    def enrichment(s):
        s = re.sub(r"[()（）・,，.．/／\\\-ー－_＿]", "", re.sub(r"\s+", "", nfkc(s).upper()))
        for x in clean.ENRICHMENT_FORMS:
            s = s.replace(x, "")
        return s

    news = lambda s: re.sub("[^0-9a-z぀-ヿ㐀-鿿]+", "", re.sub(clean.NEWS_FORMS, "", nfkc(s).casefold()))
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", clean.news_name_key(F.col("n")), clean.enrichment_name_key(F.col("n")), clean.women_name_key(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(n, news(n), enrichment(n), women(n)) for n in names]
    codes = spark.createDataFrame([("1234",), ("12340",), ("12345",), ("証券 7203",), (None,), ("12",)], "c string").select(clean.security_code(F.col("c")).alias("c")).collect()
    assert [r["c"] for r in codes] == ["1234", "1234", "", "7203", "", ""]


def test_validated_logistic_scores_the_later_rows_only(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.3 + 1.5 * x)))).astype(int)
    df = spark.createDataFrame([(int(t), float(v), int(label)) for t, (v, label) in enumerate(zip(x, y, strict=True))] + [(1000, None, 1)], "t int, v double, label int")
    r = models.validated_logistic(df, ["v"], "label", F.col("t") < 480, penalty=0.5).first()
    w = np.zeros(2)
    design = np.c_[np.ones(480), x[:480]]
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-9, 0.5 + 1e-9])
        w = w + np.linalg.solve(hessian, design.T @ (y[:480] - p) - np.array([0.0, 0.5]) * w)
    p = 1 / (1 + np.exp(-(w[0] + w[1] * x[480:])))
    base = y[:480].mean()
    assert (r["train_rows"], r["test_rows"]) == (480, 120) and math.isclose(r["brier"], np.mean((p - y[480:]) ** 2), rel_tol=1e-6)
    assert math.isclose(r["baseline_brier"], np.mean((base - y[480:]) ** 2)) and math.isclose(r["accuracy"], np.mean((p >= 0.5) == y[480:])) and r["skill"] > 0.1
