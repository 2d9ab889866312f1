"""Models against plain numpy."""

import numpy as np
from pyspark.sql import functions as F

from plover.operators import models, stats

SF = "/root/testdata/sf0.001"


def data(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3)) * [1.0, 5.0, 0.1] + [0.0, 2.0, 1.0]
    return x, x @ [2.0, -0.3, 4.0] + rng.standard_normal(n)


def frame(spark, x, y, name="y"):
    return spark.createDataFrame([(k, *map(float, row), float(t)) for k, (row, t) in enumerate(zip(x, y, strict=True))], f"k int, a double, b double, c double, {name} double")


def ridge_by_numpy(x, y, penalty):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-12] = 1
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z / len(y) + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean()) / len(y)) / scale
    return y.mean() - beta @ mean, beta


def test_ridge_and_elastic_net(spark):
    x, y = data()
    df = frame(spark, x, y)
    for penalty in (0.0, 0.3):
        intercept, beta = models.ridge(df, ["a", "b", "c"], "y", penalty)
        want = ridge_by_numpy(x, y, penalty)
        assert np.allclose([intercept, *beta], [want[0], *want[1]])
    intercept, beta = models.elastic_net(df, ["a", "b", "c"], "y", 0.4, 0.5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.zeros(3)
    for _ in range(20_000):  # proximal gradient steps on the same objective
        w = w - 0.1 * (z.T @ (z @ w - (y - y.mean())) / len(y) + 0.2 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * 0.2, 0)
    assert np.allclose(beta, w / x.std(axis=0), atol=1e-6) and np.isclose(intercept, y.mean() - beta @ x.mean(axis=0))


def test_logistic_and_boosted_stumps(spark):
    x, y = data(seed=2)
    label = (y > np.median(y)).astype(float)
    df = frame(spark, x, label)
    intercept, beta = models.logistic(df, ["a", "b", "c"], "y", 1.0, 30)
    z, w = np.c_[np.ones(len(y)), x], np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([0, 1.0, 1, 1]), z.T @ (label - p) - np.array([0, 1.0, 1, 1]) * w)
    assert np.allclose([intercept, *beta], w, atol=1e-6)

    stumps = models.boosted_stumps(df, ["a", "b", "c"], "y", 5)
    score, cuts = np.zeros(len(y)), {c: sorted(set(np.quantile(x[:, k], np.arange(1, 16) / 16))) for k, c in enumerate("abc")}
    for c, cut, left, right in stumps:
        p = 1 / (1 + np.exp(-score))
        g, h = label - p, p * (1 - p)
        tried = []
        for k, name in enumerate("abc"):
            for v in cuts[name]:
                low = x[:, k] <= v + 1e-12
                tried.append((g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1), name, v, 0.3 * g[low].sum() / (h[low].sum() + 1), 0.3 * g[~low].sum() / (h[~low].sum() + 1)))
        best = max(tried)
        assert best[1] == c and np.allclose(best[2:], [cut, left, right], atol=1e-9)
        score = score + np.where(x[:, "abc".index(c)] <= cut, left, right)
    got = {r["k"]: r["s"] for r in df.select("k", models.stump_score(stumps).alias("s")).collect()}
    assert np.allclose([got[k] for k in range(len(y))], score)


def test_walk_forward_matches_numpy(spark):
    from plover.plans import registry

    got = {r["y"]: r for r in registry.QUERIES["m03_m11_walk_forward"](spark, SF).collect()}
    rows = np.array([tuple(r) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select(F.year("l_shipdate"), F.col("l_quantity").cast("double"), "l_discount", "l_tax", "l_extendedprice").collect()], float)
    years, names = sorted(set(rows[:, 0])), ["q", "l_discount", "l_tax"]
    assert set(got) == set(map(int, years[2:]))
    for year in years[2:]:
        before, now = rows[rows[:, 0] < year], rows[rows[:, 0] == year]
        chosen = got[int(year)]["features"].split(",")
        at = [1 + names.index(c) for c in chosen]
        errors = {}
        for penalty in (0.01, 0.1, 1.0):
            inner, held = before[before[:, 0] < year - 1], before[before[:, 0] == year - 1]
            b, w = ridge_by_numpy(inner[:, at], inner[:, 4], penalty)
            errors[penalty] = np.abs(held[:, 4] - b - held[:, at] @ w).mean()
        penalty = min(errors, key=lambda p: (round(errors[p], 6), p))
        b, w = ridge_by_numpy(before[:, at], before[:, 4], penalty)
        assert got[int(year)]["penalty"] == penalty and got[int(year)]["n"] == len(now)
        assert np.isclose(got[int(year)]["mae"], np.abs(now[:, 4] - b - now[:, at] @ w).mean(), atol=1e-4)


def test_practical_targets_match_pairs(spark):
    from plover.plans import modelling, registry

    class Tables:
        def __getattr__(self, name):
            return spark.read.parquet(f"{SF}/{name}.parquet")

    got = {r["segment"]: r for r in registry.QUERIES["m12_m13_practical_targets"](spark, SF).collect()}
    rows = modelling._targets(Tables()).withColumn("fold", F.pmod(F.xxhash64("c_custkey"), F.lit(3))).toPandas()
    features = ["n", "mean", "top", "c_acctbal"]
    train, test = rows[rows.fold != 0], rows[rows.fold == 0]
    b, w = ridge_by_numpy(train[features].to_numpy(float), train.label.to_numpy(float), 0.1)
    test = test.assign(s=np.round(b + test[features].to_numpy(float) @ w, 9))
    for segment, r in got.items():
        part = test if segment == "all" else test[test.c_mktsegment == segment]
        good, bad = part.s[part.label == 1].to_numpy(), part.s[part.label == 0].to_numpy()
        assert (r["positives"] or 0, r["negatives"] or 0) == (len(good), len(bad))
        if len(good) and len(bad):
            assert np.isclose(r["auc"], np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad)), atol=1e-6)


def test_cluster_bootstrap_is_centred_and_as_wide_as_theory(spark):
    rng = np.random.default_rng(3)
    totals, n = rng.gamma(2.0, 50.0, 200), rng.integers(1, 9, 200)
    groups = spark.createDataFrame([(k, float(t * m), int(m)) for k, (t, m) in enumerate(zip(totals, n, strict=True))], "k int, total double, n int")
    draws = [r["mean"] for r in stats.bootstrap_means(groups, "k", "total", "n", 400, 7).collect()]
    mean = (totals * n).sum() / n.sum()
    error = np.sqrt((((totals - mean) * n) ** 2).sum()) / n.sum()
    assert len(draws) == 400 and abs(np.mean(draws) - mean) < 0.25 * error and 0.8 < np.std(draws) / error < 1.2


def test_ranked_statistics_match_pairs(spark):
    rng = np.random.default_rng(4)
    s, y = rng.integers(0, 12, 90).astype(float), rng.integers(0, 2, 90)
    df = spark.createDataFrame([(k, a, int(b)) for k, (a, b) in enumerate(zip(s.tolist(), y, strict=True))] + [(900, None, 1), (901, 1.0, None)], "k int, s double, y int")
    good, bad = s[y == 1], s[y == 0]
    placed = (good[:, None] > bad) + 0.5 * (good[:, None] == bad)
    got = stats.delong(df, "s", "y").first()
    variance = placed.mean(axis=1).var(ddof=1) / len(good) + placed.mean(axis=0).var(ddof=1) / len(bad)
    assert np.isclose(got["auc"], placed.mean()) and np.isclose(got["variance"], variance) and np.isclose(got["std_error"], np.sqrt(variance))
    long = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(s, y, strict=True)], "g string, x double, y double")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert np.isclose(stats.correlations(long, ["g"]).first()["spearman"], np.corrcoef(rank(s), rank(y.astype(float)))[0, 1])
