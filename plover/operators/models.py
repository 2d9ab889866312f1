"""Models from sufficient statistics: Spark sums, the driver solves small systems."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.operators.quantiles import quantiles
from plover.operators.stats import growing_spearman


def moments(df: DataFrame, features: list[str], target: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """(n, mean, centred Gram matrix, centred products with the target, target mean) of complete rows."""
    complete = df.dropna(subset=[*features, target])
    x = [F.col(c).cast("double") for c in features]
    y, k = F.col(target).cast("double"), len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = complete.agg(F.count(F.lit(1)), *[F.avg(c) for c in x], F.avg(y), *[F.covar_pop(x[i], x[j]) for i, j in pairs], *[F.covar_pop(c, y) for c in x]).first()
    n = row[0]
    gram = np.zeros((k, k))
    for (i, j), value in zip(pairs, row[k + 2 : k + 2 + len(pairs)], strict=True):
        gram[i, j] = gram[j, i] = value or 0.0
    return n, np.array([v or 0.0 for v in row[1 : k + 1]]), gram, np.array([v or 0.0 for v in row[k + 2 + len(pairs) :]]), row[k + 1] or 0.0


def ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> tuple[float, np.ndarray]:
    """Ridge on standardised features by the normal equations over n; returns intercept and raw coefficients."""
    return _ridge(moments(df, features, target), penalty)


def _ridge(sums: tuple[int, np.ndarray, np.ndarray, np.ndarray, float], penalty: float) -> tuple[float, np.ndarray]:
    _, mean, gram, cross, target_mean = sums
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    scale[scale < 1e-12] = 1.0
    beta = np.linalg.solve(gram / np.outer(scale, scale) + penalty * np.eye(len(mean)), cross / scale) / scale
    return float(target_mean - beta @ mean), beta


def _moments_by(df: DataFrame, sets: list[tuple[str, ...]], target: str, time: str) -> dict[tuple[str, ...], dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    """For each set of features and each time its complete rows' (n, mean, covariance); the target is the last variable. One aggregate."""
    columns, places = [], []
    for s in sets:
        names = [*s, target]
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
        x = [F.when(whole, F.col(c).cast("double")) for c in names]
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        columns += [F.count_if(whole), *map(F.avg, x), *[F.covar_pop(x[i], x[j]) for i, j in pairs]]
        places.append((s, len(names), pairs))
    out: dict[tuple[str, ...], dict[int, tuple[int, np.ndarray, np.ndarray]]] = {s: {} for s in sets}
    for row in df.groupBy(time).agg(*[c.alias(f"_{k}") for k, c in enumerate(columns)]).collect():  # a row per time
        values = iter(row[1:])
        for s, k, pairs in places:
            n, mean, gram = next(values), np.array([next(values) or 0.0 for _ in range(k)]), np.zeros((k, k))
            for i, j in pairs:
                gram[i, j] = gram[j, i] = next(values) or 0.0
            out[s][row[0]] = n, mean, gram
    return out


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """The `moments` of several times' rows together, with ``k`` features."""
    n, mean, gram = 0, np.zeros(k + 1), np.zeros((k + 1, k + 1))
    for m, other, spread in parts:
        if m:
            gap, total = other - mean, n + m
            gram = (n * gram + m * spread + n * m / total * np.outer(gap, gap)) / total
            mean, n = mean + gap * (m / total), total
    return n, mean[:k], gram[:k, :k], gram[:k, k], float(mean[k])


def walk_forward(df: DataFrame, features: list[str], target: str, time: str, most: int, penalties: tuple[float, ...], first: int = 2, coverage: float = 0.35) -> DataFrame:
    """(time, n, mae, features, penalty) for each whole-number time but the ``first`` few: a ridge model of the times before, tested on it.

    Of the features that are known often enough before, the ``most`` that
    correlate most with the target by rank are taken, ties by name; the penalty
    is that with the least error at the time just before, after a fit on what
    came earlier. All times are taken in the same few passes over the rows:
    counts, ranks, moments of each time that are merged, and errors.
    """
    df = df.filter(F.col(time).isNotNull())
    counts = {r[0]: r[1:] for r in df.groupBy(time).agg(F.count(F.lit(1)), *[F.count(c) for c in features]).collect()}
    cuts = sorted(counts)[first:]
    known = {t: np.sum([v for s, v in counts.items() if s < t], axis=0) for t in cuts}
    strength = growing_spearman(df, features, target, time, cuts) if cuts else {}
    chosen = {}
    for t in cuts:
        usable = [c for k, c in enumerate(features) if known[t][k + 1] / known[t][0] >= coverage and (c, t) in strength]
        chosen[t] = tuple(sorted(usable, key=lambda c: (-abs(strength[c, t]), c))[:most])

    sums = _moments_by(df, sorted(set(chosen.values())), target, time) if cuts else {}
    until = lambda t, end: _merged([m for s, m in sums[chosen[t]].items() if s < end], len(chosen[t]))
    at = lambda values: reduce(lambda out, x: out.when(F.col(time) == x[0], x[1]), values.items(), F.when(F.lit(False), F.lit(None)))
    error = lambda fits: F.abs(F.col(target) - at(fits))
    inner = {t: until(t, t - 1) for t in cuts}
    tried = [F.avg(error({t - 1: linear(list(chosen[t]), *_ridge(inner[t], p)) for t in cuts})).alias(f"_{k}") for k, p in enumerate(penalties)]
    errors = {r[0] + 1: r[1:] for r in df.filter(F.col(time).isin([t - 1 for t in cuts])).groupBy(time).agg(*tried).collect()}
    penalty = {}
    for t in cuts:
        scored = [(e, p) for e, p in zip(errors.get(t, [None] * len(penalties)), penalties, strict=True) if e is not None]
        penalty[t] = min(scored)[1] if scored else penalties[0]

    final = {t: linear(list(chosen[t]), *_ridge(until(t, t), penalty[t])) for t in cuts}
    tested = df.filter(F.col(time).isin(cuts)).groupBy(time).agg(F.count(F.lit(1)).alias("n"), F.avg(error(final)).alias("mae"))
    return tested.withColumns({"features": at({t: F.lit(",".join(c)) for t, c in chosen.items()}).cast("string"), "penalty": at({t: F.lit(p) for t, p in penalty.items()}).cast("double")})


def elastic_net(df: DataFrame, features: list[str], target: str, penalty: float, l1_share: float, sweeps: int = 500) -> tuple[float, np.ndarray]:
    """Coordinate descent on the same sums; no row leaves the executors."""
    _, mean, gram, cross, target_mean = moments(df, features, target)
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    scale[scale < 1e-12] = 1.0
    g, c, beta = gram / np.outer(scale, scale), cross / scale, np.zeros(len(features))
    for _ in range(sweeps):
        last = beta.copy()
        for j in range(len(beta)):
            rest = c[j] - g[j] @ beta + g[j, j] * beta[j]
            beta[j] = np.sign(rest) * max(abs(rest) - penalty * l1_share, 0.0) / (g[j, j] + penalty * (1 - l1_share) + 1e-12)
        if np.abs(beta - last).max() < 1e-10:
            break
    beta = beta / scale
    return float(target_mean - beta @ mean), beta


def linear(features: list[str], intercept: float, beta: np.ndarray) -> Column:
    out = F.lit(intercept)
    for c, b in zip(features, beta.tolist(), strict=True):
        out = out + F.lit(b) * F.col(c)
    return out


def preprocess(df: DataFrame, features: list[str]) -> DataFrame:
    """Clip to the 1st and 99th percentile, fill with the median, standardise by the population deviation."""
    bounds = quantiles(df, features, (0.01, 0.5, 0.99)).first()
    clipped = df
    for c in features:
        low, mid, high = (x or 0.0 for x in bounds[f"q_{c}"] or (0.0, 0.0, 0.0))
        clipped = clipped.withColumn(c, F.when(F.col(c).isNull(), F.lit(float(mid))).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(c)))))
    totals = clipped.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    return clipped.withColumns({c: (F.col(c) - F.lit(totals[f"m_{c}"])) / F.lit(totals[f"s_{c}"] or 1.0) for c in features})


def logistic(df: DataFrame, features: list[str], label: str, penalty: float = 1.0, steps: int = 10) -> tuple[float, np.ndarray]:
    """Newton's method; each step is one aggregate of the gradient and the Hessian."""
    k = len(features)
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    w = np.zeros(k + 1)
    complete = df.dropna(subset=[*features, label])
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    for _ in range(steps):
        z = sum((F.lit(float(w[i])) * x[i] for i in range(1, k + 1)), F.lit(float(w[0])))
        rows = complete.withColumn("_p", 1 / (1 + F.exp(-z)))
        row = rows.agg(*[F.sum((F.col(label) - F.col("_p")) * c) for c in x], *[F.sum(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]) for i, j in pairs]).first()
        pull = np.r_[0.0, np.full(k, penalty)]
        hessian = np.diag(pull + 1e-9)
        for (i, j), value in zip(pairs, row[k + 1 :], strict=True):
            hessian[i, j] += value
            hessian[j, i] += value if i != j else 0.0
        move = np.linalg.solve(hessian, np.array(row[: k + 1]) - pull * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), w[1:]


def validated_logistic(df: DataFrame, features: list[str], label: str, train: Column, penalty: float = 1.0) -> DataFrame:
    """One row: a logistic model fitted where ``train`` holds, and how it does on the other rows against the training rate.

    Rows with a null feature or label don't count. Brier scores are mean squared
    errors of probabilities; the baseline gives every row the training rate.
    """
    complete = df.dropna(subset=[*features, label])
    train = F.coalesce(train, F.lit(False))
    intercept, beta = logistic(complete.filter(train), features, label, penalty)
    p = 1 / (1 + F.exp(-linear(features, intercept, beta)))
    rate = complete.filter(train).agg(F.avg(label).alias("base_rate"), F.count(F.lit(1)).alias("train_rows"))
    rest = complete.filter(~train).withColumn("_p", p).crossJoin(F.broadcast(rate))
    y = F.col(label)
    hit = lambda guess: F.avg(((guess >= 0.5).cast("int") == y).cast("int"))
    out = rest.agg(
        F.max("train_rows").alias("train_rows"), F.count(F.lit(1)).alias("test_rows"), F.max("base_rate").alias("base_rate"), F.avg(y).alias("test_rate"), F.avg(F.pow(F.col("_p") - y, 2)).alias("brier"),
        F.avg(F.pow(F.col("base_rate") - y, 2)).alias("baseline_brier"), hit(F.col("_p")).alias("accuracy"), hit(F.col("base_rate")).alias("baseline_accuracy"),
    )
    return out.withColumn("skill", 1 - F.try_divide(F.col("brier"), F.col("baseline_brier")))


def boosted_stumps(df: DataFrame, features: list[str], label: str, rounds: int = 10, rate: float = 0.3, bins: int = 16) -> list[tuple[str, float, float, float]]:
    """Second-order boosting with one split a round; splits are chosen among quantiles.

    A round is one aggregate over all features: gradient and Hessian sums under
    each cut. Returns (feature, cut, left, right).
    """
    cuts = quantiles(df, features, [k / bins for k in range(1, bins)]).first()
    stumps: list[tuple[str, float, float, float]] = []
    for _ in range(rounds):
        rows = df.withColumn("_p", 1 / (1 + F.exp(-stump_score(stumps))))
        g, h = F.col(label) - F.col("_p"), F.col("_p") * (1 - F.col("_p"))
        wanted = [(c, v) for c in features for v in sorted(set(cuts[f"q_{c}"] or ()))]
        sums = rows.agg(F.sum(g), F.sum(h), *[F.sum(F.when(F.col(c) <= v, g).otherwise(0.0)) for c, v in wanted], *[F.sum(F.when(F.col(c) <= v, h).otherwise(0.0)) for c, v in wanted]).first()
        all_g, all_h, n = sums[0], sums[1], len(wanted)
        gain = [gl * gl / (hl + 1) + (all_g - gl) ** 2 / (all_h - hl + 1) for gl, hl in zip(sums[2 : n + 2], sums[n + 2 :], strict=True)]
        best = int(np.argmax(gain))
        gl, hl = sums[2 + best], sums[n + 2 + best]
        stumps.append((wanted[best][0], float(wanted[best][1]), rate * gl / (hl + 1), rate * (all_g - gl) / (all_h - hl + 1)))
    return stumps


def stump_score(stumps: list[tuple[str, float, float, float]]) -> Column:
    out = F.lit(0.0)
    for c, cut, left, right in stumps:
        out = out + F.when(F.col(c) <= cut, F.lit(float(left))).otherwise(F.lit(float(right)))
    return out
