"""Document quality by hierarchical empirical Bayes.

Evidence: a logistic model over surface features of the whole text, fitted by
Newton steps whose sums are aggregated over all labelled rows. Site level:
each host's and each path's share of good documents, a known label counting as
it is and any other document by its evidence, shrunk host to global and path to
host. The strength of each prior comes from the spread between groups beyond
chance, by the method of moments, so sparse sites follow their parent. A
document's score adds to its evidence the log odds of its path over the global
ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plover.llm.words import WordHashes
from plover.session import materialize

FEATURES = ("words", "upper", "symbols", "bars", "digits", "word_length", "distinct", "repeats", "top_share", "marked", "exclaims", "line_repeats")
#: Standardised features are held within this, so that no text lies far outside what the fit saw.
FAR = 5.0
#: A table of sites with at most so many rows is broadcast.
BROADCAST_ROWS = 200_000

_KINDS = np.zeros((256, 5))
for _c in range(256):
    _s = chr(_c) if _c < 128 else ""
    _KINDS[_c] = [_s.isalpha(), _s.isupper(), _s in set("#$%&*|<>{}[]\\~^@_=+!"), _s.isdigit(), 1]
_MARKS = bytes(49 if c < 128 and chr(c) in "#$%&*|<>{}[]\\~^@!" else 48 for c in range(256))


def surface(text: str | None, hashes: WordHashes) -> list[float]:
    """The values of ``FEATURES``; zeros for a text without words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    letters, upper, symbols, digits, total = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS
    h, n = hashes.of(words), len(words)
    _, times = np.unique(h, return_counts=True)
    lines = [x for x in raw.split(b"\n") if x]
    marked = sum(map((49).__eq__, (w.translate(_MARKS)[-1] for w in words)))
    return [
        math.log1p(n), upper / max(letters, 1), symbols / total, words.count(b"|") / n, digits / total, min(total / n, 40.0),
        math.log(len(times)) / math.log(n + 1), float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0, float(times.max()) / n if n > 20 else 0.0,
        marked / n, raw.count(b"!") / n, 1 - len(set(lines)) / len(lines),
    ]


def _surfaces(text: pa.Array) -> pa.Array:
    hashes = WordHashes()
    return pa.array([surface(x.as_py(), hashes) for x in text], pa.list_(pa.float64()))


def surface_features(text: Column) -> Column:
    """ARRAY<DOUBLE> of ``FEATURES``."""
    return F.arrow_udf(_surfaces, T.ArrayType(T.DoubleType()))(text)


@dataclass(frozen=True)
class QualityModel:
    """``weights``: intercept first; features are centred and scaled before."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def log_odds(self, features: Column) -> Column:
        out = F.lit(self.weights[0])
        for k, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights[1:], strict=True)):
            out = out + F.lit(w) * F.greatest(F.lit(-FAR), F.least(F.lit(FAR), (features[k] - F.lit(m)) / F.lit(s)))
        return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), out))


def _totals(rows: DataFrame, of) -> np.ndarray:
    """Sums over all rows of the vector that ``of`` (features, labels) gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                total = total + of(x, batch.column(1).to_numpy().astype(np.float64))
        values = np.atleast_1d(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    sums = rows.select("features", "label").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in sums.orderBy("place").collect()])


def fit_evidence(labelled: DataFrame, steps: int = 8, ridge: float = 1.0) -> QualityModel:
    """Ridge logistic regression of ``label`` (0/1) on ``features``, over all rows.

    Only sums reach the driver: the moments, then a gradient and a Hessian a step.
    """
    n = len(FEATURES)
    first = _totals(labelled, lambda x, y: np.r_[len(y), y.sum(), x.sum(axis=0), (x * x).sum(axis=0)])
    if len(first) < 2:
        return QualityModel((0.0,) * n, (1.0,) * n, (0.0,) * (n + 1))
    mean = first[2 : n + 2] / first[0]
    deviation = np.sqrt(np.maximum(first[n + 2 :] / first[0] - mean**2, 0))
    scale = np.where(deviation > 1e-6, deviation, 1.0)
    rate = (first[1] + 0.5) / (first[0] + 1)
    w = np.r_[math.log(rate / (1 - rate)), np.zeros(n)]

    def parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(y)), np.clip((x - mean) / scale, -FAR, FAR)]
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        return np.r_[z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]

    pull = np.r_[0.0, np.full(n, ridge)]
    for _ in range(steps):
        sums = _totals(labelled, parts)
        hessian = sums[n + 1 :].reshape(n + 1, n + 1) + np.diag(pull + 1e-9)
        move = np.linalg.solve(hessian, sums[: n + 1] - pull * w)
        w = w + np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-4:
            break
    return QualityModel(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def _strength(groups: DataFrame, parent: str) -> float:
    """Rows that the parent's share is worth, from the spread of the groups' shares."""
    chance = F.col(parent) * (1 - F.col(parent))
    k, total, squares, spread, noise = groups.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(parent), 2)), F.sum(F.col("n") * chance)
    ).first()
    if not k or k < 2 or not noise:
        return 1e6
    variance = noise / total
    between = (spread - (k - 1) * variance) / max(total - squares / total, 1e-9)
    return float(min(max(variance / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, posterior) and the global share of good documents.

    ``evidence`` has host, path, p and a label that may be null. Null hosts and
    paths are sites of their own. Sums are grouped by path first, so a hot host
    is pre-aggregated.
    """
    value = F.coalesce(F.col("label").cast("double"), F.col("p"))
    paths = materialize(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("good")), "paths")
    total = paths.agg(F.sum("n"), F.sum("good")).first()
    share = (total[1] + 0.5) / (total[0] + 1) if total[0] else 0.5
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(share))
    weight = _strength(hosts, "prior")
    hosts = hosts.select("h", ((F.col("good") + weight * F.lit(share)) / (F.col("n") + weight)).alias("host_share"))
    nested = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "nested")
    weight = _strength(nested, "host_share")
    posterior = (F.col("good") + weight * F.col("host_share")) / (F.col("n") + weight)
    return nested.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), posterior.alias("posterior")), share


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> tuple[DataFrame, QualityModel, DataFrame, float]:
    """(id, host, path, evidence, posterior, score) per row, then the model, the sites and the global share.

    ``labels`` has the id and ``quality`` 0/1; null labels don't count and of
    repeated ones the least does. A text without words scores 0. Repeated rows
    are scored each; other columns are ignored.
    """
    known = labels.filter(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min("quality").cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), surface_features(F.col(text_col)).alias("features"))
    rows = materialize(rows.join(known, F.col("id") == F.col("label_id"), "left").drop("label_id"), "features")
    model = fit_evidence(rows.filter("label is not null and features[0] > 0"))
    evidence = rows.withColumn("evidence", model.log_odds(F.col("features"))).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    sites, share = site_posteriors(evidence)
    sites = materialize(sites, "sites")
    scored = with_score(evidence, sites, share, F.col("features")[0] > 0)
    return scored.select("id", "host", "path", "evidence", "posterior", "score"), model, sites, share


def with_score(rows: DataFrame, sites: DataFrame, share: float, has_words: Column) -> DataFrame:
    """Adds posterior and score to rows with host, path and evidence."""
    small = F.broadcast(sites) if sites.count() <= BROADCAST_ROWS else sites
    met = rows.join(small, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")), "left").drop("site_host", "site_path")
    posterior = F.least(F.greatest(F.coalesce("posterior", F.lit(share)), F.lit(1e-4)), F.lit(1 - 1e-4))
    shift = F.log(posterior / (1 - posterior)) - F.lit(math.log(share / (1 - share)))
    score = F.when(has_words, 1 / (1 + F.exp(-(F.col("evidence") + shift)))).otherwise(0.0)
    return met.withColumn("posterior", posterior).withColumn("score", score)
