"""Hierarchical language identification.

A linear support vector machine per family (one against the rest) picks the
family; within it, a machine for each pair of languages (one versus one) votes.
Features are hashed character trigrams of the whole text, scaled to
unit length. Families follow `FAMILIES`; a language that it lacks is a family
of its own, so unknown codes work too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.llm.words import mixed
from plover.session import materialize

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
DIM_BITS = 15
#: A table of languages with at most so many rows is broadcast.
BROADCAST_ROWS = 10_000


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and unit-length values of the features; null if there is no letter."""
    if not text:
        return None
    lower = text.lower()
    points = np.frombuffer(lower.encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter(points)
    if not letter.any():
        return None
    # Runs of other characters count as one space, so that layout doesn't matter.
    points = np.where(letter, points, np.uint32(32))
    keep = letter | np.r_[True, letter[:-1]]
    points = np.r_[np.uint32(32), points[keep], np.uint32(32)].astype(np.uint64)
    grams = mixed((points[:-2] << np.uint64(42)) ^ (points[1:-1] << np.uint64(21)) ^ points[2:])
    found = np.bincount((grams >> np.uint64(64 - DIM_BITS)).astype(np.int64), minlength=0)
    at = np.flatnonzero(found)
    values = np.sqrt(found[at])
    return at.astype(np.int32), (values / np.sqrt((values * values).sum())).astype(np.float32)


_TABLE: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _TABLE[0][points]


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, decay: float = 1e-4) -> np.ndarray:
    """A linear machine by Pegasos on hinge loss, averaged over the second half; the last weight is the intercept.

    Classes weigh alike, however many rows each has.
    """
    w, total, scale = np.zeros((1 << DIM_BITS) + 1), np.zeros((1 << DIM_BITS) + 1), 1.0
    share = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    order, step, kept, steps = np.random.default_rng(8), 0, 0, epochs * len(rows)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            step += 1
            at, x = rows[k]
            rate = 1.0 / (decay * (step + 1000))
            margin = y[k] * (scale * (w[at] @ x) + w[-1])
            scale *= 1 - rate * decay
            if margin < 1:
                w[at] += rate * share[k] * y[k] / scale * x
                w[-1] += 0.01 * share[k] * y[k]
            if step > steps // 2 and step % 50 == 0:
                total[:-1] += w[:-1] * scale
                total[-1] += w[-1]
                kept += 1
    if not kept:
        total, kept = np.r_[w[:-1] * scale, w[-1]], 1
    return (total / kept).astype(np.float32)


def fit_machines(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> dict[str, np.ndarray]:
    """Machines by name: ``family:F`` against the rest, ``pair:A:B`` within a family (positive for A)."""
    named = np.array(langs)
    families = np.array([FAMILY_OF.get(x, x) for x in langs])
    out = {}
    for family in sorted(set(families)):
        if len(set(families)) > 1:
            out[f"family:{family}"] = _svm(rows, np.where(families == family, 1.0, -1.0))
        else:
            out[f"family:{family}"] = np.zeros((1 << DIM_BITS) + 1, np.float32)
        for a, b in combinations(sorted(set(named[families == family])), 2):
            at = np.flatnonzero((named == a) | (named == b))
            out[f"pair:{a}:{b}"] = _svm([rows[k] for k in at], np.where(named[at] == a, 1.0, -1.0))
        out[f"languages:{family}"] = np.array([], np.float32)
    return out


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, langs = [], []
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if (x := counts(text.as_py())) is not None:
                rows.append(x)
                langs.append(lang)
    machines = fit_machines(rows, langs) if rows else {}
    names = [n for n in machines if not n.startswith("languages:")]
    members: dict[str, set] = {}
    for lang in langs:
        members.setdefault(FAMILY_OF.get(lang, lang), set()).add(lang)
    names += [f"languages:{f}\x1f" + "\x1f".join(sorted(m)) for f, m in members.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([machines[n].tobytes() if n in machines else b"" for n in names], pa.binary())], ["name", "weights"]
    )


def train_language(labelled: DataFrame, rows_per_language: int = 2_500) -> dict[str, bytes]:
    """Fit on about ``rows_per_language`` rows a language of ``labelled`` (id, text, lang), taken by hash.

    The bound keeps the fit within one task. Rows with a null text or lang don't
    count. The model has a vector of 2 ** 15 weights per family and per pair of
    languages in a family, so its size follows the number of languages only.
    """
    usable = labelled.filter("text is not null and lang is not null").select("id", "text", "lang")
    sizes = materialize(usable.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("rows")), "languages")
    # Joined where the texts are read: shuffled by language, a few tasks would get all of them.
    small = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(8), "id"), 11) * 2.0**-53
    chosen = usable.join(small, F.col("lang") == F.col("l")).filter(unit * F.col("rows") < rows_per_language)
    ordered = chosen.select("id", "text", "lang").repartition(1).sortWithinPartitions("id", "lang", "text")  # reruns agree
    found = ordered.select("text", "lang").mapInArrow(_train, "name string, weights binary").collect()
    return {r["name"]: bytes(r["weights"]) for r in found}


def _predict(model: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = {n: np.frombuffer(w, np.float32) for n, w in model.items()}
        families = sorted(n[7:] for n in machines if n.startswith("family:"))
        languages = {n.split("\x1f")[0][10:]: n.split("\x1f")[1:] for n in machines if n.startswith("languages:")}
        sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(2 * v, -30, 30)))

        def of(text: str | None) -> tuple[str, float]:
            found = counts(text) if families else None
            if found is None:
                return "und", 0.0
            at, x = found
            margin = lambda name: float(machines[name][at] @ x + machines[name][-1])
            margins = [margin(f"family:{f}") for f in families]
            family = families[int(np.argmax(margins))]
            sure = sigmoid(max(margins)) if len(families) > 1 else 1.0
            votes = dict.fromkeys(languages[family], 0.0)
            for a, b in combinations(languages[family], 2):
                p = sigmoid(margin(f"pair:{a}:{b}"))
                votes[a] += p
                votes[b] += 1 - p
            best = max(sorted(votes), key=votes.get)
            return best, float(sure * (votes[best] / (len(votes) - 1) if len(votes) > 1 else 1.0))

        for batch in batches:
            found = [of(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score in 0 to 1) of every row.

    ``und`` with score 0 where the text is null or has no letter, or where
    nothing was learned. Repeated rows are predicted each; other columns are
    ignored.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(_predict(model), f"id {kind}, lang_pred string, score double")
