"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with
one word skipped, plus triples. FTRL-proximal keeps a learning rate per
coordinate and its L1 term leaves few weights, so the model is small enough to
ship with every task. The fit sees a bounded number of labelled rows in one
pass per epoch; scoring sees every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.llm.words import WordHashes, mixed, ngrams, letter_words

#: A model with more weights than this is refused: it would not be a small broadcast.
MOST_WEIGHTS = 200_000


@dataclass(frozen=True)
class Ftrl:
    """Settings of the fit; ``dim_bits`` hashes features to 2 ** dim_bits places.

    Features of fewer than ``least_rows`` rows are left out of the fit.
    """

    dim_bits: int = 20
    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 3
    least_rows: int = 3


def features(hashes: np.ndarray, dim_bits: int) -> np.ndarray:
    """Places of words, pairs, pairs with a gap and triples; repeats included."""
    skip = mixed(hashes[:-2] * np.uint64(0xA24BAED4963EE407) + hashes[2:]) if len(hashes) > 2 else hashes[:0]
    grams = [mixed(hashes), ngrams(hashes, 2), skip, ngrams(hashes, 3)]
    return (np.concatenate(grams) >> np.uint64(64 - dim_bits)).astype(np.int64)


def _frequent(rows: list[tuple[np.ndarray, int]], how: Ftrl) -> list[tuple[np.ndarray, int]]:
    seen = np.zeros(1 << how.dim_bits, np.int32)
    for at, _ in rows:
        seen[at] += 1
    return [(at[seen[at] >= how.least_rows], y) for at, y in rows]


def fit(rows: list[tuple[np.ndarray, int]], how: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that aren't zero, and the intercept.

    ``rows`` have distinct feature places and a 0/1 label. The intercept starts
    at the log odds of the labels and has no L1 term.
    """
    z, n = np.zeros(1 << how.dim_bits), np.zeros(1 << how.dim_bits)
    rate = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0
    weight = lambda at: np.where(np.abs(z[at]) <= how.l1, 0.0, (np.sign(z[at]) * how.l1 - z[at]) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))
    rows = _frequent(rows, how)
    order = np.random.default_rng(2)
    for _ in range(how.epochs):
        for k in order.permutation(len(rows)):
            at, y = rows[k]
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += g * g
            bias -= how.alpha * g / np.sqrt(bias_n)
    every = np.arange(1 << how.dim_bits)
    w = weight(every)
    kept = np.flatnonzero(w)
    return kept, w[kept], bias


def _train(how: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = WordHashes(), []
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows.append((np.unique(features(hashes.of(letter_words(text.as_py())), how.dim_bits)).astype(np.int32), label))
        places, values, bias = fit(rows, how)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *places.tolist()]), pa.array([bias, *values.tolist()])], ["place", "weight"])

    return run


def train_toxicity(labelled: DataFrame, how: Ftrl = Ftrl(), most_rows: int = 12_000) -> list[tuple[int, float]]:
    """Fit on about 0.95 ``most_rows`` rows of ``labelled`` (id, text, label), taken by hash.

    The bound keeps the fit within one task: its rows are reduced to feature
    places there. They come in the order of id, text and label, so reruns agree
    to the last bit, however the rows were split. Returns (place, weight) pairs; place -1 is the intercept.
    Rows with a null label don't count; a null text has no features.
    """
    usable = labelled.filter("label is not null").select("id", "text", F.col("label").cast("int").alias("label"))
    total = usable.select("id").count()
    share = min(1.0, 0.95 * most_rows / max(total, 1))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(2), "id"), 11) * 2.0**-53
    ordered = usable.filter(unit < share).repartition(1).sortWithinPartitions("id", "text", "label")
    found = ordered.select("text", "label").mapInArrow(_train(how), "place long, weight double").limit(MOST_WEIGHTS + 1).collect()
    if len(found) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights; raise l1")
    return [(r["place"], r["weight"]) for r in found]


def _score(model: list[tuple[int, float]], dim_bits: int):
    places = np.array([p for p, _ in model if p >= 0], np.int64)
    values = np.array([w for p, w in model if p >= 0])
    bias = sum(w for p, w in model if p < 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), np.zeros(1 << dim_bits, np.float32)
        table[places] = values
        for batch in batches:
            scores = []
            for text in batch.column(1):
                at = features(hashes.of(letter_words(text.as_py())), dim_bits)
                met = table[at]
                hit = np.flatnonzero(met)
                _, once = np.unique(at[hit], return_index=True)
                total = float(met[hit][once].sum(dtype=np.float64)) + bias
                scores.append(1 / (1 + np.exp(-max(-30.0, min(30.0, total)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: list[tuple[int, float]], how: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score in 0 to 1) of every row; a null or empty text scores the intercept.

    Repeated rows are scored each; other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(_score(model, how.dim_bits), f"id {kind}, score double")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(folds))
