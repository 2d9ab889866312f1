"""Benchmark decontamination by latent semantic retrieval.

1. Texts become codes of the words of all benchmark items (others are 0),
   written once for any number of items.
2. Document frequencies of those words over all passages give their weights.
   Words of more than a fiftieth of all passages weigh nothing in the TF-IDF
   vectors, unless they are of the rarer half of some item's words.
3. One pass over all passages sketches the TF-IDF matrix: the product of its
   Gram matrix with a random matrix, summed by word in Spark, to which the items
   are added with the weight of as many passages, gives the leading right
   singular vectors and values of both (randomised SVD, Nystrom form). Without
   the items, those whose words are rare in the corpus would have almost no
   latent vector.
4. Passages at several lengths, so that an item of any length lies whole in one
   with up to half of it besides, are candidates for an item if the cosine of
   their latent vectors is ``Limits.cosine`` or more. Passages that, with their
   surroundings, hold too few of the item's words for 5 are passed by first:
   counted by an inverted index, so that loses nothing.
5. A candidate is confirmed by the longest common subsequence of the item and
   the passage with its surroundings: nearly the whole item (verbatim), or a
   good part of it (paraphrase), the latter with the answer's words nearby if
   the benchmark has answers.

The items are searched for in blocks of ``ITEMS``, which bounds what a task
holds and changes no result: vocabulary, frequencies and latent space are those
of the whole benchmark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.llm.words import letter_words
from plover.session import materialize

#: Items of a block; a block's items and all words' latent vectors are sent to all tasks.
ITEMS = 20_000
#: The shortest passage is three of these steps; each further length doubles it.
STEP = 8


@dataclass(frozen=True)
class Limits:
    """``rank`` latent dimensions from a sketch of ``sketch``; ``cosine`` is the least of a candidate; the other values are shares of an item."""

    rank: int = 48
    sketch: int = 64
    cosine: float = 0.2
    common: float = 0.02
    verbatim: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.6
    answer_words: int = 6
    room: float = 1.25


@dataclass
class Items:
    """Benchmark items in codes of the words of all of them."""

    ids: list[int]
    codes: list[np.ndarray]
    vocabulary: dict[bytes, int]
    answers: list[set[int]] = field(default_factory=list)
    answered: list[bool] = field(default_factory=list)

    def part(self, at: int, end: int) -> Items:
        """Some of the items, in the same codes."""
        return Items(self.ids[at:end], self.codes[at:end], {}, self.answers[at:end], self.answered[at:end])


def encode_items(rows: list[tuple[int, str, str | None]]) -> Items:
    """Items of (id, text, answer); items without words are left out."""
    vocabulary: dict[bytes, int] = {}
    items = Items([], [], vocabulary)
    for item, text, answer in rows:
        words = letter_words(text)
        if words:
            items.ids.append(item)
            items.codes.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32))
            items.answers.append({vocabulary.setdefault(w, len(vocabulary) + 1) for w in letter_words(answer)})
            items.answered.append(bool(items.answers[-1]))
    return items


def _encode(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            coded = []
            for text in batch.column(1):
                words = letter_words(text.as_py())
                coded.append(np.fromiter((get(w, 0) for w in words), "<i4", len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary())], ["id", "codes"])

    return run


def _frequencies(size: int, step: int):
    """Passages in which each word occurs; code 0 counts the passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(1):
                codes = np.frombuffer(raw.as_buffer(), "<i4")
                at = np.flatnonzero(codes)
                total += np.bincount(np.unique(at // step * size + codes[at]) % size, minlength=size)
                total[0] += -(-len(codes) // step)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["code", "n"])

    return run


def _random(size: int, wide: int) -> np.ndarray:
    return np.random.default_rng(20240907).standard_normal((size, wide))


def _gram(weight: np.ndarray, wide: int, step: int):
    """Rows of the Gram matrix times the random matrix, by word."""
    names = ["code", *[f"g{k}" for k in range(wide)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = (_random(len(weight), wide) * weight[:, None]).astype(np.float32)
        total = np.zeros((len(weight), wide))
        for batch in batches:
            parts, base = [[], []], 0
            for number, raw in enumerate(batch.column(1), 1):
                codes = np.frombuffer(raw.as_buffer(), "<i4")
                at = np.flatnonzero(weight[codes])
                parts[0].append(codes[at])
                parts[1].append(base + at // step)
                base += -(-len(codes) // step)
                if sum(map(len, parts[0])) < 100_000 and number < batch.num_rows:
                    continue
                codes, passage = np.concatenate(parts[0]), np.concatenate(parts[1])
                parts, base = [[], []], 0
                if not len(codes):
                    continue
                first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
                projected = np.add.reduceat(random[codes], first, axis=0)
                row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(codes)]))
                order = np.argsort(codes, kind="stable")
                ranked = codes[order]
                first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
                total[ranked[first]] += np.add.reduceat(projected[row[order]], first, axis=0) * weight[ranked[first], None]
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), *[pa.array(total[some, k]) for k in range(wide)]], names)

    return run


def latent_map(gram: np.ndarray, random: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, from a Nystrom sketch of the Gram matrix."""
    shift = 1e-6 * (np.linalg.norm(gram) + 1e-9)
    shifted = gram + shift * random
    core = random.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max() * 1e-10
    root = shifted @ (vectors[:, keep] / np.sqrt(values[keep]))
    left, sizes, _ = np.linalg.svd(root, full_matrices=False)
    keep = sizes[:rank] > sizes[0] * 1e-6
    return left[:, :rank][:, keep]


def common_subsequence(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item; code 0 matches nothing."""
    masks: dict[int, int] = {}
    for k, code in enumerate(item.tolist()):
        if code:
            masks[code] = masks.get(code, 0) | 1 << k
    every = (1 << len(item)) - 1
    row = every
    for code in passage.tolist():
        if mask := masks.get(code):
            met = row & mask
            row = ((row + met) | (row - met)) & every
    return len(item) - row.bit_count()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _search(items: Items, words: np.ndarray, limits: Limits):
    """Confirmed (id, item, cosine, common, answered) of whole texts."""
    scale = [max(0, int(np.ceil(np.log2(max(len(c) * limits.room / (2 * STEP), 1e-9))))) for c in items.codes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent = words.astype(np.float32)
        bags = [np.unique(c, return_counts=True) for c in items.codes]
        needed = np.array([limits.paraphrase * len(c) for c in items.codes]) - 1e-9
        queries = _unit(np.stack([latent[c].sum(axis=0) for c in items.codes]))
        # Items by word and how often they hold it, as runs of one array.
        order = np.argsort(np.concatenate([b for b, _ in bags]), kind="stable")
        word_of = np.concatenate([b for b, _ in bags])[order]
        item_of = np.repeat(np.arange(len(bags)), [len(b) for b, _ in bags])[order]
        times = np.concatenate([n for _, n in bags])[order]
        begin, end = np.searchsorted(word_of, np.arange(len(latent))), np.searchsorted(word_of, np.arange(len(latent)), "right")
        local = np.zeros(len(latent), np.int64)  # a word's place in the bag at hand, from 1
        for batch in batches:
            found = []
            for id_, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = np.frombuffer(raw.as_buffer(), "<i4")
                # A subsequence can't be longer than the item's words that the text holds.
                runs = [slice(begin[c], end[c]) for c in np.unique(codes).tolist() if c]
                if not runs:
                    continue
                held = np.bincount(np.concatenate([item_of[r] for r in runs]), np.concatenate([times[r] for r in runs]), len(bags))
                for item in np.flatnonzero(held >= needed).tolist():
                    step, (bag, most) = STEP << scale[item], bags[item]
                    local[bag] = np.arange(1, len(bag) + 1)
                    place = local[codes]
                    local[bag] = 0
                    best = None
                    for at in _passages(place, most, step, needed[item]):
                        passage = latent[codes[at : at + 3 * step]].sum(axis=0)
                        cosine = float(passage @ queries[item]) / max(float(np.sqrt(passage @ passage)), 1e-12)
                        if cosine < limits.cosine:
                            continue
                        near = codes[max(0, at - step) : at + 4 * step]
                        share = common_subsequence(items.codes[item], near) / len(items.codes[item])
                        if share < limits.paraphrase or best is not None and share <= best[1]:
                            continue
                        answer = items.answers[item]
                        answered = len(answer.intersection(near.tolist())) / len(answer)
                        if share >= limits.verbatim or answered >= limits.answer or not items.answered[item]:
                            best = (cosine, share, answered)
                    if best:
                        found.append((id_, items.ids[item], *best))
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            types = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["id", "item_id", "cosine", "common", "answered"])

    return run


def _passages(place: np.ndarray, most: np.ndarray, step: int, needed: float, rows: int = 4096) -> Iterator[int]:
    """Where passages begin that, with a step before and one behind, hold enough of an item's words.

    ``place`` has each word's place in the item's bag, from 1, or 0; a word counts
    as often as the item holds it, ``most``.
    """
    n_steps = -(-len(place) // step)
    n = max(n_steps - 2, 1)
    for first in range(0, n, rows):
        last = min(first + rows, n)
        low = max(first - 1, 0)
        part = place[low * step : (last + 3) * step]
        at = np.flatnonzero(part)
        held = np.zeros((last + 4 - low, len(most)), np.int32)
        np.add.at(held, (at // step + 1, part[at] - 1), 1)
        held = held.cumsum(axis=0)
        row = np.arange(first, last)
        counts = held[row + 4 - low] - held[np.maximum(row - 1, 0) - low]
        yield from (row[np.minimum(counts, most).sum(axis=1) >= needed] * step).tolist()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
) -> DataFrame:
    """(id, item_id, cosine, common, answered), one row per document row and item found in it.

    ``common`` is the share of the item's words in the common subsequence, and
    ``answered`` the share of the answer's words nearby. An item without an
    answer is decided by ``cosine`` and ``common``; its ``answered`` tells of its
    rarest words. Of equal shares, the first passage counts. Null or empty texts
    and items match nothing; items that repeat an id are each searched, as are
    repeated rows. Other columns are ignored. The benchmark's texts are taken to
    the driver.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    answer = F.lit(None).cast("string") if answer_col is None else F.col(answer_col)
    texts = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(item_text_col), answer)
    items = encode_items(sorted((tuple(r) for r in texts.collect()), key=repr))
    if not items.ids:
        return named.sparkSession.createDataFrame([], f"id {kind}, item_id long, cosine double, common double, answered double")
    coded = materialize(named.mapInArrow(_encode(items.vocabulary), f"id {kind}, codes binary"), "codes")
    words = _latent_words(coded, items, limits)
    out = None
    for at in range(0, len(items.ids), ITEMS):
        some = _search(items.part(at, at + ITEMS), words, limits)
        found = coded.mapInArrow(some, f"id {kind}, item_id long, cosine double, common double, answered double")
        out = found if out is None else out.unionByName(found)
    return out


def _latent_words(coded: DataFrame, items: Items, limits: Limits) -> np.ndarray:
    """The latent vector of each word, by code; sets the rarest words of items without an answer."""
    size = len(items.vocabulary) + 1
    counted = coded.mapInArrow(_frequencies(size, 4 * STEP), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    seen = Counter({r["code"]: r["n"] for r in counted})
    weight = np.array([0.0] + [np.log((seen[0] + 1) / (seen[c] + 1)) + 1e-3 for c in range(1, size)])
    spared = np.zeros(size, bool)
    for k, codes in enumerate(items.codes):
        rarest = sorted(set(codes.tolist()), key=lambda c: (-weight[c], c))
        spared[rarest[: -(-len(rarest) // 2)]] = True
        if not items.answers[k]:
            items.answers[k] = set(rarest[: limits.answer_words])
    often = np.array([seen[c] for c in range(size)]) > limits.common * max(seen[0], 1)
    weight[often & ~spared] = 0
    wide = min(limits.sketch, size)
    schema = "code long, " + ", ".join(f"g{k} double" for k in range(wide))
    sums = coded.mapInArrow(_gram(weight, wide, 4 * STEP), schema).groupBy("code").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(wide)]).collect()
    random, gram = _random(size, wide), np.zeros((size, wide))
    for r in sums:
        gram[r["code"]] = r[1:]
    share = max(seen[0], 1) / len(items.codes)
    for codes in items.codes:
        np.add.at(gram, codes, share * weight[codes][:, None] * (weight[codes] @ random[codes])[None, :])
    words = latent_map(gram, random, limits.rank) * weight[:, None]
    words[0] = 0
    return words
