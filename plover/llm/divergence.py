"""Divergence of sources by their terms, counted in mergeable radix tries.

Each task counts the terms of its documents in one byte trie a language, whose
leaves hold the documents and, by source, the occurrences of a term. Tries are
sent as their leaves, in UTF-8 order, and merged by ranges of (language, term):
Spark draws the ranges from a sample, so none grows with one prefix, and a task
merges its range block by block. Traversals stream the merged leaves in UTF-8
order, as blocks of whole terms.

A block, with the totals of its language's sources beside it, is one matrix of
counts: it gives the block's part of the divergence of each pair of sources and
its best terms a source, equal ones in UTF-8 order. The sums and the best of the
bests are taken by Spark. Nothing is collected or broadcast; a task holds a
block of ``BLOCK`` terms, and the sources of one language.
"""

from __future__ import annotations

import functools
import gc
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plover.session import materialize

#: Terms of a block, and entries of a task's counters before they go to a trie and out.
BLOCK = 2_048
MOST_ENTRIES = 600_000

SCALE = 1_000_000_000
LEAVES = "lang string, term string, docs long, sources array<string>, counts array<long>"

#: Other bytes than letters and those of non-ASCII characters part terms; only A-Z are lower-cased.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


class RadixTrie:
    """Byte trie with whole strings on its edges.

    A node is [edge, children by first byte, leaf]; a leaf is [documents,
    occurrences by source].
    """

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.leaves = 0

    @classmethod
    def of_sorted(cls, leaves: Iterable[tuple[bytes, list]]) -> RadixTrie:
        """A trie of (term, leaf) that come in byte order, none twice: each term goes on from the path of the last."""
        trie, last = cls(), b""
        path: list[tuple[list, int]] = [(trie.root, 0)]
        child = trie.root
        for term, leaf in leaves:
            shared = 0
            for x, y in zip(last, term, strict=False):
                if x != y:
                    break
                shared += 1
            while path[-1][1] > shared:
                child, _ = path.pop()
            node, depth = path[-1]
            if depth < shared:
                edge, cut = child[0], shared - depth
                child[0] = edge[cut:]
                middle = node[1][edge[0]] = [edge[:cut], {edge[cut]: child}, None]
                node = middle
                path.append((middle, shared))
            new = node[1][term[shared]] = [term[shared:], {}, leaf]
            path.append((new, len(term)))
            last = term
            trie.leaves += 1
        return trie

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """(term, leaf) in UTF-8 order."""
        open_ = [(b"", self.root)]
        while open_:
            before, node = open_.pop()
            term = before + node[0]
            if node[2] is not None:
                yield term, node[2]
            if node[1]:
                open_ += [(term, node[1][b]) for b in sorted(node[1], reverse=True)]


def _leaf_batch(rows: list[tuple[str, bytes, list]], more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    sources, counts, ends = [], [], [0]
    for _, _, (_, found) in rows:
        sources += found
        counts += found.values()
        ends.append(len(sources))
    offsets = pa.array(ends, pa.int32())
    columns = {
        "lang": pa.array([r[0] for r in rows], pa.string()),
        "term": pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
        "docs": pa.array([r[2][0] for r in rows], pa.int64()),
        "sources": pa.ListArray.from_arrays(offsets, pa.array(sources, pa.string())),
        "counts": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
    } | (more or {})
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _tries(docs: dict[str, Counter], counts: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
    """Counters as tries, one a language, and their leaves in order."""
    for lang in sorted(docs):
        leaves = {term: [n, {}] for term, n in docs[lang].items()}
        for (other, source), found in counts.items():
            if other == lang:
                for term, n in found.items():
                    leaves[term][1][source] = n
        rows = []
        for term, leaf in RadixTrie.of_sorted(sorted(leaves.items())).walk():
            rows.append((lang, term, leaf))
            if len(rows) == 10_000:
                yield _leaf_batch(rows)
                rows = []
        if rows:
            yield _leaf_batch(rows)


def _uncollected(run):
    """The function with the cyclic garbage collector off: its millions of leaves hold no cycles, and looking for them takes longer than the work."""

    @functools.wraps(run)
    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return quiet


@_uncollected
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: dict[str, Counter] = defaultdict(Counter)
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    since = 0
    for batch in batches:
        for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = terms(text.as_py())
            counts[lang, source].update(found)
            docs[lang].update(set(found))
            since += len(found)
            if since > MOST_ENTRIES:
                since = 0
                if sum(map(len, counts.values())) > MOST_ENTRIES:
                    yield from _tries(docs, counts)
                    docs.clear()
                    counts.clear()
    yield from _tries(docs, counts)


def _names(column: pa.Array) -> list[str]:
    """Values of a column with few different ones."""
    coded = column.dictionary_encode()
    known = coded.dictionary.to_pylist()
    return [known[k] for k in coded.indices.to_numpy().tolist()]


def _bytes(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def _merge(least_docs: int, block: int):
    """Merge leaves that come sorted by language and term; keep frequent terms, in named blocks."""

    def emit(lang: str, leaves: dict[bytes, list]) -> pa.RecordBatch:
        rows = [(lang, term, leaf) for term, leaf in RadixTrie.of_sorted(leaves.items()).walk() if leaf[0] >= least_docs]
        first = next(iter(leaves))
        return _leaf_batch(rows, {"block": pa.array([first] * len(rows), pa.binary()).cast(pa.string())})

    @_uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaves, last, leaf = None, {}, None, [0, {}]
        for batch in batches:
            langs, words, docs = _names(batch.column(0)), _bytes(batch.column(1)), batch.column(2).to_numpy().tolist()
            sources, counts = _names(batch.column(3).flatten()), batch.column(4).flatten().to_numpy().tolist()
            sizes, at = batch.column(3).value_lengths().to_numpy().tolist(), 0
            for lang, term, n, size in zip(langs, words, docs, sizes, strict=True):
                if lang != now or term != last:
                    if lang != now or len(leaves) >= block:
                        if leaves:
                            yield emit(now, leaves)
                        leaves = {}
                    now, last = lang, term
                    leaf = leaves[term] = [0, {}]
                leaf[0] += n
                mine = leaf[1]
                for k in range(at, at + size):
                    source = sources[k]
                    mine[source] = mine.get(source, 0) + counts[k]
                at += size
        if leaves:
            yield emit(now, leaves)

    return run


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / totals) in whole numbers, by long division so that nothing overflows."""
    rest, found = counts, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // totals
        rest = rest % totals
    return found + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _block_scores(top: int):
    def run(key: tuple, leaves: pa.Table, totals: pa.Table) -> pa.Table:
        """Parts of the pairs and the best terms of one block."""
        totals = totals.sort_by("source")
        lang, names = key[0].as_py(), totals.column("source").to_pylist()
        rows: list[tuple[str, str, str, int]] = []
        if leaves.num_rows:
            leaves = leaves.sort_by("term")
            place = {s: k for k, s in enumerate(names)}
            words = leaves.column("term").to_pylist()
            counts = np.zeros((len(words), len(names)), np.int64)
            for k, (sources, found) in enumerate(zip(leaves.column("sources").to_pylist(), leaves.column("counts").to_pylist(), strict=True)):
                counts[k, [place[s] for s in sources]] = found
            n, kept = totals.column("n").to_numpy(), int(totals.column("kept")[0].as_py())
            p = shares(counts + 2, n + 2 * kept)
            q = shares(counts.sum(axis=1) + 2, np.array(n.sum() + 2 * kept))
            for g, name in enumerate(names):
                rows += [("pair", name, names[h], v) for h, v in enumerate(_gap(p, p[:, [g]]).sum(axis=0).tolist()) if h != g]
                some = np.flatnonzero((counts[:, g] > 0) & (p[:, g] > q))
                value = _gap(p[some, g], q[some])
                best = np.lexsort((some, -value))[:top]
                rows += [("term", name, words[some[b]], int(value[b])) for b in best]
        else:
            rows = [("pair", a, b, 0) for a in names for b in names if a != b]
        return pa.table(
            {
                "lang": pa.array([lang] * len(rows), pa.string()), "source": pa.array([r[1] for r in rows], pa.string()), "part": pa.array([r[0] for r in rows], pa.string()),
                "item": pa.array([r[2] for r in rows], pa.string()), "value": pa.array([r[3] for r in rows], pa.int64()),
            }
        )

    return run


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): see the module.

    ``pair``: the sum over the kept terms of the language of
    floor((p - q)^2 / (p + q)) between a source and each other source of its
    language; all are ranked. ``term``: the ``top`` kept terms that a source
    uses more than its language does. Kept are the terms of ``least_docs``
    documents of the language at least; p is 1 + floor(10^9 (count + 2) /
    (total + 2 kept)). Ranks order by value, descending, and then by UTF-8.
    Null text, language or source is ''. A document counts once for each of its
    rows; a source without terms has pairs of its own, and a language without
    kept terms has pairs of value 0. Other columns are ignored; an empty table
    gives no rows.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = docs.select(blank(text_col).alias("text"), blank(lang_col).alias("lang"), blank(source_col).alias("source"))
    parts = materialize(named.mapInArrow(_count, LEAVES), "leaves")
    dealt = parts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    leaves = materialize(dealt.mapInArrow(_merge(least_docs, block), f"{LEAVES}, block string"), "merged")

    used = leaves.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    every = named.select("lang", "source", F.lit(0).cast("long").alias("n"))
    totals = every.groupBy("lang", "source").agg(F.sum("n").alias("n")).unionByName(used).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = leaves.groupBy(F.col("lang").alias("k_lang")).agg(F.count(F.lit(1)).alias("kept"))
    totals = totals.join(kept, F.col("lang") == F.col("k_lang"), "left").select("lang", "source", "n", F.coalesce("kept", F.lit(0)).alias("kept"))
    totals = materialize(totals, "totals")
    # A block of no terms a language, so that pairs come out where no term is kept.
    blocks = leaves.select("lang", "block").unionByName(totals.select("lang", F.lit("").alias("block"))).distinct()
    beside = totals.join(blocks.withColumnRenamed("lang", "b_lang"), F.col("lang") == F.col("b_lang")).select(F.col("lang").alias("t_lang"), F.col("block").alias("t_block"), "source", "n", "kept")
    matched = leaves.select("lang", "block", "term", "sources", "counts").groupBy("lang", "block").cogroup(beside.groupBy("t_lang", "t_block"))
    scored = matched.applyInArrow(_block_scores(top), "lang string, source string, part string, item string, value long")
    scored = materialize(scored, "scored")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = scored.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    best = scored.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(best)
