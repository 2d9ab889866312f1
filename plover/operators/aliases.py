"""Containment of many patterns in whole texts: company aliases and query terms from tables.

A block of up to ``BLOCK`` patterns becomes an automaton in each task, which
reads a text once however many patterns it looks for. Texts stay where they
are: each block is one more pass over them, not a shuffle, so the memory of a
task is bounded by the block and by its longest text. What a text holds is
settled in its task and handed on ``ROWS`` rows at a time; only texts of
repeated keys are grouped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.operators import ranks
from plover.operators.joins import BROADCAST_ROWS
from plover.session import bounded_batches

#: Patterns that a task looks for at once.
BLOCK = 50_000

#: Hits after which a task hands them on.
ROWS = 50_000

_WORD = re.compile("[A-Za-z0-9_]")


def plain(text: str | None) -> str:
    """Compatibility form in lower case, with single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split()) if text else ""


def _automaton(patterns: list[tuple[int, str, int]]) -> tuple[ahocorasick.Automaton, list[tuple[np.ndarray, np.ndarray]]]:
    """(automaton, lists) of patterns (place, text, group): each text's groups and the least place in each."""
    lists: dict[str, dict[int, int]] = {}
    for place, pattern, group in patterns:
        known = lists.setdefault(pattern, {})
        known[group] = min(place, known.get(group, place))
    found = ahocorasick.Automaton()
    for n, pattern in enumerate(lists):
        found.add_word(pattern, (n, len(pattern)))
    found.make_automaton()
    return found, [(np.fromiter(g, np.int64, len(g)), np.fromiter(g.values(), np.int64, len(g))) for g in lists.values()]


def _inside(line: str, start: int, end: int) -> bool:
    return bool((_WORD.match(line[start]) and start and _WORD.match(line[start - 1])) or (_WORD.match(line[end]) and end + 1 < len(line) and _WORD.match(line[end + 1])))


def _firsts(patterns: list[tuple[int, str, int]], whole_words: bool):
    """A row (key, place) per text and group: the first of the group's patterns that the text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lists = _automaton(patterns)
        none = np.iinfo(np.int64).max
        first = np.full(1 + max((int(g.max()) for g, _ in lists), default=0), none)
        for batch in batches:
            rows, places, held = [], [], 0
            for at, text in enumerate(batch.column(1)):
                line = plain(text.as_py())
                seen = {n for end, (n, size) in found.iter(line) if not (whole_words and _inside(line, end - size + 1, end))}
                for n in seen:
                    groups, least = lists[n]
                    first[groups] = np.minimum(first[groups], least)
                if seen:
                    groups = np.flatnonzero(first < none)
                    rows.append(np.full(groups.size, at))
                    places.append(first[groups])
                    first[groups] = none
                    held += groups.size
                if held >= ROWS:
                    yield _taken(batch, rows, places)
                    rows, places, held = [], [], 0
            yield _taken(batch, rows, places)

    return run


def _taken(batch: pa.RecordBatch, rows: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
    at, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, places))
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(place, pa.int64())], ["key", "place"])


def _named(hits, names: list[tuple[int, str, str]]):
    """``hits`` with the company and the alias of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {place: k for k, (place, _, _) in enumerate(names)}
        known = np.fromiter(at, np.int64, len(at))
        order = np.argsort(known)
        columns = [pa.array([n[k] for n in names], pa.string()) for k in (1, 2)]
        for batch in hits(batches):
            k = pa.array(order[np.searchsorted(known[order], batch.column(1).to_numpy())] if len(batch) else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[c.take(k) for c in columns], batch.column(1)], ["key", "company", "alias", "place"])

    return run


def pattern_hits(texts: DataFrame, patterns: DataFrame, order: list[str], key: str, text: str, pattern: str, whole_words: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(hits, numbered): a row (key, place) per text and pattern that it contains, and the patterns by place.

    Both sides are compared in compatibility form, lower case and single
    spaces. ``order`` tells all patterns apart and numbers them from 1; blank
    ones match nothing. With ``whole_words`` a hit does not begin or end inside
    an ASCII word. Keys may be null or repeat: a row of ``texts`` gives its own
    hits. Empty tables give no hits.
    """
    usable = patterns.filter(F.length(F.trim(F.coalesce(F.col(pattern), F.lit("")))) > 0)
    numbered = ranks.row_number(usable, order, "place")
    kind = texts.schema[key].dataType.simpleString()
    bounded_batches(texts.sparkSession)
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    most = numbered.agg(F.max("place")).first()[0] or 0
    passes = []
    for first in range(1, most + 1, block):
        part = numbered.filter(F.col("place").between(first, first + block - 1)).select("place", pattern).collect()
        named = [(r["place"], plain(r[pattern]), k) for k, r in enumerate(part)]
        passes.append(rows.mapInArrow(_firsts([x for x in named if x[1]], whole_words), f"key {kind}, place long"))
    none = rows.select("key", F.lit(0).cast("long").alias("place")).limit(0)
    return reduce(DataFrame.unionByName, passes) if passes else none, numbered


def alias_matches(texts: DataFrame, aliases: DataFrame, key: str = "key", text: str = "text", whole_words: bool = False, block: int = BLOCK) -> DataFrame:
    """(key, company, alias, place): per text and company the first of its aliases that the text contains.

    ``aliases`` (company, alias, and ``rank`` if their order matters beyond
    company and alias). A company's aliases are looked for in one pass, so each
    task knows the first of them and nothing is shuffled; only rows of keys that
    repeat, and all rows if a company has more than ``block`` aliases, are grouped.
    """
    order = [*(["rank"] if "rank" in aliases.columns else []), "company", "alias"]
    usable = aliases.dropDuplicates(order).filter(F.length(F.trim(F.coalesce(F.col("alias"), F.lit("")))) > 0)
    numbered = ranks.row_number(usable, order, "place")
    most, whole = numbered.agg(F.max("place")).first()[0] or 0, True
    if most > block:
        whole = not numbered.groupBy("company").count().filter(F.col("count") > block).limit(1).count()
        numbered = ranks.row_number(numbered, ["company", "place"], "_n")
        if whole:
            firsts = numbered.groupBy(F.col("company").alias("_c")).agg(F.min("_n").alias("_first"))
            numbered = numbered.join(firsts, F.col("company").eqNullSafe(F.col("_c"))).withColumn("_n", F.col("_first")).drop("_c", "_first")
    else:
        numbered = numbered.withColumn("_n", F.col("place"))
    bounded_batches(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    schema = f"key {kind}, company string, alias string, place long"
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    passes = []
    for first in range(1, most + 1, block):
        part = numbered.filter(F.col("_n").between(first, first + block - 1)).select("place", F.col("company").cast("string").alias("company"), F.col("alias").cast("string").alias("alias")).collect()
        groups = {c: k for k, c in enumerate(dict.fromkeys(r["company"] for r in part))}
        patterns = [(r["place"], plain(r["alias"]), groups[r["company"]]) for r in part]
        passes.append((_firsts([x for x in patterns if x[1]], whole_words), [tuple(r) for r in part]))
    look = lambda some: reduce(DataFrame.unionByName, [some.mapInArrow(_named(hits, names), schema) for hits, names in passes])
    if not passes:
        return rows.select("key", *[F.lit("").alias(c) for c in ("company", "alias")], F.lit(0).cast("long").alias("place")).limit(0)
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("_again"))
    several = again.limit(BROADCAST_ROWS + 1).count() if whole else 0
    if whole and not several:
        return look(rows)
    firsts = lambda found: found.groupBy("key", "company").agg(F.min(F.struct("place", "alias")).alias("a")).select("key", "company", "a.alias", "a.place")
    if not whole or several > BROADCAST_ROWS:
        return firsts(look(rows))
    repeats = lambda how: rows.join(F.broadcast(again), F.col("key").eqNullSafe(F.col("_again")), how)
    return look(repeats("left_anti")).unionByName(firsts(look(repeats("left_semi"))))
