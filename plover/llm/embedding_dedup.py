"""Embedding near-duplicates: random-hyperplane sign hashing in several tables.

Vectors with equal label and equal components form a class, so exact copies
never meet. Each of several codes is the signs of some random projections;
classes that share a code are compared by cosine in double precision, in blocks
(`buckets`). There are twice as many codes as the largest label has rows, 2^14
at least, so that unlike vectors rarely meet however large the table is. A pair
at a cosine of 0.98 differs in a sign with probability 0.064; as codes get
longer, tables are added so that it misses all of them 6 times in a million
(24 tables of 14 bits; 37 of 20; 70 of 30).

A pair that meets in several tables counts only in the first, which each task
sees from the codes that the rows carry. Tasks return each class's number of
links and edges that join what is linked, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.llm import buckets
from plover.llm.graph import connected_components, forest
from plover.session import materialize


#: The chance at most that a pair at the cosine that is asked for meets in no table.
MISS = 6.5e-6


def plan_tables(rows: int, cosine: float, bits: int = 14) -> tuple[int, int]:
    """(tables, bits) for labels of up to ``rows`` vectors: see the module."""
    bits = min(max(bits, math.ceil(math.log2(max(rows, 1))) + 1), 32)
    alike = 1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(alike**bits, 1 - 1e-9)))), bits


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([20240906, dim]).standard_normal((dim, tables * bits))


def _sketch(tables: int, bits: int):
    """Codes, and the vector in doubles; null codes where a vector can't link."""
    powers = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if x is None or None in x else np.asarray(x, np.float64) for x in batch.column(1).to_pylist()]
            rows = [x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None for x in rows]
            codes: list[bytes | None] = [None] * len(rows)
            for dim in {len(x) for x in rows if x is not None}:
                at = [k for k, x in enumerate(rows) if x is not None and len(x) == dim]
                stacked = np.stack([rows[k] for k in at])
                stacked = stacked / np.abs(stacked).max(axis=1, keepdims=True)  # no overflow in what follows
                signs = (stacked @ _planes(dim, tables, bits) > 0).reshape(len(at), tables, bits)
                for k, code in zip(at, (signs @ powers).astype("<u4"), strict=True):
                    codes[k] = code.tobytes()
            vectors = [None if x is None else x.astype("<f8").tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(vectors, pa.binary()), pa.array(codes, pa.binary())], ["id", "label", "vector", "codes"]
            )

    return run


def _links(cosine: float, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in buckets.whole_groups(batches, rows=4_000):
            ids, copies, table, keys, block = (group.column(c).to_numpy() for c in ("id", "copies", "table", "pair_key", "block"))
            alone = group.column("alone").to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), "<u4").reshape(-1, tables)
            raw = group.column("vector").to_pylist()
            dims = np.array([len(x) for x in raw])
            firsts, seconds = [], []
            wide = np.zeros((len(raw), dims.max() // 8))
            for k, x in enumerate(raw):
                wide[k, : len(x) // 8] = np.frombuffer(x, "<f8")
            wide /= np.abs(wide).max(axis=1, keepdims=True)
            wide /= np.sqrt((wide * wide).sum(axis=1, keepdims=True))
            for i, j in buckets.group_pairs(keys, block, alone):
                equal = codes[i] == codes[j]
                keep = equal[np.arange(len(i)), table[i]] & (equal.argmax(axis=1) == table[i]) & (dims[i] == dims[j])
                i, j = i[keep], j[keep]
                keep = np.einsum("ij,ij->i", wide[i], wide[j]) >= cosine
                firsts.append(i[keep])
                seconds.append(j[keep])
            if not firsts or not sum(map(len, firsts)):
                continue
            i, j = np.concatenate(firsts), np.concatenate(seconds)
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            some = np.flatnonzero(links)
            nodes, roots = forest(ids[i], ids[j])
            none = [None] * len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids[some].tolist(), *nodes]), pa.array([*none, *roots], pa.int64()), pa.array([*links[some].tolist(), *[0] * len(nodes)], pa.int64())],
                ["a", "b", "links"],
            )

    return run


def embedding_near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    tables: int | None = None,
    bits: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Per vector row: vec_id, n_links, component_id, kept.

    Vectors are compared within equal labels only. A vector that is null,
    empty, zero or holds a null or a non-finite component, or whose label is
    null, links with nothing and is its own component. Vectors of different
    lengths aren't linked. Repeated rows count as vectors of their own, and so
    do different vectors of one id. A vector without an id has a component
    without an id unless it is linked with one that has; such a component keeps
    its rows. Other columns are ignored. ``tables`` and ``bits`` follow the
    largest label (`plan_tables`) unless both are given.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    if tables is None or bits is None:
        most = named.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        tables, bits = plan_tables(most or 0, cosine)
    schema = "id long, label string, vector binary, codes binary"
    sketch = materialize(named.select("id", "vector", "label").mapInArrow(_sketch(tables, bits), schema), "vectors")
    usable = sketch.filter("codes is not null and label is not null")
    content = F.sha2(F.col("vector"), 256)
    classes = usable.groupBy("label", content.alias("content")).agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("codes").alias("codes"), F.min("vector").alias("vector"))
    # Ids may repeat, so classes get numbers of their own; they are written with the table and don't change.
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = usable.select(F.col("id").alias("member"), F.col("label").alias("m_label"), content.alias("m_content"))

    code = lambda t: F.substring("codes", 4 * t + 1, 4)
    coded = classes.select("id", "label", F.posexplode(F.array(*[code(t) for t in range(tables)])).alias("table", "code"))
    shared = coded.groupBy(F.col("table").alias("t"), F.col("label").alias("l"), F.col("code").alias("c")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    met = coded.join(shared, (F.col("table") == F.col("t")) & (F.col("label") == F.col("l")) & (F.col("code") == F.col("c"))).select("table", "id", "label", "code")
    full = classes.select(F.col("id").alias("v_id"), "copies", "codes", "vector")
    rows = met.join(full, F.col("id") == F.col("v_id")).drop("v_id")
    blocks = buckets.block_pairs(rows, ["table", "label", "code"], "id")
    blocks = blocks.select("id", "copies", "table", "codes", "vector", "pair_key", "block", "alone")
    found = materialize(blocks.mapInArrow(_links(cosine, tables), "a long, b long, links long"), "found")

    counts = found.groupBy(F.col("a").alias("n_id")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("b is not null").select("a", "b"))
    by_class = classes.join(counts, F.col("id") == F.col("n_id"), "left").join(parts, F.col("id") == F.col("node"), "left").select(
        F.col("label").alias("m_label"), F.col("content").alias("m_content"), "least_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("part"),
    )
    by_class = materialize(by_class, "parts")
    named_parts = by_class.groupBy(F.col("part").alias("p")).agg(F.min("least_id").alias("component"))
    by_class = by_class.join(named_parts, F.col("part") == F.col("p"))
    linked = members.join(by_class, ["m_label", "m_content"]).select("member", "n_links", "component")
    lone = sketch.filter("codes is null or label is null").select(F.col("id").alias("member"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(lone).select(
        F.col("member").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("member").eqNullSafe(F.col("component")).alias("kept")
    )
