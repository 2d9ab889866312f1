"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame and SQL functions are used.

1. Each source's size in words gives its target (`mixture_targets`).
2. A source's documents are dealt by hash into about sqrt(count) blocks, so
   neither the blocks of a source nor the documents of a block pile up in one
   task, however hot the source is.
3. The target is spent on whole passes over all blocks, then on blocks in
   permuted order; the last block is spent on documents in permuted order and
   the last document on its first words, so that each source meets its target
   to the word.
4. The number of block draws of every source is split down a binary tree over
   the output shards. Each node hands its left half an exact multivariate
   hypergeometric draw of its quotas, by selection sampling with hashed
   uniforms, so reruns agree.
5. A source's permuted draws are dealt to the shards in runs as long as the
   leaf quotas; the runs are disjoint. `local_order` shuffles within a shard.

Defined results: a null text has size 0; a null source is a source of its own,
ranked last; a source of size 0 has target 0; repeated rows count as separate
documents; an empty table gives an empty result. Other columns are ignored, so
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixture_targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, n_docs, source_size, target.

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times the total size. A target stops at ``cap`` times its
    source's size and the excess goes to the others by weight. The water level
    is found in closed form: in ascending order of cap per weight, the first
    source whose level stays under its cap sets the level for all the rest.
    The windows without a key see one row per source, not per document.
    """
    stats = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stats.withColumn("weight", F.element_at(choices, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy("cap_per_weight", F.col("source").asc_nulls_last())
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("cap_per_weight", F.col("most") / F.col("weight"))
        .withColumn("place", F.row_number().over(by_cap))
        .withColumn("before", F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest_weight", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest_weight"))
    )
    first = F.min(F.when(F.col("level") < F.col("cap_per_weight"), F.struct("place", "level"))).over(everything)
    reached = F.coalesce(first["level"] * F.col("weight"), F.col("most"))
    return levels.withColumn("target", F.least(F.col("most"), reached)).select("source", "n_docs", "source_size", "target")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, draws) for the whole mix to (shard, source, draws) for each shard.

    ``shards`` is a power of two. At each level one row per node holds the
    quotas of all sources; selection sampling over the node's draws is an exact
    multivariate hypergeometric draw of those that go left.
    """
    depth = shards.bit_length() - 1
    if shards != 1 << depth:
        raise ValueError("shards must be a power of two")
    item = "array<struct<source:string,draws:bigint>>"
    nodes = quotas.filter("draws > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "draws"))).cast(item).alias("items")).select(F.lit(0).alias("node"), "items")
    for level in range(depth):
        uniform = f"(shiftrightunsigned(xxhash64({seed}, {level}, node, coalesce(it.source, ''), it.source is null, i), 11) * {2.0**-53!r}D)"
        urn = f"""aggregate(sequence(1L, it.draws), named_struct('want', acc.want, 'left_in', acc.left_in, 'took', 0L),
            (a, i) -> if({uniform} * a.left_in < a.want,
                named_struct('want', a.want - 1L, 'left_in', a.left_in - 1L, 'took', a.took + 1L),
                named_struct('want', a.want, 'left_in', a.left_in - 1L, 'took', a.took)),
            a -> named_struct('want', a.want, 'left_in', a.left_in,
                'out', concat(acc.out, array(named_struct('source', it.source, 'draws', a.took)))))"""
        start = f"named_struct('want', total div 2, 'left_in', total, 'out', cast(array() as {item}))"
        split = (
            nodes.withColumn("total", F.expr("aggregate(items, 0L, (s, x) -> s + x.draws)"))
            .withColumn("lefts", F.expr(f"aggregate(items, {start}, (acc, it) -> {urn}, acc -> acc.out)"))
            .withColumn("rights", F.expr("zip_with(items, lefts, (x, y) -> named_struct('source', x.source, 'draws', x.draws - y.draws))"))
        )
        halves = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("lefts").alias("items")), F.struct((F.col("node") * 2 + 1).alias("node"), F.col("rights").alias("items"))))
        nodes = split.select(halves.alias("half")).select(F.col("half.node").alias("node"), F.expr("filter(half.items, x -> x.draws > 0)").alias("items"))
        nodes = nodes.repartition("node")
    return nodes.select(F.col("node").alias("shard"), F.explode("items").alias("item")).select("shard", "item.source", "item.draws")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 16,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix, one row per document row.

    Columns: doc_id, source, size, source_size, target, taken, and
    copies ARRAY<STRUCT<copy, shard, words, local_order>> with an entry for
    each time that the document is drawn; ``words`` under the document's size
    means its first words only.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
            key.alias("key"), F.xxhash64(F.col(text_col)).alias("content"),
        ),
        "sized",
    )
    targets = materialize(mixture_targets(sized, weights, share, cap), "targets")
    quota = F.round("target").cast("long")
    plan = (
        targets.withColumn("n_blocks", F.greatest(F.ceil(F.sqrt("n_docs")), F.lit(1)).cast("long"))
        .withColumn("passes", F.coalesce(F.try_divide(quota, F.col("source_size")).cast("long"), F.lit(0)))
        .withColumn("rest", quota - F.col("passes") * F.col("source_size"))
    )
    plan = plan.withColumnRenamed("source", "p_source")
    blocked = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "doc_id", "source", "size", "key", "content", "source_size", "target", "passes", "rest", F.pmod("key", "n_blocks").alias("block")
    )
    blocks = blocked.groupBy("source", "block", "passes", "rest").agg(F.sum("size").alias("block_size"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), F.coalesce("source", F.lit("")), F.col("block")), "block")
    before = F.coalesce(F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = materialize(
        blocks.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("block_size"), F.col("rest") - before)))
        .withColumn("draws", F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)),
        "blocks",
    )
    leaves = split_quotas(blocks.groupBy("source").agg(F.sum("draws").alias("draws")), shards, seed + 2)
    runs = Window.partitionBy("source").orderBy("shard")
    ends = leaves.withColumn("end", F.sum("draws").over(runs))
    slots = ends.select(F.col("source").alias("slot_source"), "shard", F.explode(F.sequence(F.col("end") - F.col("draws") + 1, F.col("end"))).alias("place"))
    token_order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 3), F.coalesce("source", F.lit("")), F.col("block"), F.col("copy")), "block", "copy")
    tokens = blocks.filter("draws > 0").select("source", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("copy"))
    tokens = tokens.withColumn("slot", F.row_number().over(token_order).cast("long"))
    dealt = tokens.join(slots, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("slot") == F.col("place"))).groupBy(F.col("source").alias("d_source"), F.col("block").alias("d_block")).agg(
        F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("drawn")
    )
    block_plan = (
        blocks.join(dealt, F.col("source").eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block")), "left")
        .select(F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), "block_size", "extra", "drawn")
    )
    full = blocked.join(block_plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("block") == F.col("plan_block")))
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("block_size"))
    # Only the one partly taken block of each source is ordered by document.
    in_block = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 4), F.col("key")), "doc_id", "size", "content")
    begun = F.coalesce(F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = full.filter(~partial).withColumn("more", F.when(F.col("extra") > 0, F.col("size")).otherwise(F.lit(0)))
    cut = full.filter(partial).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - begun)))
    entry = lambda d: F.struct(
        d["copy"].cast("int").alias("copy"), d["shard"].cast("int").alias("shard"),
        F.when(d["copy"] <= F.col("passes"), F.col("size")).otherwise(F.col("more")).alias("words"),
        F.xxhash64(F.lit(seed + 5), F.col("key"), d["copy"]).alias("local_order"),
    )
    copies = F.filter(F.transform(F.coalesce("drawn", F.array().cast("array<struct<copy:bigint,shard:int>>")), entry), lambda c: c["words"] > 0)
    return whole.unionByName(cut).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("more")).alias("taken"), copies.alias("copies"),
    )
