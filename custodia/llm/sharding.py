"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring. A key belongs to the arc before a point, and goes to that
point's shard; if the shard is full, the key continues clockwise to the next shard that is not.
The capacities add up to the number of rows, so no shard ever holds more than its share.

Keys are not walked one by one. The arcs' row counts, a number fixed by the parameters, decide how
many rows of every arc each shard takes; within an arc, rows are ranked by a fixed order and cut at
those counts. Ranks are counted per slice of an arc with offsets from the slices' counts, so a
crowded arc is spread over tasks. Equal rows (key, size and text) are counted before the shuffle
and told apart again once their ranks are known."""

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import text_of
from custodia.session import materialize

RING = 1 << 16  # points of the ring
SLICES = 64  # of an arc
COPIES_AT_ONCE = 10_000
VIRTUAL_NODES = 64  # of a shard


def ring_point(key: Column) -> Column:
    """The place of a key on the ring; null keys share one."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(RING)).cast("int")


def ring(spark, shards: int, virtual_nodes=VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes, clockwise; a point belongs to its smallest shard."""
    nodes = spark.range(shards).select(
        F.col("id").cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("v"),
    )
    at = ring_point(F.concat_ws("#", F.lit("node"), "shard", "v"))
    found = nodes.select(at.alias("point"), "shard").groupBy("point").agg(F.min("shard").alias("shard"))
    return sorted((r.point, r.shard) for r in found.collect())


def capacities(rows: int, shards: int, slack=0.0) -> list[int]:
    """How many rows each shard may hold: equal shares, at most one apart, plus ``slack`` of them."""
    extra = int(slack * rows / shards)
    return [rows // shards + (s < rows % shards) + extra for s in range(shards)]


def plan(nodes: list[tuple[int, int]], counts: dict[int, int], limits: list[int]):
    """(arc, first rank, end rank, shard, first slot): which ranks of each arc a shard takes.

    All arcs offer their rows to their first shard, then what was refused to the next one clockwise
    and so on; a shard accepts arcs in ring order until it is full. The work is bounded by the
    number of virtual nodes."""
    shards = len(limits)
    ways = []
    for arc in range(len(nodes)):
        order = [s for _, s in nodes[arc:] + nodes[:arc]]
        seen = list(dict.fromkeys(order))
        ways.append(seen + [s for s in range(shards) if s not in seen])
    taken, left, placed = [0] * shards, list(limits), {a: 0 for a in counts}
    parts = []
    for turn in range(shards):
        for arc in sorted(counts):
            shard = ways[arc][turn]
            n = min(counts[arc] - placed[arc], left[shard])
            if n > 0:
                parts.append((arc, placed[arc], placed[arc] + n, shard, taken[shard]))
                placed[arc] += n
                taken[shard] += n
                left[shard] -= n
    return parts


def shard(docs: DataFrame, key="doc_id", text_col="text", shards=8, virtual_nodes=VIRTUAL_NODES, slack=0.0) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row.

    ``size`` is the text's UTF-8 bytes plus one (null: none plus one), ``text_crc32`` their CRC-32,
    ``slot`` the row's place in its shard, gapless from 0. With no slack the shards' row counts are
    at most one apart. Rows of a null key share a place on the ring and overflow like any other;
    equal rows may go to different shards. An empty table gives an empty result."""
    spark = docs.sparkSession
    text = F.encode(text_of(text_col), "UTF-8")
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(text_of(text_col)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        ring_point(F.col(key)).alias("point"),
    )
    slice_ = F.pmod(F.xxhash64(F.col("_key").cast("string"), "text_crc32", "size"), F.lit(SLICES)).cast("int")
    rows = rows.groupBy("_key", "size", "text_crc32", "point").agg(F.count("*").alias("copies"))
    rows = materialize(rows.withColumn("slice", slice_), "shard-keys")
    nodes = ring(spark, shards, virtual_nodes)
    points = [p for p, _ in nodes]
    arc_of = [bisect.bisect_left(points, p) % len(points) for p in range(RING)]
    runs, start = [], 0
    for p in range(1, RING + 1):
        if p == RING or arc_of[p] != arc_of[start]:
            runs.append((start, p - 1, arc_of[start]))
            start = p
    arcs = (
        spark.createDataFrame(runs, "first int, last int, arc int")
        .select(F.explode(F.sequence("first", "last")).alias("point"), "arc")
    )
    placed = rows.join(F.broadcast(arcs), "point")  # RING rows
    slices = placed.groupBy("arc", "slice").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("arc").orderBy("slice")
    slices = materialize(slices.withColumn("before", F.sum("n").over(before) - F.col("n")), "shard-slices")
    counts = {r.arc: r.n for r in slices.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    parts = plan(nodes, counts, capacities(sum(counts.values()), shards, slack))
    parts = spark.createDataFrame(parts, "arc int, low long, high long, shard int, base long")
    in_slice = Window.partitionBy("arc", "slice").orderBy("point", "_key", "text_crc32", "size")
    first = F.sum("copies").over(in_slice) - F.col("copies")
    step, last = F.lit(COPIES_AT_ONCE), F.col("copies") - 1
    ranked = (
        placed.withColumn("first", first)
        .withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), last, step.cast("long"))))
        .withColumn("copy", F.explode(F.sequence("some", F.least(last, F.col("some") + step - 1))))
        .withColumn("nth", F.col("first") + F.col("copy"))
    )
    # as many rows as arcs have slices, and at most shards per arc: both fixed by the parameters
    offsets = slices.select(F.col("arc").alias("_a"), F.col("slice").alias("_s"), "before")
    ranked = ranked.join(F.broadcast(offsets), (F.col("arc") == F.col("_a")) & (F.col("slice") == F.col("_s")))
    rank = F.col("before") + F.col("nth")
    parts = parts.withColumnRenamed("arc", "_arc")
    cut = ranked.join(
        F.broadcast(parts), (F.col("arc") == F.col("_arc")) & (rank >= F.col("low")) & (rank < F.col("high"))
    )
    return cut.select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("base") + rank - F.col("low")).alias("slot")
    )
