"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 values have it.
Two fingerprints within ``distance`` bits share a bit pattern at most half that distance from
either, so every distinct fingerprint emits its whole ball of that radius, and those that meet on
a variant are linked.

A ball of radius 2 has 2081 variants, too many to shuffle one by one. They are shuffled by their
leading bits: a fingerprint goes once to each prefix that its ball reaches (1 + L + L(L-1)/2
rows for L bits), and the rest of the ball is spelled out where the prefix is. L grows with the
logarithm of the number of fingerprints, so a prefix always holds about as many variants. A
crowded prefix is walked bit by bit, so memory is bounded however alike the fingerprints are.

Copies are one fingerprint before anything is emitted. A task links the fingerprints that it
holds among themselves and emits one link per fingerprint at most, never a pair per copy. Links
are then joined to components by alternating star contraction, in Spark, with every round written
to the shared folder."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm import common
from custodia.session import materialize

SEED = 42
BITS = 64
VARIANTS_PER_PREFIX = 1 << 20
VARIANTS_AT_ONCE = 1 << 21


def _majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One fingerprint per text from its shingles' hashes."""
    counts = np.diff(offsets)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    step = 1 << 17
    sums = np.zeros((len(counts), BITS), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for start in range(0, len(hashes), step):
        part = hashes[start : start + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who = owner[start : start + step]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        sums[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    over = (2 * sums[full] > counts[full, None]).astype(np.uint8)
    out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", words=4) -> DataFrame:
    """(id, fp): every row's fingerprint as a signed 64-bit number; zero for texts without a word.

    Null texts count as empty. Null and repeated ids keep their rows."""

    def run(batch):
        flat, offsets = common.split_words(
            common.string_array(batch.column("_text")), common.white_table(lower=True)
        )
        pieces, at = common.shingles(flat, offsets, words)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(p, SEED) for p in pieces), np.uint64, len(pieces))
        return pa.record_batch([batch.column("_id"), pa.array(_majority(hashes, at).view(np.int64))], ["_id", "fp"])

    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = chosen.schema["_id"].dataType.simpleString()
    return common.run_arrow(chosen, run, f"_id {kind}, fp long", "_text")


def _masks(width: int, flips: int) -> np.ndarray:
    """All patterns of ``width`` bits with at most ``flips`` set."""
    found = {0}
    for _ in range(flips):
        found |= {m | (1 << b) for m in found for b in range(width)}
    return np.array(sorted(found), np.uint64)


def _ball(width: int, flips: int) -> int:
    return sum(math.comb(width, i) for i in range(flips + 1))


def _links(rows, low, left, width, distance):
    """Links among fingerprints whose balls meet below one prefix.

    ``rows`` numbers them, ``low`` holds their last ``width`` bits, ``left`` the flips not yet used."""
    sizes = np.array([_ball(width, f) for f in range(int(left.max()) + 1)])
    if len(rows) < 2:
        return
    if width and sizes[left].sum() > VARIANTS_AT_ONCE:
        top = np.uint64(1) << np.uint64(width - 1)
        own = (low & top) != 0
        for bit in (False, True):
            stays = own == bit
            keep = stays | (left > 0)
            yield from _links(rows[keep], low[keep] & (top - np.uint64(1)), (left - ~stays)[keep], width - 1, distance)
        return
    values, owners = [], []
    for flips in range(int(left.max()) + 1):
        chosen = np.flatnonzero(left == flips)
        masks = _masks(width, min(flips, width))
        values.append((low[chosen, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(rows[chosen], len(masks)))
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(values)
    values, owners = values[order], owners[order]
    meet = np.flatnonzero(values[1:] == values[:-1])
    if len(meet):
        yield owners[meet], owners[meet + 1]


def links(prints: DataFrame, distance=4, prefix_bits=None) -> DataFrame:
    """(a, b), a > b: links that connect all distinct fingerprints within ``distance`` bits.

    Not every close pair is listed, but all that are close are connected by listed links, each of
    which joins two fingerprints of one component."""
    radius = distance // 2
    distinct = materialize(prints.select("fp").distinct(), "fingerprints")
    if prefix_bits is None:
        prefix_bits = max(4, math.ceil(math.log2(max(1, distinct.count()) * _ball(BITS, radius) / VARIANTS_PER_PREFIX)))
    rest = BITS - prefix_bits
    masks = F.array(*(F.lit(int(m)) for m in _masks(prefix_bits, radius)))
    reached = distinct.select(F.explode(masks).alias("_m"), "fp").select(
        F.expr(f"shiftrightunsigned(fp, {rest}) ^ _m").alias("prefix"), "fp"
    )

    def run(group: pa.Table) -> pa.Table:
        fps = common.distinct_sorted(group.column("fp").to_numpy().view(np.uint64))
        prefix = np.uint64(group.column("prefix")[0].as_py())
        used = np.bitwise_count((fps >> np.uint64(rest)) ^ prefix).astype(np.int64)
        low = fps & np.uint64((1 << rest) - 1)
        seen = np.empty(0, np.int64)
        for a, b in _links(np.arange(len(fps)), low, radius - used, rest, distance):
            near = np.bitwise_count(fps[a] ^ fps[b]) <= distance
            code = np.minimum(a, b)[near] * len(fps) + np.maximum(a, b)[near]
            seen = common.distinct_sorted(np.concatenate([seen, common.distinct_sorted(code)]))
        label = common.local_components(len(fps), seen // max(1, len(fps)), seen % max(1, len(fps)))
        own = fps.view(np.int64)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        one, two = own[moved], own[label[moved]]
        return pa.table({"a": np.maximum(one, two), "b": np.minimum(one, two)})

    return reached.groupBy("prefix").applyInArrow(run, "a long, b long").distinct()


def connect(edges: DataFrame, max_rounds=60) -> DataFrame:
    """(a, b): for every linked number but the smallest of its component, that smallest number.

    Alternates two contractions until every component is a star: larger neighbours move to the
    smallest neighbour, then smaller ones do. Each is an aggregate and a join on the same key, so a
    hub is combined before the shuffle and its rows may be split by adaptive execution."""
    edges, state = materialize(edges, "links"), None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges
        state = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        edges = materialize(moved.select("e.a", "e.b").filter("a <> b").distinct(), "links")
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words=4, distance=4) -> DataFrame:
    """(id, fp, fingerprint, component): each row's fingerprint and the smallest id it is linked to.

    Rows link when their fingerprints differ in at most ``distance`` bits, directly or through
    others. Texts without a word have fingerprint zero and link like any other. A null id never
    names a component; a component of null ids only has none. Repeated rows stay. An empty table
    gives an empty result."""
    prints = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    stars = connect(links(prints, distance)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    smallest = prints.groupBy("fp").agg(F.min("_id").alias("least")).join(stars, "fp", "left")
    smallest = smallest.select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = smallest.groupBy("root").agg(F.min("least").alias("component"))
    named = smallest.select("fp", "root").join(roots, "root").select("fp", "component")
    return prints.join(named, "fp").select(
        F.col("_id").alias(id_col), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component"
    )


def keep_first(docs: DataFrame, id_col="doc_id", text_col="text", words=4, distance=4) -> DataFrame:
    """One row of every component: that with its smallest id, all columns kept.

    Of rows that share their id the one with the smallest text hash stays, of equal rows one. A row
    without an id stays only if no row of its component has one."""
    key = F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(common.text_of(text_col)).alias("h")
    )
    name = common.free_name(docs, "_key")
    found = near_duplicates(docs.select(key.alias(name), F.col(text_col)), name, text_col, words, distance)
    kept = found.filter(F.col(name) == F.col("component")).select(name).distinct()
    return docs.withColumn(name, key).join(kept, name, "left_semi").dropDuplicates([name]).select(docs.columns)
