"""Cache hits where an entry's lifetime counts from its last set.

An access sets the entry when nothing alive is there, so the sets of a key form a chain: from a set, the next
one is the first access later than its lifetime. Every access knows its own successor in that sense, found
among the accesses of its own and the next lifetime-wide slice of time, or at the start of a later slice.
Which accesses are sets then follows by pointer doubling: in each round the known part of the chain and the
length of the pointers double, so no key's accesses are walked one after the other in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.session import materialize, union

_SECOND_US = 1_000_000


def _successors(moments, length):
    """(key, t, next): for every moment the first one of its key that lies more than ``length`` later."""
    own = ((F.col("t") - F.pmod("t", F.lit(length))) / length).cast("long")
    moments = moments.select("key", "t", own.alias("slice"))
    # in the slice after its own: moments meet those of the next slice, latest first
    asking = moments.select("key", "slice", (F.col("t") + length).alias("at"), F.lit(True).alias("asks"), "t")
    given = moments.select("key", (F.col("slice") - 1).alias("slice"), F.col("t").alias("at"), F.lit(False).alias("asks"), "t")
    later = Window.partitionBy("key", "slice").orderBy(F.col("at").desc(), F.col("asks").desc())
    near = F.min(F.when(~F.col("asks"), F.col("t"))).over(later.rowsBetween(Window.unboundedPreceding, 0))
    found = union(asking, given).withColumn("near", near).filter("asks").select("key", "slice", "t", "near")
    # or at the start of the next slice after that: a row per key and slice
    order = Window.partitionBy("key").orderBy("slice")
    starts = moments.groupBy("key", "slice").agg(F.min("t").alias("start"))
    first, second = (F.lead(F.struct("slice", "start"), n).over(order) for n in (1, 2))
    starts = starts.withColumns({"_one": first, "_two": second})
    far = F.when(F.col("_one.slice") > F.col("slice") + 1, F.col("_one.start")).otherwise(F.col("_two.start"))
    starts = starts.select("key", "slice", far.alias("far"))
    nearest = F.coalesce("near", "far")
    return found.join(starts, ["key", "slice"]).select("key", "t", nearest.alias("next")).filter(F.col("next").isNotNull())


def chain(moments: DataFrame, length: int) -> DataFrame:
    """(key, t) of the moments that set an entry, from distinct (key, t)."""
    reached = materialize(moments.groupBy("key").agg(F.min("t").alias("t")), "sets")
    jumps = materialize(_successors(moments, length), "jumps")
    count = reached.count()
    while True:
        # distinct parts: a jump of a known half of the chain leads into its other half
        further = reached.join(jumps, ["key", "t"]).select("key", F.col("next").alias("t"))
        reached = materialize(union(reached, further).distinct(), "sets")
        before, count = count, reached.count()
        if count == before:
            return reached
        ahead = jumps.select("key", F.col("t").alias("next"), F.col("next").alias("after"))
        jumps = materialize(jumps.join(ahead, ["key", "next"]).select("key", "t", F.col("after").alias("next")), "jumps")


def fixed_lifetime_hits(accesses: DataFrame, key="fingerprint", micros="micros", ttl_seconds=C.CACHE_TTL_SECONDS) -> DataFrame:
    """Per key: accesses, hits and misses of a cache whose entries live ``ttl_seconds`` from their last set.

    Accesses without a time count nowhere; a null key is a key of its own. Of accesses at the same instant the
    first may set, the others hit."""
    counted = accesses.filter(F.col(micros).isNotNull()).groupBy(
        F.struct(F.col(key).alias("k")).alias("key"), F.col(micros).cast("long").alias("t")).agg(F.count("*").alias("n"))
    counted = materialize(counted, "moments")
    sets = chain(counted.select("key", "t"), ttl_seconds * _SECOND_US).groupBy("key").agg(F.count("*").alias("misses"))
    totals = counted.groupBy("key").agg(F.sum("n").alias("accesses"))
    return totals.join(sets, "key").select(
        F.col("key.k").alias(key), "accesses", (F.col("accesses") - F.col("misses")).alias("hits"), "misses")
