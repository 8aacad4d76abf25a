"""Exact trailing-window counts without a large group.

A plain window per key (or with no key) puts a hot key into one task. Here every row leaves two marks
in one order of (key, time, id): its own, and one where its window starts. The marks are cut by range
into partitions of even size, whatever the keys, instants and id types are; the running number of
counted rows is a partition's own plus the sum of the partitions before it. A row's count is the
difference at its two marks, since all marks between them belong to its key.

The sorted marks carry the rows and are written once: the cuts, and so the counts, stay the same when
a task is run again."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.session import materialize, union

_SECOND_US = 1_000_000


def trailing_counts(events: DataFrame, keys, micros: str, order_id: str, width_seconds: int,
                    out="n_recent", counted=None) -> DataFrame:
    """Add, per row, how many rows of its key lie less than ``width_seconds`` back.

    The row itself counts; of the rows at its own instant those with a smaller id count, of those with
    its id too some come before it. ``micros`` is a bigint time in microseconds. With ``counted``, a
    condition, only rows that meet it are counted. Every row is kept once: null keys form a key of
    their own, a row without a time counts nowhere and gets null."""
    columns = events.columns
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    key = [f"_k{i}" for i in range(len(keys))]
    order = [*key, "at", "start", "tie", "_r"]
    tagged = events.filter(F.col(micros).isNotNull()).select(
        F.monotonically_increasing_id().alias("_r"),
        *[F.col(k).alias(name) for k, name in zip(keys, key)],
        F.col(micros).alias("_t"),
        F.col(order_id).alias("_o"),
        one.cast("long").alias("_one"),
        F.struct(*columns).alias("_row"),
    )
    nothing = F.lit(False)  # keeps the type of what it hides
    own = F.struct(
        F.col("_t").alias("at"), F.lit(False).alias("start"), F.col("_o").alias("tie"),
        F.col("_one").alias("n"), F.col("_row").alias("row"),
    )
    # after all rows of its instant: a row exactly the width back is out
    start = F.struct(
        (F.col("_t") - width_seconds * _SECOND_US).alias("at"), F.lit(True).alias("start"),
        F.when(nothing, F.col("_o")).alias("tie"), F.lit(0).cast("long").alias("n"),
        F.when(nothing, F.col("_row")).alias("row"),
    )
    marks = tagged.select("_r", *key, F.explode(F.array(own, start)).alias("m")).select("_r", *key, "m.*")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = marks.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    marks = materialize(marks, "marks")

    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    bases = marks.groupBy("_p").agg(F.sum("n").alias("n"))
    bases = bases.select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    upto = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("_n", F.sum("n").over(upto)).join(F.broadcast(bases), "_p")
    placed = placed.withColumn("_n", F.col("_n") + F.col("_base"))
    starts = placed.filter("start").select("_r", F.col("_n").alias("_n0"))
    found = placed.filter("not start").join(starts, "_r").select("row.*", (F.col("_n") - F.col("_n0")).alias(out))
    untimed = events.filter(F.col(micros).isNull()).select(*columns, F.lit(None).cast("long").alias(out))
    return union(found, untimed)
