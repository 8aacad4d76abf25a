"""Exact order statistics at the 0-based index int(n * p), without sorting a group in one task.

An approximate quantile sketch brackets each wanted rank; only rows between the brackets are
counted by value and walked. A group up to ``_SMALL`` rows is taken whole."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 20_000
_MARGIN = 4.0 / _ACCURACY
_SMALL = 50_000
_SALTS = 64


def _null_safe_join(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join in which null keys meet."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def order_statistics(df: DataFrame, keys, value: str, fractions) -> DataFrame:
    """One row per key and fraction: columns ``p``, ``n`` and ``value``."""
    keys = list(keys) or ["_all"]
    rows = df if keys != ["_all"] else df.withColumn("_all", F.lit(0))
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    lows = [max(p - _MARGIN, 0.0) for p in fractions]
    highs = [min(p + _MARGIN, 1.0) for p in fractions]
    size = len(fractions)
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", [*lows, *highs], _ACCURACY).alias("q"),
    )
    small = F.col("n") <= _SMALL
    brackets = sketch.select(
        *keys,
        "n",
        F.array(
            *[
                F.struct(
                    F.lit(float(p)).alias("p"),
                    F.floor(F.col("n") * F.lit(float(p))).alias("idx"),
                    F.when(~small, F.col("q")[i]).alias("lo"),
                    F.when(~small, F.col("q")[size + i]).alias("hi"),
                )
                for i, p in enumerate(fractions)
            ]
        ).alias("wanted"),
    )
    below = F.struct(
        *[
            F.count_if(F.col("_v") < F.col("wanted")[i]["lo"]).alias(f"b{i}") for i in range(size)
        ]
    )
    # a hot key meets its bracket in _SALTS places
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(_SALTS)))
    everywhere = brackets.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))
    )
    joined = _null_safe_join(salted, everywhere, [*keys, "_salt"])
    under = joined.groupBy(*keys).agg(below.alias("under"))
    inside = (
        joined.select(
            *keys,
            "n",
            "_v",
            F.explode(
                F.filter(
                    F.transform("wanted", lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
                    lambda x: F.coalesce(F.col("_v") >= x["w"]["lo"], F.lit(True))
                    & F.coalesce(F.col("_v") <= x["w"]["hi"], F.lit(True)),
                )
            ).alias("x"),
        )
        .groupBy(*keys, "n", F.col("x.i").alias("i"), F.col("x.w.p").alias("p"),
                 F.col("x.w.idx").alias("idx"), "_v")
        .agg(F.count("*").alias("c"))
    )
    w = Window.partitionBy(*keys, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    offsets = F.array(*[F.col(f"under.b{i}") for i in range(size)])
    found = (
        inside.withColumn("upto", F.sum("c").over(w))
        .transform(_null_safe_join, under.select(*keys, offsets.alias("offsets")), keys)
        .withColumn("rank", F.col("idx") - F.get("offsets", F.col("i")))
        .filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    )
    # a bracket that misses its rank must not lose a row in silence
    wanted = brackets.select(*keys, "n", F.explode("wanted").alias("w")).select(*keys, "n", F.col("w.p").alias("p"))
    found = _null_safe_join(wanted, found.select(*keys, "p", "_v"), [*keys, "p"], "left")
    missed = F.raise_error(F.lit("an order statistic lies outside its bracket")).cast(rows.schema["_v"].dataType)
    kept = [k for k in keys if k != "_all"]
    return found.select(*kept, "p", "n", F.coalesce("_v", missed).alias(value))
