"""Evaluate an expensive expression once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """Hand ``value`` to ``use`` as a variable, so that several uses share one evaluation."""
    return F.transform(F.array(value), use)[0]


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed columns.

    A plain filter is pushed below the projection that computes its columns and computes them a
    second time. The row number keeps it above."""
    return (
        df.withColumn("_row", F.monotonically_increasing_id())
        .filter(condition & (F.col("_row") >= 0))
        .drop("_row")
    )
