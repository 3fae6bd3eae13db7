"""Arrays within a row: values worked out once, and running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, worked out once a row: the optimizer copies it into no filter or expression that looks at it, as it would a plain column's."""
    held = df.withColumn("__settled", F.explode(F.array(value)))
    return held.withColumn(name, F.col("__settled")).drop("__settled")


def offsets(sizes: Column) -> Column:
    """The sum of all sizes before each one, from an array of integers. Sums run within blocks of some square root
    of the number of sizes, and over the blocks: a growing array is copied at every step, so one long fold would be quadratic."""
    state = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
    scan = lambda xs: F.aggregate(xs, state, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["all"], a["sum"]).alias("all")))

    def of(xs: Column) -> Column:
        k = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(xs), k), lambda at: scan(F.slice(xs, at, k)))
        shifted = lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, lambda b: b["sum"]))["all"], lambda b, at: F.transform(b["all"], lambda x: x + at)))
        return F.when(F.size(xs) > 0, let(blocks, shifted)).otherwise(F.array().cast("array<int>"))

    return let(sizes, of)
