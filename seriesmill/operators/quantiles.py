"""Exact order statistics of groups of any size, without a group in one task.

Values are counted by a coarse code that keeps their order; the code that holds a wanted place is divided into equal
steps between its least and greatest value and counted again; the step that holds the place is counted value
by value.  Each pass is a pre-aggregated count of the rows that are left, and each window runs over counts.  Rows
meet the few codes that are wanted in a join that Spark broadcasts, or splits where a code has many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Codes for a factor of e, and steps within a code.
PER_E, STEPS = 64, 65_536


def _code(v: Column) -> Column:
    """Whole numbers in the order of the values: logarithms in steps, negative ones mirrored; NaN is above all."""
    size = (F.floor(F.log(F.abs(v)) * PER_E) + 100_000).cast("long")
    inf = float("inf")
    return F.when(F.isnan(v), 2_000_000).when(v == inf, 1_000_000).when(v == -inf, -1_000_000).when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("long")


def at_places(rows: DataFrame, keys: list[str], places: dict[str, Callable[[Column], Column]], value: str = "value") -> DataFrame:
    """(keys, n, a column for each place): of n values in order the one at that place, which counts from 0.

    ``places``: from n to a whole number of 0 to n - 1.  Null values don't count; NaN comes last.  ``keys`` are
    columns that can be compared.
    """
    # the keys as one, so that no name of theirs clashes with those in here
    rows = rows.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("__key"), F.col(value).alias("v")).withColumn("c", _code(F.col("v")))
    keys = ["__key"]
    finite = F.when(F.abs(F.col("v")) < float("inf"), F.col("v"))
    codes = rows.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("k"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    codes = codes.withColumn("n", F.sum("k").over(Window.partitionBy(*keys))).withColumn("before", F.sum("k").over(_up_to(keys, "c")) - F.col("k"))
    n = F.col("n")
    names = F.array(*(F.struct(F.lit(name).alias("name"), place(n).cast("long").alias("place")) for name, place in places.items()))
    wanted = codes.select(*keys, "c", "k", "low", "high", "n", "before", F.explode(names).alias("w")).where("w.place >= before AND w.place < before + k")
    wanted = wanted.select(*keys, "c", "low", "high", "n", F.col("w.name").alias("name"), (F.col("w.place") - F.col("before")).alias("place"))
    cells = wanted.groupBy(*keys, "c", "low", "high").agg(F.collect_list(F.struct("name", "place", "n")).alias("w"))  # as many as there are places

    step = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * (STEPS - 1))).otherwise(0).cast("long")
    inside = rows.join(cells, [*keys, "c"]).withColumn("s", step)
    steps = inside.groupBy(*keys, "c", "low", "high", "w", "s").agg(F.count(F.lit(1)).alias("k"))
    steps = steps.withColumn("before", F.sum("k").over(_up_to([*keys, "c"], "s")) - F.col("k"))
    wanted = steps.select(*keys, "c", "low", "high", "s", "k", "before", F.explode("w").alias("w")).where("w.place >= before AND w.place < before + k")
    wanted = wanted.groupBy(*keys, "c", "low", "high", "s").agg(F.collect_list(F.struct(F.col("w.name").alias("name"), (F.col("w.place") - F.col("before")).alias("place"), F.col("w.n").alias("n"))).alias("w"))

    inside = rows.join(wanted, [*keys, "c"]).where(step == F.col("s"))
    values = inside.groupBy(*keys, "c", "s", "w", "v").agg(F.count(F.lit(1)).alias("k"))
    values = values.withColumn("before", F.sum("k").over(_up_to([*keys, "c", "s"], "v")) - F.col("k"))
    found = values.select(*keys, "v", "k", "before", F.explode("w").alias("w")).where("w.place >= before AND w.place < before + k")
    out = found.groupBy(*keys).agg(F.max("w.n").alias("n"), *(F.max(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in places))
    return out.select("__key.*", "n", *places)


def _up_to(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def quantiles(rows: DataFrame, keys: list[str], shares: dict[str, float], value: str = "value") -> DataFrame:
    """(keys, n, a column for each share): the quantile, interpolated between the values at the two places around it."""
    places: dict[str, Callable[[Column], Column]] = {}
    for name, q in shares.items():
        places[f"{name}__a"] = lambda n, q=q: F.floor((n - 1) * F.lit(float(q)))
        places[f"{name}__b"] = lambda n, q=q: F.ceil((n - 1) * F.lit(float(q)))
    found = at_places(rows, keys, places, value)

    def between(name: str, q: float) -> Column:
        a, b, at = F.col(f"{name}__a"), F.col(f"{name}__b"), (F.col("n") - 1) * F.lit(float(q))
        share = at - F.floor(at)
        return F.when(a == b, a).otherwise(a * (1 - share) + b * share).alias(name)

    return found.select(*keys, "n", *(between(name, q) for name, q in shares.items()))
