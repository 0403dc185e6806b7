"""Places of rows in a global order, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import scratch


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with places 0, 1, ... in a total order: a range sort, and a running sum over one count for each partition.

    The sorted rows are written, so that both uses of them see one and the same partitioning.
    """
    spark = df.sparkSession
    path = scratch(spark, "sorted")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path).withColumn("__part", F.shiftright("__at", 33))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each partition of the sort
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")
