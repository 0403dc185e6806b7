"""Quantiles of classic histograms (series with an ``le`` label) and of plain series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import COLUMNS, label_text
from .quantiles import at_places


def histogram_quantile(samples: DataFrame, q: float) -> DataFrame:
    """The q-quantile of each histogram and time, interpolated linearly within its bucket.

    Buckets are cumulative; the lowest one begins at 0 unless its bound is negative; a quantile in the +Inf bucket
    is the highest finite bound.  No +Inf bucket, fewer than two, or no observations: NaN.  q < 0 and q > 1 give
    infinities.
    """
    le = F.col("labels").getItem("le")
    rest = F.map_filter("labels", lambda k, _: k != "le")
    rows = samples.where(le.isNotNull()).select("metric", rest.alias("labels"), label_text(rest).alias("key"), "ts", F.col("value").alias("n"), F.when(le.isin("+Inf", "Inf", "inf"), F.lit(float("inf"))).otherwise(F.expr("try_cast(labels['le'] as double)")).alias("le"))
    group = ["metric", "key", "ts"]
    by_bound = Window.partitionBy(*group).orderBy("le")
    whole = Window.partitionBy(*group)
    rows = (
        rows.where(F.col("le").isNotNull()).withColumn("lower", F.lag("le").over(by_bound)).withColumn("before", F.lag("n").over(by_bound))
        .withColumn("total", F.max("n").over(whole)).withColumn("top", F.max("le").over(whole)).withColumn("buckets", F.count(F.lit(1)).over(whole))
        .withColumn("rank", F.col("total") * F.lit(float(q)))
    )
    # a histogram's buckets are few; the first whose count reaches the rank holds the quantile
    hit = rows.where((F.col("n") >= F.col("rank")) | (F.col("le") == float("inf"))).groupBy(*group).agg(F.min_by(F.struct("labels", "le", "lower", "n", "before", "total", "top", "buckets", "rank"), "le").alias("h")).select(*group, "h.*")
    low = F.coalesce("lower", F.when(F.col("le") <= 0, F.col("le")).otherwise(F.lit(0.0)))
    before = F.coalesce("before", F.lit(0.0))
    inside = F.when(F.col("n") == before, F.col("le")).otherwise(low + (F.col("le") - low) * F.try_divide(F.col("rank") - before, F.col("n") - before))
    value = (
        F.when((F.col("top") != float("inf")) | (F.col("buckets") < 2) | (F.col("total") == 0) | F.col("total").isNull(), F.lit(float("nan")))
        .when(F.lit(q < 0), F.lit(float("-inf"))).when(F.lit(q > 1), F.lit(float("inf")))
        .when(F.col("le") == float("inf"), F.col("lower")).when(F.col("lower").isNull() & (F.col("le") <= 0), F.col("le")).otherwise(inside)
    )
    return hit.select(F.xxhash64(F.lit(""), "key").alias("series_id"), F.lit("").alias("metric"), "labels", "ts", value.alias("value"), F.lit(0).cast("long").alias("seq"))


def nearest_rank(samples: DataFrame, q: float = 0.99, end: int | None = None) -> DataFrame:
    """Per series the value at place floor(q * (n - 1)) of its sorted values."""
    names = samples.groupBy("series_id", "metric", "labels").agg((F.max("ts") if end is None else F.lit(end).cast("long")).alias("ts"))
    found = at_places(samples, ["series_id"], {"value": lambda n: F.floor((n - 1) * F.lit(float(q)))})
    return names.join(found, "series_id").withColumn("seq", F.lit(0).cast("long")).select(COLUMNS)
