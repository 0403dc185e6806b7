"""Rollups: tumbling windows of fixed length from the epoch, in five levels of resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import order
from .aggregate import LARGEST

#: Level: window (ms), days kept.  L0 is raw.
LEVELS = {"L0": (0, 7), "L1": (60_000, 30), "L2": (300_000, 90), "L3": (3_600_000, 365), "L4": (86_400_000, 3650)}
HOUR = 3_600_000
#: Range of a query (hours) below which a level answers.
AUTO_BELOW = ((1, "L0"), (24, "L1"), (168, "L2"), (720, "L3"))
#: Range of a query in whole hours (what is begun doesn't count) up to which a level answers.
POLICIES = {
    "auto": ((1, "L0"), (24, "L1"), (168, "L2"), (720, "L3")),
    "conservative": ((1, "L0"), (24, "L1"), (168, "L2"), (720, "L3")),
    "aggressive": ((1, "L0"), (12, "L1"), (72, "L2"), (336, "L3")),
}
#: Functions of differences, which read one level finer than their range asks for; and those that need raw samples.
RATE_LIKE = frozenset("rate irate increase delta".split())
RAW_ONLY = frozenset("quantile histogram_quantile".split())
FUNCTIONS = ("min", "max", "avg", "sum", "count", "last")


def level_for(start: int, end: int) -> str:
    """The level that answers a query over [start, end]: below 1 hour raw, then below 24 hours, 7 days and 30 days."""
    for hours, level in AUTO_BELOW:
        if end - start < hours * HOUR:
            return level
    return "L4"


def level_by_policy(start: int, end: int, policy: str = "auto", function: str | None = None) -> str:
    """The level by a policy's bounds, adapted to the function that reads it; the policy "raw" reads no rollup."""
    if policy == "raw" or function in RAW_ONLY:
        return "L0"
    level = next((name for hours, name in POLICIES[policy] if (end - start) // HOUR <= hours), "L4")
    return f"L{max(0, int(level[1]) - 1)}" if function in RATE_LIKE else level


def level_column(span_ms: Column, policy: str = "auto", function: str | None = None) -> Column:
    """``level_by_policy`` for a column of ranges."""
    if policy == "raw" or function in RAW_ONLY:
        return F.lit("L0")
    hours, finer = F.floor(span_ms / HOUR), int(function in RATE_LIKE)
    out = F.when(F.lit(False), F.lit(""))
    for most, name in POLICIES[policy]:
        out = out.when(hours <= most, f"L{max(0, int(name[1]) - finer)}")
    return out.otherwise(f"L{4 - finer}")


def _last_value() -> Column:
    return F.max_by("value", order())


def _least(value: str = "value") -> Column:
    """The least value that is a number; of nothing else the largest double, as an aggregation gives."""
    return F.coalesce(F.min(F.when(~F.isnan(value), F.col(value))), F.lit(LARGEST))


def _greatest(value: str = "value") -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(value), F.col(value))), F.lit(-LARGEST))


def bucket(ts: Column | str, resolution: int) -> Column:
    """Begin of the window that holds a time; remainders truncate, so windows before 1970 end at theirs."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - ts % F.lit(resolution)


def downsample(samples: DataFrame, level: str = "L1", resolution: int | None = None) -> DataFrame:
    """The mean of each series and window, stamped with the window's begin; L0 is unchanged."""
    resolution = LEVELS[level][0] if resolution is None else resolution
    if not resolution:
        return samples
    out = samples.withColumn("ts", bucket("ts", resolution)).groupBy("series_id", "metric", "labels", "ts").agg(F.avg("value").alias("value"))
    return out.select("series_id", "metric", "labels", "ts", "value", F.lit(0).cast("long").alias("seq"))


def rollup(samples: DataFrame, level: str = "L1", resolution: int | None = None) -> DataFrame:
    """(series_id, metric, labels, level, bucket, min, max, avg, sum, count, last, first_ts, last_ts).

    min and max pass over NaN.
    """
    resolution = LEVELS[level][0] if resolution is None else resolution
    if not resolution:
        raise ValueError("L0 has no windows")
    rows = samples.withColumn("bucket", bucket("ts", resolution)).groupBy("series_id", "metric", "labels", "bucket")
    return rows.agg(
        _least().alias("min"), _greatest().alias("max"), F.avg("value").alias("avg"), F.sum("value").alias("sum"),
        F.count(F.lit(1)).alias("count"), F.max_by("value", order()).alias("last"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    ).select("series_id", "metric", "labels", F.lit(level).alias("level"), "bucket", "min", "max", "avg", "sum", "count", "last", "first_ts", "last_ts")


def rollup_again(finer: DataFrame, level: str) -> DataFrame:
    """A coarser rollup from a finer one: means from sums and counts, not from means.

    A finer window without numbers has its min above its max; the two say nothing, and would hide an infinite value.
    """
    resolution = LEVELS[level][0]
    known = {c: F.when(F.col("min") > F.col("max"), F.lit(None)).otherwise(F.col(c)) for c in ("min", "max")}
    rows = finer.withColumns({"bucket": bucket("bucket", resolution), **known}).groupBy("series_id", "metric", "labels", "bucket")
    return rows.agg(
        _least("min").alias("min"), _greatest("max").alias("max"), (F.sum("sum") / F.sum("count")).alias("avg"), F.sum("sum").alias("sum"),
        F.sum("count").alias("count"), F.max_by("last", "last_ts").alias("last"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    ).select("series_id", "metric", "labels", F.lit(level).alias("level"), "bucket", "min", "max", "avg", "sum", "count", "last", "first_ts", "last_ts")


def as_samples(rolled: DataFrame, function: str = "avg") -> DataFrame:
    """One function of a rollup as samples at the windows' begins; unknown names mean avg."""
    column = function if function in FUNCTIONS else "avg"
    return rolled.select("series_id", "metric", "labels", F.col("bucket").alias("ts"), F.col(column).cast("double").alias("value"), F.lit(0).cast("long").alias("seq"))


def build(samples: DataFrame, now: int, levels: tuple[str, ...] = ("L1", "L2", "L3", "L4"), hierarchical: bool = True) -> dict[str, DataFrame]:
    """Rollups of each level over its retention, up to ``now``; hierarchical: each from the one below."""
    out: dict[str, DataFrame] = {}
    below = None
    for level in levels:
        since = now - LEVELS[level][1] * 86_400_000
        if hierarchical and below is not None and LEVELS[below][1] >= LEVELS[level][1]:
            out[level] = rollup_again(out[below], level)
        else:
            out[level] = rollup(samples.where(F.col("ts").between(since, now)), level)
        below = level
    return out
