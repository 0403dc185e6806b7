"""Selection: label matchers, time ranges, offsets and instants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import label_text

MAX_SPAN_MS = 30 * 86_400_000


@dataclass(frozen=True)
class Matcher:
    """A condition on a label: = != =~ !~.  Regular expressions match whole values; a missing label is empty."""

    label: str
    op: str
    value: str

    def condition(self) -> Column:
        col = F.col("metric") if self.label == "__name__" else F.col("labels").getItem(self.label)
        whole = f"^(?:{self.value})$"
        if self.op == "=":
            return col == self.value if self.value else F.coalesce(col, F.lit("")) == ""
        if self.op == "!=":
            return F.coalesce(col, F.lit("")) != self.value
        if self.op == "=~":
            return F.coalesce(col, F.lit("")).rlike(whole)
        if self.op == "!~":
            return ~F.coalesce(col, F.lit("")).rlike(whole)
        raise ValueError(f"unknown matcher {self.op!r}")


def match(samples: DataFrame, *matchers: Matcher) -> DataFrame:
    """Samples whose series meet all matchers: plain predicates, which Spark pushes to the scan where it can."""
    for m in matchers:
        samples = samples.where(m.condition())
    return samples


def time_range(samples: DataFrame, start: int | None, end: int | None, after: bool = False) -> DataFrame:
    """Samples of [start, end], or of (start, end] if ``after``."""
    if start is not None:
        samples = samples.where(F.col("ts") > start if after else F.col("ts") >= start)
    return samples if end is None else samples.where(F.col("ts") <= end)


def select(samples: DataFrame, metric: str | None = None, matchers: tuple[Matcher, ...] = (), start: int | None = None, end: int | None = None, offset_ms: int = 0, at_ms: int | None = None, range_ms: int | None = None) -> DataFrame:
    """A vector or matrix selector.

    ``offset_ms`` moves the window back (times of results are those of the samples); ``at_ms`` pins it to an
    instant; ``range_ms`` lets it begin (exclusively) that much before its start.
    """
    if metric:
        matchers = (Matcher("__name__", "=", metric), *matchers)
    if at_ms is not None:
        start = end = at_ms
    start, end = None if start is None else start - offset_ms, None if end is None else end - offset_ms
    out = match(samples, *matchers)
    return time_range(out, start, end) if range_ms is None or start is None else time_range(out, start - range_ms, end, after=True)


def series(samples: DataFrame, id_: int) -> DataFrame:
    """All samples of a series."""
    return samples.where(F.col("series_id") == id_)


def compare(samples: DataFrame, op: str, threshold: float) -> DataFrame:
    """Adds ``matches``: whether each value compares to the threshold."""
    v = F.col("value")
    done = {">": v > threshold, ">=": v >= threshold, "<": v < threshold, "<=": v <= threshold, "==": v == threshold, "!=": v != threshold}
    return samples.withColumn("matches", done[op])


def where(samples: DataFrame, condition: Column) -> DataFrame:
    return samples.where(condition)


def map_values(samples: DataFrame, value: Column) -> DataFrame:
    return samples.withColumn("value", value.cast("double"))


def keep_labels(samples: DataFrame, names: list[str]) -> DataFrame:
    """Only the listed labels."""
    return samples.withColumn("labels", F.map_filter("labels", lambda k, _: k.isin(names)))


def drop_labels(samples: DataFrame, names: list[str]) -> DataFrame:
    """All but the listed labels."""
    return samples.withColumn("labels", F.map_filter("labels", lambda k, _: ~k.isin(names)))


def with_label_columns(df: DataFrame, *names: str) -> DataFrame:
    """Labels as columns of their own, and the whole set as text."""
    return df.select("*", *(F.col("labels").getItem(n).alias(n) for n in names), label_text().alias("series"))


def check_range_query(start: int, end: int, step: int) -> None:
    """Bounds in order and not negative, a positive step, at most 30 days."""
    if start > end:
        raise ValueError("start is after end")
    if start < 0 or end < 0:
        raise ValueError("times must not be negative")
    if step <= 0:
        raise ValueError("step must be positive")
    if end - start > MAX_SPAN_MS:
        raise ValueError("the range is longer than 30 days")
