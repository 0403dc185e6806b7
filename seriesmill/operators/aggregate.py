"""Aggregation over series: by label sets and time, or over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import label_text, no_labels
from .quantiles import quantiles

NAN = float("nan")
#: min of nothing but NaN, max of nothing but NaN.
LARGEST = 1.7976931348623157e308


def _value() -> Column:
    return F.col("value")


def _numbers() -> Column:
    return F.when(~F.isnan("value"), F.col("value"))


#: min and max pass over NaN; a group of nothing else gives the largest double, or its negative.
AGGREGATES = {
    "sum": lambda: F.sum(_value()),
    "avg": lambda: F.avg(_value()),
    "min": lambda: F.least(F.coalesce(F.min(_numbers()), F.lit(LARGEST)), F.lit(LARGEST)),
    "max": lambda: F.greatest(F.coalesce(F.max(_numbers()), F.lit(-LARGEST)), F.lit(-LARGEST)),
    "count": lambda: F.count(F.lit(1)).cast("double"),
    "stddev": lambda: F.stddev_pop(_value()),
    "stdvar": lambda: F.var_pop(_value()),
    "group": lambda: F.lit(1.0),
}


def group_labels(by: list[str] | None = None, without: list[str] | None = None) -> Column:
    """The labels that make a group: those listed, all but those listed, or none."""
    if by:
        return F.map_filter("labels", lambda k, _: k.isin(by))
    if without is not None:
        return F.map_filter("labels", lambda k, _: ~k.isin(without))
    return no_labels()


def _keyed(samples: DataFrame, by: list[str] | None, without: list[str] | None) -> DataFrame:
    # without keeps the metric name unless it is listed; by keeps it only if it is
    keep_name = "__name__" in by if by else without is not None and "__name__" not in without
    metric = F.col("metric") if keep_name else F.lit("")
    return samples.select(metric.alias("metric"), group_labels(by, without).alias("labels"), "ts", "value")


def _as_samples(df: DataFrame) -> DataFrame:
    return df.select(F.xxhash64("metric", label_text()).alias("series_id"), "metric", "labels", "ts", "value", F.lit(0).cast("long").alias("seq"))


def aggregate(samples: DataFrame, op: str, by: list[str] | None = None, without: list[str] | None = None, collapse_time: bool = False, start: int | None = None, arg: float | None = None) -> DataFrame:
    """sum, avg, min, max, count, stddev, stdvar, group or quantile of each group at each time.

    ``collapse_time`` aggregates all samples of a group into one, stamped ``start``.  Sums and the like are
    pre-aggregated before the one shuffle, so that a large group is no burden.  A quantile over all times is found from
    counts of values; one at each time takes a group's values of that time, one for each series, together.
    """
    if op == "quantile":
        q = 0.5 if arg is None else arg
        if not 0 <= q <= 1:
            raise ValueError("quantile must be within 0 and 1")
        what = F.percentile("value", q)
    elif op in AGGREGATES:
        what = AGGREGATES[op]()
    else:
        raise ValueError(f"unknown aggregation {op!r}")
    keyed = _keyed(samples, by, without)
    if collapse_time and op == "quantile":
        named = keyed.select("metric", label_text().alias("key"), "labels", "value")
        groups = named.groupBy("metric", "key").agg(F.any_value("labels").alias("labels"))
        found = quantiles(named, ["metric", "key"], {"value": q})
        return _as_samples(groups.join(found, ["metric", "key"]).withColumn("ts", F.lit(start).cast("long")))
    if collapse_time:
        out = keyed.groupBy("metric", "labels").agg(what.alias("value")).withColumn("ts", F.lit(start).cast("long"))
    else:
        out = keyed.groupBy("metric", "labels", "ts").agg(what.alias("value"))
    return _as_samples(out)


def top(samples: DataFrame, k: int, largest: bool = True, per_time: bool = False, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """topk / bottomk: the k greatest (or least) samples of all, or of each group (and time).

    Ties break by time, then sequence, then series.  The whole-set form never sorts everything: each task sends
    its own k.
    """
    first = F.desc("value") if largest else F.asc("value")
    if k <= 0:
        return samples.limit(0)
    if not per_time and by is None and without is None:
        return samples.orderBy(first, "ts", "seq", "series_id").limit(k)
    key = label_text(group_labels(by, without))
    window = Window.partitionBy("__key", *(["ts"] if per_time else [])).orderBy(first, "ts", "seq", "series_id")
    return samples.withColumn("__key", key).withColumn("__turn", F.row_number().over(window)).where(F.col("__turn") <= k).drop("__key", "__turn")


def value_text(value: Column | str = "value") -> Column:
    """NaN, +Inf, -Inf, whole numbers without a point, others with up to six decimals."""
    v = F.col(value) if isinstance(value, str) else value
    six = F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    return (
        F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf")
        .when((v == F.floor(v)) & (F.abs(v) < 1e15), F.format_string("%.0f", v)).otherwise(six)
    )


def count_values(samples: DataFrame, label: str, by: list[str] | None = None, without: list[str] | None = None, start: int | None = None) -> DataFrame:
    """How often each value occurs, over all times; the value's text becomes a label."""
    keyed = samples.select(group_labels(by, without).alias("labels"), value_text().alias("text"))
    keyed = keyed.select(F.map_concat(F.map_filter("labels", lambda k, _: k != label), F.create_map(F.lit(label), "text")).alias("labels"))
    out = keyed.groupBy("labels").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return _as_samples(out.withColumn("metric", F.lit("")).withColumn("ts", F.lit(start).cast("long")))


RUNNING = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def running(samples: DataFrame, op: str, slice_ms: int | None = None) -> DataFrame:
    """Cumulative sum, mean, min or max of each series, in time order.

    ``slice_ms`` cuts series that are too long for one task into slices of time: what stood before a slice is one row.
    """
    so_far = Window.unboundedPreceding, Window.currentRow
    if slice_ms is None:
        return samples.withColumn("value", RUNNING[op]("value").over(Window.partitionBy("series_id").orderBy("ts", "seq").rowsBetween(*so_far)))
    cut = samples.withColumn("__slice", F.floor(F.col("ts") / slice_ms))
    inside = Window.partitionBy("series_id", "__slice").orderBy("ts", "seq").rowsBetween(*so_far)
    slices = Window.partitionBy("series_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # sums and counts go on by adding, extremes by themselves
    parts = {"sum": F.sum("value"), "n": F.count("value"), "min": F.min("value"), "max": F.max("value")}
    more = {"sum": F.sum, "n": F.sum, "min": F.min, "max": F.max}
    totals = cut.groupBy("series_id", "__slice").agg(*(p.alias(f"__{k}") for k, p in parts.items()))
    totals = totals.select("series_id", "__slice", *(more[k](f"__{k}").over(slices).alias(f"__{k}") for k in parts))
    rows = cut.withColumns({"__own": RUNNING["sum" if op == "avg" else op]("value").over(inside), "__own_n": F.count("value").over(inside)}).join(totals, ["series_id", "__slice"])
    sum_, n = F.col("__own") + F.coalesce("__sum", F.lit(0.0)), F.col("__own_n") + F.coalesce("__n", F.lit(0))
    # least and greatest pass over the null of a first slice
    value = {"sum": sum_, "avg": sum_ / n, "min": F.least("__own", "__min"), "max": F.greatest("__own", "__max")}[op]
    return rows.withColumn("value", value).select(samples.columns)


def array_aggregate(values: Column, op: str) -> Column:
    """sum, avg, min, max or count of an array of doubles; 0 if it is empty."""
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    n = F.size(values)
    done = {"sum": total, "avg": F.when(n > 0, total / n), "min": F.array_min(values), "max": F.array_max(values), "count": n.cast("double")}
    return F.coalesce(done[op], F.lit(0.0))


def array_arithmetic(left: Column, right: Column, op: str) -> Column:
    """Elementwise + - * / of two arrays, as long as the shorter one; division by zero gives NaN."""
    n = F.least(F.size(left), F.size(right))
    done = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(F.try_divide(a, b))}
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), done[op])


def array_scale(values: Column, by: float, op: str = "*") -> Column:
    """An array times or divided by a number, which must not be 0 in a division."""
    if op == "/" and by == 0:
        raise ZeroDivisionError("division by zero")
    return F.transform(values, lambda v: v * by if op == "*" else v / by)
