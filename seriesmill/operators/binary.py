"""Operators on two vectors, and on a vector and a number: matching by labels, arithmetic, comparison, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COLUMNS, label_text

NAN = float("nan")
ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(F.try_divide(a, b)),
    "%": lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b)),
    "^": lambda a, b: F.pow(a, b),
}


def _plain(op):
    # Spark holds NaN equal to NaN and above all numbers; IEEE compares it with nothing
    return lambda a, b: ~F.isnan(a) & ~F.isnan(b) & op(a, b)


COMPARISON = {
    "==": _plain(lambda a, b: a == b),
    "!=": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b),
    "<": _plain(lambda a, b: a < b),
    "<=": _plain(lambda a, b: a <= b),
    ">": _plain(lambda a, b: a > b),
    ">=": _plain(lambda a, b: a >= b),
}


def _result(rows: DataFrame, op: str, a: Column, b: Column, as_bool: bool) -> DataFrame:
    if op in ARITHMETIC:
        return rows.withColumn("value", ARITHMETIC[op](a, b))
    holds = COMPARISON[op](a, b)
    return rows.withColumn("value", F.when(holds, 1.0).otherwise(0.0)) if as_bool else rows.where(holds).withColumn("value", a)


def match_key(on: list[str] | None = None, ignoring: list[str] | None = None) -> Column:
    """The label set two series are matched by; the metric name never counts."""
    if on is not None:
        return label_text(F.map_filter("labels", lambda k, _: k.isin(on) if on else F.lit(False)))
    return label_text(F.map_filter("labels", lambda k, _: ~k.isin(ignoring))) if ignoring else label_text()


def vector_vector(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None, group: str | None = None, include: tuple[str, ...] = (), as_bool: bool = True) -> DataFrame:
    """Samples of equal match key and time, joined.

    ``group``: "left" lets many series on the left meet one on the right ("right": the reverse), whose labels the
    result has, with ``include`` copied from the other side; otherwise one meets one.  A second match on a side
    that must be single fails the query when it is run.  Comparisons give 1 and 0, or filter without ``as_bool``.
    """
    if group == "right":
        many, one = right, left
    else:
        many, one = left, right
    key = match_key(on, ignoring)
    if group is None:
        return _one_to_one(left, right, op, key, as_bool)
    single = one.groupBy(key.alias("__key"), "ts").agg(F.first("value").alias("__other"), F.first("labels").alias("__labels"), F.count(F.lit(1)).alias("__n"))
    one_checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("several series match on the side that must have one"))).otherwise(F.col("__other"))
    rows = many.withColumn("__key", key)
    rows = rows.join(single, ["__key", "ts"]).withColumn("__other", one_checked.cast("double"))
    a, b = F.col("value"), F.col("__other")
    if group == "right":
        a, b = b, a
    out = _result(rows, op, a, b, as_bool)
    if include:
        names = list(include)
        extra = F.map_filter("__labels", lambda k, _: k.isin(names))
        out = out.withColumn("labels", F.map_concat(F.map_filter("labels", lambda k, _: ~k.isin(names)), extra))
    return _named(out, op, as_bool)


def _named(out: DataFrame, op: str, as_bool: bool) -> DataFrame:
    keeps_name = op in COMPARISON and not as_bool
    out = out if keeps_name else out.withColumn("metric", F.lit(""))
    return out.withColumn("series_id", F.xxhash64("metric", label_text())).select(COLUMNS)


def _one_to_one(left: DataFrame, right: DataFrame, op: str, key: Column, as_bool: bool) -> DataFrame:
    """Both sides brought together by one shuffle on key and time, counted and paired in one pass."""
    rows = left.select(key.alias("__key"), "ts", F.struct("metric", "labels", "value", "seq").alias("l"), F.lit(None).cast("double").alias("r"), F.lit(True).alias("is_left"))
    rows = rows.unionByName(right.select(key.alias("__key"), "ts", F.lit(None).cast(rows.schema["l"].dataType).alias("l"), F.col("value").alias("r"), F.lit(False).alias("is_left")))
    met = rows.groupBy("__key", "ts").agg(F.first("l", True).alias("l"), F.first("r", True).alias("r"), F.count_if("is_left").alias("m"), F.count_if(~F.col("is_left")).alias("n")).where("m > 0 AND n > 0")
    checked = (
        F.when(F.col("m") > 1, F.raise_error(F.lit("several series match; group_left or group_right is needed")))
        .when(F.col("n") > 1, F.raise_error(F.lit("several series match on the side that must have one"))).otherwise(F.col("r")).cast("double")
    )
    paired = met.select("ts", "l.metric", "l.labels", "l.value", "l.seq", checked.alias("__other"))
    return _named(_result(paired, op, F.col("value"), F.col("__other"), as_bool), op, as_bool)


def positional(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """The n-th series of one side with the n-th of the other (by label text), at equal times; off unless called."""

    def numbered(df: DataFrame) -> DataFrame:
        from .places import numbered as with_place

        names = df.groupBy("series_id", F.col("metric").alias("m"), label_text().alias("t")).agg(F.lit(1))
        return df.join(with_place(names.select("series_id", "m", "t"), F.col("m"), F.col("t"), name="__n").select("series_id", "__n"), "series_id")

    other = numbered(right).select("__n", "ts", F.col("value").alias("__other"))
    return _result(numbered(left).join(other, ["__n", "ts"]), op, F.col("value"), F.col("__other"), True).select(COLUMNS)


def vector_scalar(samples: DataFrame, op: str, number: float, as_bool: bool = True, swapped: bool = False) -> DataFrame:
    """A vector and a number; ``swapped`` puts the number on the left."""
    a, b = F.col("value"), F.lit(float(number))
    if not swapped:
        return _result(samples, op, a, b, as_bool)
    if op in ARITHMETIC:
        return samples.withColumn("value", ARITHMETIC[op](b, a))
    holds = COMPARISON[op](b, a)
    return samples.withColumn("value", F.when(holds, 1.0).otherwise(0.0)) if as_bool else samples.where(holds)


def vector_scalar_frame(samples: DataFrame, op: str, number: DataFrame, as_bool: bool = True, swapped: bool = False) -> DataFrame:
    """A vector and a one-row frame of samples (such as scalar() gives); ``swapped`` puts the number on the left."""
    rows = samples.crossJoin(F.broadcast(number.select(F.col("value").alias("__other"))))  # a single row
    a, b = F.col("value"), F.col("__other")
    if swapped and op in COMPARISON and not as_bool:
        return rows.where(COMPARISON[op](b, a)).select(COLUMNS)
    return _result(rows, op, *((b, a) if swapped else (a, b)), as_bool).select(COLUMNS)


def negate(samples: DataFrame) -> DataFrame:
    return samples.withColumn("value", -F.col("value"))


def _members(samples: DataFrame, by_time: bool, key: Column | None) -> DataFrame:
    name = F.col("series_id") if key is None else key
    return samples.select(name.alias("__member"), *(["ts"] if by_time else [])).distinct()


def _set(left: DataFrame, right: DataFrame, how: str, by_time: bool, key: Column | None) -> DataFrame:
    name = F.col("series_id") if key is None else key
    return left.withColumn("__member", name).join(_members(right, by_time, key), ["__member", *(["ts"] if by_time else [])], how).select(COLUMNS)


def and_(left: DataFrame, right: DataFrame, by_time: bool = False, key: Column | None = None) -> DataFrame:
    """Left series that are also on the right (by id, or by ``key``; ``by_time``: at the same time)."""
    return _set(left, right, "left_semi", by_time, key)


def unless(left: DataFrame, right: DataFrame, by_time: bool = False, key: Column | None = None) -> DataFrame:
    """Left series that are not on the right."""
    return _set(left, right, "left_anti", by_time, key)


def or_(left: DataFrame, right: DataFrame, by_time: bool = False, key: Column | None = None) -> DataFrame:
    """Left series, and those on the right that the left lacks."""
    return left.select(COLUMNS).unionByName(unless(right, left, by_time, key))


def merge(*parts: DataFrame) -> DataFrame:
    """Samples of several stores, a sample of one series and time once: that of the first part wins."""
    from functools import reduce

    numbered = [p.select(*COLUMNS, F.lit(k).alias("__part")) for k, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, numbered)
    first = rows.groupBy("series_id", "ts").agg(F.min_by(F.struct("metric", "labels", "value", "seq"), F.struct("__part", "seq")).alias("r"))
    return first.select("series_id", "r.metric", "r.labels", "ts", "r.value", "r.seq")
