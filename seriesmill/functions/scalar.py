"""Functions of each sample's value, with the IEEE results for NaN, infinities and zero that SQL doesn't give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import label_text, no_labels

NAN, INF = float("nan"), float("inf")


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.when(F.isnan(v) | (v < 0), F.lit(NAN)).when(v == 0, F.lit(-INF)).otherwise(f(v))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    # beyond 2 ** 52 doubles are whole, and a cast to bigint would overflow; this also passes NaN and infinities on
    return lambda v: F.when(F.abs(v) < 2.0**52, f(v).cast("double")).otherwise(v)


def round_half_away(v: Column, digits: int = 0) -> Column:
    """Rounds to ``digits`` decimals, halves away from zero."""
    scale = 10.0**digits
    near = F.signum(v) * F.floor(F.abs(v) * scale + 0.5).cast("double") / scale
    return F.when(F.abs(v) * scale < 2.0**52, near).otherwise(v)


def clamp(v: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Between low and high; NaN stays."""
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def clamp_max(v: Column, high: float = 100.0) -> Column:
    """At most ``high``, which also stands for NaN."""
    return F.when(F.isnan(v), F.lit(float(high))).otherwise(F.least(v, F.lit(float(high))))


def clamp_min(v: Column, low: float = 0.0) -> Column:
    """At least ``low``, which also stands for NaN."""
    return F.when(F.isnan(v), F.lit(float(low))).otherwise(F.greatest(v, F.lit(float(low))))


MATH: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "ceil": _whole(F.ceil), "floor": _whole(F.floor), "exp": F.exp, "ln": _log(F.log), "log2": _log(F.log2), "log10": _log(F.log10), "sqrt": F.sqrt,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg": F.degrees, "rad": F.radians, "sgn": F.signum, "round": round_half_away, "log": _log(F.log),
}


def apply(samples: DataFrame, name: str, *args: float) -> DataFrame:
    """A function of this module, or one that was registered, on every value; an unknown name is an error."""
    v = F.col("value")
    if name in REGISTERED:
        return samples.withColumn("value", REGISTERED[name](v, *args).cast("double"))
    if name in ("clamp", "clamp_max", "clamp_min"):
        return samples.withColumn("value", {"clamp": clamp, "clamp_max": clamp_max, "clamp_min": clamp_min}[name](v, *args))
    if name == "round":
        return samples.withColumn("value", round_half_away(v, *(int(a) for a in args)))
    if name not in MATH:
        raise ValueError(f"unknown function {name!r}")
    return samples.withColumn("value", MATH[name](v).cast("double"))


REGISTERED: dict[str, Callable[..., Column]] = {}


def register_function(name: str, fn: Callable[..., Column]) -> None:
    """Makes ``fn`` (value column and numbers to column) callable by name, in expressions too."""
    REGISTERED[name] = fn


def sort(samples: DataFrame, descending: bool = False) -> DataFrame:
    """Samples ordered by their series' first value (0 if there is none), then series and time."""
    first = samples.groupBy("series_id").agg(F.min_by("value", F.struct("ts", "seq")).alias("__first"))
    key = F.coalesce("__first", F.lit(0.0))
    return samples.join(first, "series_id").orderBy(key.desc() if descending else key.asc(), "series_id", "ts", "seq").drop("__first")


def scalar(samples: DataFrame, at: int = 0) -> DataFrame:
    """The value of a vector of a single sample, else NaN, as one sample without labels."""
    one = samples.limit(2).agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("v"))
    return without_labels(one.select(F.when(F.col("n") == 1, F.col("v")).otherwise(F.lit(NAN)).alias("value")), at)


def without_labels(values: DataFrame, at: int) -> DataFrame:
    """A column ``value`` as samples of the series without labels."""
    return values.select(F.lit(0).cast("long").alias("series_id"), F.lit("").alias("metric"), no_labels().alias("labels"), F.lit(at).cast("long").alias("ts"), F.col("value").cast("double").alias("value"), F.lit(0).cast("long").alias("seq"))


def vector(samples: DataFrame) -> DataFrame:
    """A vector of one series without its labels; of more, unchanged."""
    several = samples.select(F.min("series_id").alias("a"), F.max("series_id").alias("b")).select((F.col("a") != F.col("b")).alias("__several"))
    out = samples.crossJoin(F.broadcast(several))  # a single row
    return out.withColumn("labels", F.when(F.col("__several"), F.col("labels")).otherwise(no_labels())).withColumn("metric", F.when(F.col("__several"), F.col("metric")).otherwise("")).drop("__several")


def absent(samples: DataFrame, start: int = 0) -> DataFrame:
    """1 if there is no sample, else nothing."""
    n = samples.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return without_labels(n.select(F.lit(1.0).alias("value")), start)


def time(start: int) -> float:
    """Seconds of an evaluation's start."""
    return start / 1000.0


def timestamp(samples: DataFrame) -> DataFrame:
    """Each value replaced by its time in seconds."""
    return samples.withColumn("value", F.col("ts") / 1000.0)


_MOMENT = "timestampadd(SECOND, cast(floor(value) as bigint), timestamp_ntz'1970-01-01 00:00:00')"
DATES = {
    "day_of_month": f"day({_MOMENT})", "day_of_week": f"dayofweek({_MOMENT}) - 1", "day_of_year": f"dayofyear({_MOMENT})", "days_in_month": f"day(last_day({_MOMENT}))",
    "hour": f"hour({_MOMENT})", "minute": f"minute({_MOMENT})", "month": f"month({_MOMENT})", "year": f"year({_MOMENT})",
}


def date_part(samples: DataFrame, name: str) -> DataFrame:
    """day_of_month, day_of_week (Sunday 0), day_of_year, days_in_month, hour, minute, month or year of a value in seconds, UTC."""
    return samples.withColumn("value", F.expr(DATES[name]).cast("double"))


def _renamed(samples: DataFrame) -> DataFrame:
    return samples.withColumn("series_id", F.xxhash64("metric", label_text()))


def label_replace(samples: DataFrame, to: str, replacement: str, source: str, pattern: str) -> DataFrame:
    """Where the whole of label ``source`` matches, label ``to`` becomes ``replacement`` with $1, $2 ...; empty removes it."""
    value = F.coalesce(F.col("labels").getItem(source), F.lit(""))
    whole = f"^(?:{pattern})$"
    new = F.regexp_replace(value, whole, replacement)
    others = F.map_filter("labels", lambda k, _: k != to)
    replaced = F.when(new == "", others).otherwise(F.map_concat(others, F.create_map(F.lit(to), new)))
    return _renamed(samples.withColumn("labels", F.when(value.rlike(whole), replaced).otherwise(F.col("labels"))))


def label_join(samples: DataFrame, to: str, separator: str, *sources: str) -> DataFrame:
    """Label ``to`` becomes the values of the source labels (empty if missing), joined."""
    joined = F.concat_ws(separator, *(F.coalesce(F.col("labels").getItem(s), F.lit("")) for s in sources))
    others = F.map_filter("labels", lambda k, _: k != to)
    return _renamed(samples.withColumn("labels", F.when(joined == "", others).otherwise(F.map_concat(others, F.create_map(F.lit(to), joined)))))
