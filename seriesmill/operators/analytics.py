"""Summaries and features of series."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import at_places, quantiles

#: Samples a summary needs, and how many it looks at.
LEAST, MOST = 10, 10_000


def _names(*more):
    return F.first("metric").alias("metric"), F.first("labels").alias("labels"), *more


def basic_stats(samples: DataFrame) -> DataFrame:
    """count, min, max, mean, median, std (population), p25, p75, p95, p99 of each series."""
    out = samples.groupBy("series_id", "metric", "labels").agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    found = quantiles(samples, ["series_id"], {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99})
    return out.join(found, "series_id").select("series_id", "metric", "labels", "count", "min", "max", "mean", "median", "std", "p25", "p75", "p95", "p99")


def _numbered(samples: DataFrame) -> DataFrame:
    return samples.withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy("ts", "seq")) - 1)


def _r2():
    """Share of the variance that a line explains, from covariance c and variances v and w; 1 if values don't vary."""
    return F.when(F.col("v") == 0, 1.0).otherwise(F.try_divide(F.col("c") * F.col("c"), F.col("v") * F.col("w")))


def trend(samples: DataFrame, flat: float = 0.001) -> DataFrame:
    """slope, intercept, r2 (1 if values don't vary) of the line over places 0, 1, ..., and its direction."""
    out = _numbered(samples).groupBy("series_id").agg(*_names(F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("intercept"), F.covar_pop("value", "i").alias("c"), F.var_pop("i").alias("w"), F.var_pop("value").alias("v")))
    slope = F.coalesce("slope", F.lit(0.0))
    r2 = _r2()
    direction = F.when(slope > flat, "up").when(slope < -flat, "down").otherwise("stable")
    return out.select("series_id", "metric", "labels", slope.alias("slope"), "intercept", r2.alias("r2"), direction.alias("direction"))


def periodicity(samples: DataFrame, least: int = LEAST, share: float = 0.8) -> DataFrame:
    """The most common positive step between samples (the smallest of equals), its share of all, and whether that is above 0.8."""
    step = F.col("ts") - F.lag("ts").over(Window.partitionBy("series_id").orderBy("ts", "seq"))
    steps = samples.withColumn("step", step).where("step > 0").groupBy("series_id", "step").agg(*_names(F.count(F.lit(1)).alias("n")))
    n = samples.groupBy("series_id").agg(F.count(F.lit(1)).alias("samples"))
    best = steps.groupBy("series_id").agg(*_names(F.max_by("step", F.struct("n", -F.col("step"))).alias("period"), F.max("n").alias("most"), F.sum("n").alias("steps")))
    out = best.join(n.where(F.col("samples") >= least), "series_id")
    confidence = F.col("most") / F.col("steps")
    return out.select("series_id", "metric", "labels", "period", confidence.alias("confidence"), (confidence > share).alias("periodic"))


def thinned(samples: DataFrame, most: int = MOST) -> DataFrame:
    """Every k-th sample of series longer than ``most``, k = length div most."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    rows = _numbered(samples).withColumn("__n", n)
    stride = F.when(F.col("__n") > most, F.floor(F.col("__n") / most)).otherwise(1)
    return rows.where(F.col("i") % stride == 0).drop("i", "__n")


def summary(samples: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """basic_stats, trend and periodicity of series of 10 samples or more, long ones thinned."""
    enough = samples.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("series_id")
    rows = thinned(samples.join(enough, "series_id"), most)
    t, p = trend(rows).drop("metric", "labels"), periodicity(rows, least).drop("metric", "labels")
    return basic_stats(rows).join(t, "series_id").join(p, "series_id", "left")


def time_features(samples: DataFrame) -> DataFrame:
    """Moments, extremes and quartiles (of places n div 4 and 3n div 4) of each series."""
    out = samples.groupBy("series_id", "metric", "labels").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"),
    )
    places = {"q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(n * 3 / 4), "low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)}
    found = at_places(samples, ["series_id"], places).select("series_id", "q1", "q3", ((F.col("low") + F.col("high")) / 2).alias("median"))
    out = out.join(found, "series_id")
    zero = lambda c: F.coalesce(F.when(F.col("std") == 0, 0.0).otherwise(F.col(c)), F.lit(0.0)).alias(c)
    return out.select("series_id", "metric", "labels", "mean", "variance", "std", zero("skewness"), zero("kurtosis"), "min", "max", "median", "q1", "q3", (F.col("max") - F.col("min")).alias("range"), "sum", "count")


def shape_features(samples: DataFrame) -> DataFrame:
    """slope, trend (last less first), r2, zero crossings per step, mean absolute value, RMS, crest and shape factors."""
    before = F.lag("value").over(Window.partitionBy("series_id").orderBy("ts", "seq"))
    rows = _numbered(samples).withColumn("before", before)
    crossing = F.when(((F.col("before") >= 0) & (F.col("value") < 0)) | ((F.col("before") < 0) & (F.col("value") >= 0)), 1.0).otherwise(0.0)
    mean = F.avg("value").over(Window.partitionBy("series_id"))
    out = rows.withColumn("mean", mean).groupBy("series_id").agg(*_names(
        F.regr_slope("value", "i").alias("slope"), (F.max_by("value", "i") - F.min_by("value", "i")).alias("trend"), F.covar_pop("value", "i").alias("c"), F.var_pop("i").alias("w"), F.var_pop("value").alias("v"),
        F.sum(crossing).alias("crossings"), F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("value") - F.col("mean"))).alias("mad"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak"),
    ))
    return out.select(
        "series_id", "metric", "labels", F.coalesce("slope", F.lit(0.0)).alias("slope"), "trend", _r2().alias("r2"),
        F.when(F.col("n") > 1, F.col("crossings") / (F.col("n") - 1)).otherwise(0.0).alias("zero_crossing_rate"), "mad", "rms",
        F.when(F.col("rms") > 0, F.try_divide("peak", "rms")).otherwise(0.0).alias("crest"), F.when(F.col("mad") > 0, F.try_divide("rms", "mad")).otherwise(0.0).alias("shape"),
    )


def spectrum(values: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Dominant bin, centroid, spread, entropy and total power of bins 0 ... n/2 - 1; nothing below 32 values or without power."""
    n = len(values)
    if n < 32:
        return None
    power = np.abs(np.fft.rfft(values)[: n // 2]) ** 2
    total = float(power.sum())
    if not total > 0:
        return None
    share, k = power / total, np.arange(n // 2)
    centroid = float((k * share).sum())
    some = share[share > 0]
    return float(len(power) - 1 - power[::-1].argmax()), centroid, float(((k - centroid) ** 2 * share).sum()), float(-(some * np.log(some)).sum()), total


def frequency_features(samples: DataFrame) -> DataFrame:
    """spectrum of each series, one row each; nulls where it has none."""
    names = ("dominant", "centroid", "spread", "entropy", "power")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = spectrum(rows.sort_values(["ts", "seq"])["value"].to_numpy())
        return pd.DataFrame([{"series_id": key[0]} | dict(zip(names, found or (None,) * 5, strict=True))])

    return samples.select("series_id", "ts", "seq", "value").groupBy("series_id").applyInPandas(one, "series_id long, " + ", ".join(f"{n} double" for n in names))


def features(samples: DataFrame, least: int = LEAST) -> DataFrame:
    """time, frequency and shape features, as structs, of series of 10 samples or more."""
    enough = samples.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("series_id")
    rows = samples.join(enough, "series_id")
    parts = {"time": time_features(rows), "frequency": frequency_features(rows), "shape": shape_features(rows)}
    out = None
    for name, part in parts.items():
        own = [c for c in part.columns if c not in ("series_id", "metric", "labels")]
        part = part.select("series_id", F.struct(*own).alias(name))
        out = part if out is None else out.join(part, "series_id")
    return out
