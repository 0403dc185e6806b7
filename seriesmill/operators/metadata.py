"""What a store holds: label names and values, series, counts, and the shapes of query results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import label_text, order
from .select import Matcher, match


def label_names(samples: DataFrame) -> DataFrame:
    """Distinct label names, __name__ included."""
    names = samples.select(F.explode(F.map_keys("labels")).alias("name")).unionByName(samples.select(F.lit("__name__").alias("name")))
    return names.distinct()


def label_values(samples: DataFrame, name: str) -> DataFrame:
    """Distinct values of a label."""
    col = F.col("metric") if name == "__name__" else F.col("labels").getItem(name)
    return samples.select(col.alias("value")).where(F.col("value").isNotNull()).distinct()


def series(samples: DataFrame, *selectors: tuple[Matcher, ...], distinct: bool = True) -> DataFrame:
    """(series_id, metric, labels, label_key) of the series that any selector matches; repeated if not ``distinct``."""
    parts = [match(samples, *s) for s in selectors] or [samples]
    each = [p.groupBy("series_id").agg(F.first("metric").alias("metric"), F.first("labels").alias("labels")) for p in parts]
    out = each[0]
    for p in each[1:]:
        out = out.unionByName(p)
    return (out.dropDuplicates(["series_id"]) if distinct else out).withColumn("label_key", label_text())


def stats(samples: DataFrame) -> DataFrame:
    """One row: series, samples, first and last time."""
    per = samples.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per.agg(F.count(F.lit(1)).alias("series"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"))


def metadata(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Metric names with a type: counter for names that end in _total, _count, _sum or _bucket, else gauge."""
    out = samples.select("metric").distinct().withColumn("type", F.when(F.col("metric").rlike("_(total|count|sum|bucket)$"), "counter").otherwise("gauge"))
    return out if limit is None else out.orderBy("metric").limit(limit)


def instant_result(samples: DataFrame) -> DataFrame:
    """The first sample of each series, its value as text."""
    from .aggregate import value_text

    first = F.min_by(F.struct("ts", "value"), order())
    out = samples.groupBy("series_id").agg(F.first("metric").alias("metric"), F.first("labels").alias("labels"), first.alias("s"))
    return out.select("series_id", "metric", "labels", "s.ts", value_text(F.col("s.value")).alias("value"))


def matrix_result(samples: DataFrame, chunk_ms: int = 86_400_000) -> DataFrame:
    """Rows (series_id, metric, labels, chunk, samples): each series' samples in time order, a row for each ``chunk_ms`` of time, so that no row holds a whole series."""
    packed = F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", "value"))), lambda s: F.struct(s["ts"], s["value"]))
    return samples.groupBy("series_id", "metric", "labels", F.floor(F.col("ts") / chunk_ms).alias("chunk")).agg(packed.alias("samples"))
