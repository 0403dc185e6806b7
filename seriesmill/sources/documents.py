"""JSON and CSV: puts of single points and batches, exports and imports."""

from __future__ import annotations

import time
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLUMNS, SCHEMA, entries, samples, series_id
from .text import number

PUT = "metric string, timestamp string, value string, tags map<string,string>"
BATCH = "timeseries array<struct<labels: array<struct<name: string, value: string>>, samples: array<struct<timestamp: bigint, value: string>>>>"
EXPORT = (
    "time_series array<struct<metadata: struct<metric_name: string, labels: map<string,string>, unit: string, description: string>, "
    "samples: array<struct<timestamp: bigint, value: double>>>>, query string, start_time bigint, end_time bigint"
)
FORMATS = ("json", "csv", "parquet", "orc")
#: Times up to here are seconds: the year 2100.
SECONDS_BELOW = 4_102_444_800


def parse_puts(bodies: DataFrame, column: str = "value", least_tags: int = 1) -> tuple[DataFrame, DataFrame]:
    """Points ``{metric, timestamp, value, tags}`` or arrays of them; samples, and rejected points with an error.

    Times of (0, 4102444800) are seconds.  Values are numbers or numeric text.
    """
    col = F.trim(F.col(column))
    points = F.when(col.startswith("["), F.from_json(col, f"array<struct<{PUT.replace(' string', ': string').replace(' map', ': map')}>>")).otherwise(F.array(F.from_json(col, PUT)))
    rows = bodies.select(F.col(column).alias("body"), F.explode_outer(points).alias("p")).select("body", "p.*")
    time = F.col("timestamp").try_cast("long")
    ts = F.when((time > 0) & (time < SECONDS_BELOW), time * 1000).otherwise(time)
    error = (
        F.when(F.col("metric").isNull() | (F.col("metric") == ""), "no metric").when(time.isNull(), "bad timestamp").when(number(F.col("value")).isNull(), "bad value")
        .when(F.coalesce(F.size("tags"), F.lit(0)) < least_tags, "no tags")
    )
    rows = rows.withColumn("error", error).withColumn("ts", ts)
    tags = F.coalesce("tags", F.expr("cast(map() as map<string,string>)"))
    good = rows.where(F.col("error").isNull())
    return samples(good, F.col("metric"), tags, F.col("ts"), number(F.col("value"))), rows.where(F.col("error").isNotNull()).select("body", "metric", "timestamp", "value", "error")


def put_summary(good: DataFrame, bad: DataFrame) -> DataFrame:
    """One row: success, failed."""
    return good.agg(F.count(F.lit(1)).alias("success")).crossJoin(bad.agg(F.count(F.lit(1)).alias("failed")))  # a row each


def _from_pairs(pairs: Column) -> tuple[Column, Column]:
    name = F.get(F.transform(F.filter(pairs, lambda p: p["name"] == "__name__"), lambda p: p["value"]), F.lit(0))
    rest = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["name"] != "__name__"), lambda p: F.struct(p["name"], p["value"])))
    return name, rest


def parse_batches(bodies: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Batches ``{timeseries: [{labels: [{name, value}], samples: [{timestamp, value}]}]}``; samples, and what failed."""
    rows = bodies.select(F.col(column).alias("body"), F.from_json(column, BATCH).alias("b"))
    each = rows.select("body", F.explode_outer("b.timeseries").alias("t")).select("body", "t.labels", F.explode_outer("t.samples").alias("s"))
    name, rest = _from_pairs(F.col("labels"))
    each = each.withColumn("metric", name).withColumn("rest", rest).withColumn("number", number(F.col("s.value")))
    ok = F.coalesce(F.col("metric").isNotNull() & F.col("s.timestamp").isNotNull() & F.col("number").isNotNull(), F.lit(False))
    return samples(each.where(ok), F.col("metric"), F.col("rest"), F.col("s.timestamp"), F.col("number")), each.where(~ok).select("body", "labels", "s")


def _exported(documents: DataFrame) -> DataFrame:
    each = documents.select(F.explode("time_series").alias("t")).select("t.metadata", F.posexplode("t.samples").alias("k", "s"))
    return samples(each, F.col("metadata.metric_name"), F.coalesce("metadata.labels", F.expr("cast(map() as map<string,string>)")), F.col("s.timestamp"), F.col("s.value"), F.col("k"))


def parse_export(documents: DataFrame, column: str = "value") -> DataFrame:
    """Samples of export documents, one in each row."""
    return _exported(documents.select(F.from_json(column, EXPORT).alias("d")).select("d.time_series"))


def read_json(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """Samples of files with an export document on each line, or one ``pretty`` document in each file."""
    return _exported(spark.read.schema(EXPORT).json(path, multiLine=pretty))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a CSV file with columns metric_name, labels (k=v joined by commas), timestamp, value; bad rows are left out."""
    rows = spark.read.csv(path, header=True, schema="metric_name string, labels string, timestamp string, value string", escape='"')
    rows = rows.where(F.col("timestamp").try_cast("long").isNotNull() & number(F.col("value")).isNotNull())
    labels = F.when(F.coalesce("labels", F.lit("")) == "", F.expr("cast(map() as map<string,string>)")).otherwise(F.str_to_map("labels", F.lit(","), F.lit("=")))
    return samples(rows, F.col("metric_name"), labels, F.col("timestamp").cast("long"), number(F.col("value")))


def read_any(spark: SparkSession, path: str, format_: str) -> DataFrame:
    """Import by format: json, csv, parquet or orc."""
    if format_ == "json":
        return read_json(spark, path)
    if format_ == "csv":
        return read_csv(spark, path)
    if format_ in ("parquet", "orc"):
        rows = spark.read.format(format_).load(path)
        if "series_id" not in rows.columns:
            rows = rows.withColumn("series_id", series_id())
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.lit(0).cast("long"))
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA))
    raise ValueError(f"unknown format {format_!r}")


def to_json(df: DataFrame, query: str = "", start: int = 0, end: int = 0, chunk_ms: int = 86_400_000) -> DataFrame:
    """One row of JSON for each series and ``chunk_ms`` of time (from the epoch), in the form of an export document.

    Whole exports are written as many documents, so that no task must hold all series, nor a row all of one.
    """
    packed = F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", "value"))), lambda s: F.struct(s["ts"].alias("timestamp"), s["value"].alias("value")))
    rows = df.groupBy(F.col("metric").alias("m"), F.col("labels").alias("l"), F.floor(F.col("ts") / chunk_ms)).agg(packed.alias("s"))
    series = F.struct(F.struct(F.col("m").alias("metric_name"), F.col("l").alias("labels"), F.lit("").alias("unit"), F.lit("").alias("description")).alias("metadata"), F.col("s").alias("samples"))
    document = F.struct(F.array(series).alias("time_series"), F.lit(query).alias("query"), F.lit(start).cast("long").alias("start_time"), F.lit(end).cast("long").alias("end_time"))
    return rows.select(F.to_json(document).alias("value"))


def to_csv(df: DataFrame) -> DataFrame:
    """Rows metric_name, labels, timestamp, value of a CSV export; writers quote labels."""
    pairs = F.array_join(F.transform(entries(), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return df.select(F.col("metric").alias("metric_name"), pairs.alias("labels"), F.col("ts").alias("timestamp"), "value")


def export(df: DataFrame, path: str, format_: str, metric: str | None = None) -> None:
    """Writes samples (of one metric) as json, csv, parquet or orc."""
    df = df if metric is None else df.where(F.col("metric") == metric)
    if format_ == "json":
        to_json(df).write.mode("overwrite").text(path)
    elif format_ == "csv":
        to_csv(df).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)
    elif format_ in ("parquet", "orc"):
        df.select(COLUMNS).write.mode("overwrite").format(format_).save(path)
    else:
        raise ValueError(f"unknown format {format_!r}")


@dataclass
class ExportTask:
    """An export: pending, running, completed, failed or cancelled, with its error and when (seconds) it was made and ended."""

    name: str
    path: str
    format: str
    state: str = "pending"
    error: str | None = None
    created_at: float = 0.0
    completed_at: float | None = None


class ExportTasks:
    """Exports that run in turn (``workers`` at a time) while the caller goes on."""

    def __init__(self, workers: int = 1):
        self._pool, self._lock = ThreadPoolExecutor(workers), Lock()
        self._tasks: dict[str, tuple[ExportTask, Future]] = {}

    def create(self, name: str, df: DataFrame, path: str, format_: str) -> ExportTask:
        if format_ not in FORMATS:
            raise ValueError(f"unknown format {format_!r}")
        task = ExportTask(name, path, format_, created_at=time.time())
        with self._lock:
            if name in self._tasks:
                raise ValueError(f"there is an export {name!r} already")
            self._tasks[name] = task, self._pool.submit(self._run, task, df)
        return task

    def _run(self, task: ExportTask, df: DataFrame) -> None:
        context = df.sparkSession.sparkContext
        with self._lock:
            if task.state != "pending":
                return
            task.state = "running"
        context.addJobTag(self._tag(task.name))
        try:
            export(df, task.path, task.format)
            state, error = "completed", None
        except Exception as e:  # what the job failed with is the task's result
            state, error = "failed", str(e)[:1000]
        finally:
            context.clearJobTags()
        with self._lock:
            if task.state == "running":
                task.state, task.error = state, error
            task.completed_at = time.time()

    def _tag(self, name: str) -> str:
        return "export-" + "".join(c if c.isalnum() else "-" for c in name) + f"-{id(self)}"

    def status(self, name: str) -> ExportTask | None:
        return self._tasks[name][0] if name in self._tasks else None

    def list(self) -> list[ExportTask]:
        return [task for task, _ in self._tasks.values()]

    def wait(self, name: str) -> ExportTask:
        task, future = self._tasks[name]
        if not future.cancelled():
            future.result()
        return task

    def cancel(self, name: str, spark: SparkSession) -> bool:
        """Stops what is pending or running, its Spark jobs too; what has ended stays as it is."""
        if name not in self._tasks:
            return False
        task, future = self._tasks[name]
        with self._lock:
            if task.state not in ("pending", "running"):
                return False
            task.state = "cancelled"
        if not future.cancel():
            spark.sparkContext.cancelJobsWithTag(self._tag(name))
        return True
