"""The data model: samples of labelled series in one table of fixed schema.

    series_id BIGINT, metric STRING, labels MAP<STRING, STRING>, ts BIGINT (ms), value DOUBLE, seq BIGINT

``seq`` orders samples of equal time.  A series is named by metric and labels; its id is a hash of both that doesn't
depend on the labels' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)
COLUMNS = SCHEMA.names


def order() -> Column:
    return F.struct("ts", "seq")


def entries(labels: Column | str = "labels") -> Column:
    """A label map as an array sorted by name."""
    return F.array_sort(F.map_entries(labels))


def label_text(labels: Column | str = "labels") -> Column:
    """``{a=1, b=2}``, sorted by name."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit("}"))


def series_id(metric: Column | str = "metric", labels: Column | str = "labels") -> Column:
    return F.xxhash64(F.col(metric) if isinstance(metric, str) else metric, entries(labels))


def samples(df: DataFrame, metric: str | Column, labels: dict[str, Column] | Column, ts: Column, value: Column, seq: Column | None = None) -> DataFrame:
    """Any table as samples.  With ``labels`` as a dictionary of columns, matchers reach the table's own columns."""
    metric = F.lit(metric) if isinstance(metric, str) else metric
    id_ = series_id()
    if isinstance(labels, dict):
        # the names are known, so they are put in order here and not in every row
        pairs = [F.struct(F.lit(name).alias("key"), F.col("labels")[name].alias("value")) for name in sorted(labels)]
        id_ = F.xxhash64("metric", F.array(*pairs)) if pairs else id_
        labels = F.create_map(*(x for name, col in labels.items() for x in (F.lit(name), col.cast("string")))) if labels else no_labels()
    out = df.select(metric.alias("metric"), labels.alias("labels"), ts.cast("long").alias("ts"), value.cast("double").alias("value"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"))
    return out.select(id_.alias("series_id"), *COLUMNS[1:])


def no_labels() -> Column:
    return F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Samples from (metric, labels, ts, value) tuples, in the order given."""
    frame = spark.createDataFrame([(m, dict(ls), int(t), float(v), k) for k, (m, ls, t, v) in enumerate(rows)], "metric string, labels map<string,string>, ts long, value double, seq long")
    return frame.select(series_id().alias("series_id"), *COLUMNS[1:])


def millis(ts: str) -> Column:
    """Milliseconds of a timestamp without zone, rounded down, whatever the session's time zone."""
    return F.expr(f"cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) / 1000) as bigint)")


def _within(df: DataFrame, column: str, start: int | None, end: int | None) -> DataFrame:
    """Rows of [start, end] (ms), as a condition on the table's own column, which its files' statistics can answer."""
    moment = "timestampadd(MILLISECOND, {}L, timestamp_ntz'1970-01-01 00:00:00')"
    df = df if start is None else df.where(F.col(column) >= F.expr(moment.format(start)))
    return df if end is None else df.where(F.col(column) < F.expr(moment.format(end + 1)))


def events(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("event_type", "user_id"), start: int | None = None, end: int | None = None) -> DataFrame:
    """The events table as metric events_value."""
    df = _within(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", start, end)
    return samples(df, "events_value", {c: F.col(c) for c in by}, millis("ts"), F.col("value"), F.col("event_id"))


def lineitem(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("l_returnflag", "l_linestatus"), value: str = "l_quantity", start: int | None = None, end: int | None = None) -> DataFrame:
    """The lineitem table as a metric of day grain."""
    df = _within(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", start, end)
    return samples(df, f"lineitem_{value}", {c: F.col(c) for c in by}, millis("l_shipdate"), F.col(value), F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def orders(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("o_orderpriority",), value: str = "o_totalprice", start: int | None = None, end: int | None = None) -> DataFrame:
    """The orders table as a metric of day grain."""
    df = _within(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", start, end)
    return samples(df, f"orders_{value}", {c: F.col(c) for c in by}, millis("o_orderdate"), F.col(value), F.col("o_orderkey"))
