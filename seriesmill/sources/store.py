"""The sample store: a Parquet table by metric and day, its compaction, retention, tiers and rollups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import COLUMNS, SCHEMA
from ..operators import rollup
from ..operators.select import Matcher, match, time_range

DAY = 86_400_000
_STORED = T.StructType([*SCHEMA.fields, T.StructField("day", T.IntegerType())])
#: Age in hours up to which a sample is in a tier; older ones are archived.
TIERS = ((24, "hot"), (168, "warm"), (720, "cold"))
#: Accesses an hour above which a series is in a tier.
BY_ACCESS = ((10.0, "hot"), (1.0, "warm"), (0.1, "cold"))


def _path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the one that the cluster shares, named in spark.checkpoint.dir.

    Without that setting, in the checkpoint folder of the program, or a temporary one if all runs in one process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not shared:
        if not context.getCheckpointDir().isDefined():
            if not context.isLocal():
                raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seriesmill-"))
        shared = context.getCheckpointDir().get()
    return f"{shared.rstrip('/')}/seriesmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Deletes all scratch folders of this application; results that read them must be stored before."""
    _delete(spark, scratch(spark, "x").rsplit("/", 1)[0])


class Store:
    """Samples under one path: ``samples`` partitioned by metric and day, ``rollup`` by level.

    Files are sorted by series and time, so their statistics prune what a query doesn't touch; metric and time
    predicates prune partitions.  Any path that Spark can open will do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def samples_path(self) -> str:
        return f"{self.path}/samples"

    def append(self, df: DataFrame, mode: str = "append", path: str | None = None) -> None:
        """Adds samples.  A metric's day is dealt by ranges of series and time, as many as Spark's sample of the rows asks for, so that a large day is many files and a small one few."""
        rows = df.select(COLUMNS).withColumn("day", F.floor(F.col("ts") / DAY).cast("int"))
        dealt = rows.repartitionByRange("metric", "day", "series_id", "ts").sortWithinPartitions("metric", "day", "series_id", "ts")
        dealt.write.mode(mode).partitionBy("metric", "day").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#series_id", "true").parquet(path or self.samples_path)

    def scan(self, metric: str | None = None, matchers: tuple[Matcher, ...] = (), start: int | None = None, end: int | None = None, tier: str | None = None, now: int | None = None) -> DataFrame:
        if not _path_exists(self.spark, self.samples_path):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(_STORED).parquet(self.samples_path)
        if metric is not None:
            rows = rows.where(F.col("metric") == metric)
        if start is not None:
            rows = rows.where(F.col("day") >= start // DAY)
        if end is not None:
            rows = rows.where(F.col("day") <= end // DAY)
        rows = match(time_range(rows, start, end), *matchers)
        if tier is not None:
            rows = rows.where(tier_of(F.col("ts"), now) == tier)
        return rows.select(COLUMNS)

    def compact(self, least_files: int = 4) -> int:
        """Rewrites each day of a metric that has ``least_files`` files or more, one sample for each series and time: the first in sequence.

        The other days aren't read.  The new files are written beside the old ones before they take their place; the
        number of days rewritten is returned.  One compaction at a time.
        """
        rows = self.spark.read.schema(_STORED).parquet(self.samples_path)
        files = rows.select("metric", "day", F.col("_metadata.file_path").alias("file")).distinct().groupBy("metric", "day").agg(F.count(F.lit(1)).alias("n"))
        days = files.where(F.col("n") >= least_files).select("metric", "day")
        n = days.count()
        if n:
            staged = f"{self.path}/staged-{uuid.uuid4().hex}"
            self.append(deduplicated(rows.join(days, ["metric", "day"], "left_semi").select(COLUMNS)), path=staged)
            self.append(self.spark.read.schema(_STORED).parquet(staged).select(COLUMNS), "overwrite")
            _delete(self.spark, staged)
        return n

    def expire(self, now: int, keep_days: int, target: str) -> None:
        """Writes the samples of the last ``keep_days`` to ``target``."""
        Store(self.spark, target).append(self.scan(start=now - keep_days * DAY))

    def write_rollups(self, now: int, levels: tuple[str, ...] = ("L1", "L2", "L3", "L4")) -> None:
        for level, df in rollup.build(self.scan(), now, levels).items():
            df.drop("level").write.mode("overwrite").parquet(f"{self.path}/rollup/level={level}")

    def read_rollup(self, level: str, metric: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """A level's rollup, or one computed from the samples if none is stored."""
        path = f"{self.path}/rollup/level={level}"
        if _path_exists(self.spark, path):
            rows = self.spark.read.parquet(path).withColumn("level", F.lit(level))
        else:
            rows = rollup.rollup(self.scan(metric), level)
        if metric is not None:
            rows = rows.where(F.col("metric") == metric)
        rows = rows if start is None else rows.where(F.col("bucket") >= start)
        return rows if end is None else rows.where(F.col("bucket") <= end)


def deduplicated(df: DataFrame) -> DataFrame:
    """One sample for each series and time: the first in sequence."""
    first = F.min_by(F.struct("metric", "labels", "value", "seq"), "seq")
    return df.groupBy("series_id", "ts").agg(first.alias("r")).select("series_id", "r.metric", "r.labels", "ts", "r.value", "r.seq")


def tier_of(ts: Column, now: int) -> Column:
    """hot, warm, cold or archive by age."""
    age = (F.lit(now) - ts) / 3_600_000
    out = F.when(age <= TIERS[0][0], TIERS[0][1])
    for hours, name in TIERS[1:]:
        out = out.when(age <= hours, name)
    return out.otherwise("archive")


def tier_by_access(per_hour: Column) -> Column:
    out = F.when(per_hour > BY_ACCESS[0][0], BY_ACCESS[0][1])
    for least, name in BY_ACCESS[1:]:
        out = out.when(per_hour > least, name)
    return out.otherwise("archive")


def retained(df: DataFrame, now: int, keep_days: int) -> DataFrame:
    return df.where(F.col("ts") >= now - keep_days * DAY)


def federated(nodes: dict[str, DataFrame], only: list[str] | None = None) -> DataFrame:
    """Samples of several stores, each with its ``node_name``."""
    chosen = {k: v for k, v in nodes.items() if only is None or k in only}
    if not chosen:
        raise ValueError("no such node")
    parts = [df.select(*COLUMNS, F.lit(name).alias("node_name")) for name, df in sorted(chosen.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
