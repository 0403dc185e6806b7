"""Streaming rollups, alert states and ingestion.

Batch rollups are rebuilt from samples and take late ones whenever they come; a streaming rollup is an early
answer, which counts samples up to its watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import SCHEMA, label_text, order
from ..operators.rollup import LEVELS, _greatest, _least
from ..operators.rules import EXPIRE_S, Rule
from ..sources.text import parse_exposition


def read_samples(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of sample files (Parquet) that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_lines(spark: SparkSession, path: str, now: int) -> DataFrame:
    """A stream of exposition text files; lines that can't be read are left out."""
    return parse_exposition(spark.readStream.text(path), now)[0]


def rollup_stream(samples: DataFrame, level: str = "L1", late: str = "10 minutes") -> DataFrame:
    """The windows of a level with min, max, avg, sum, count and last, each sent when the watermark has passed it."""
    timed = samples.withColumn("time", F.timestamp_millis("ts")).withWatermark("time", late)
    window = F.window("time", f"{LEVELS[level][0]} milliseconds")
    out = timed.groupBy(window.alias("w"), "series_id", "metric", label_text().alias("series")).agg(
        _least().alias("min"), _greatest().alias("max"), F.avg("value").alias("avg"), F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"), F.max_by("value", order()).alias("last")
    )
    return out.select("series_id", "metric", "series", F.lit(level).alias("level"), F.unix_millis("w.start").alias("bucket"), "min", "max", "avg", "sum", "count", "last")


def alert_stream(evaluations: DataFrame, rule: Rule, late: str = "10 minutes") -> DataFrame:
    """(series_id, ts, value, state, active_at) of a stream of evaluations, the state kept for each series.

    Within a batch a series' evaluations are taken in time order.  Those behind the watermark are left out; a series
    is forgotten when the watermark is EXPIRE_S past its last evaluation.
    """
    op, bound = rule.condition.op, rule.condition.threshold
    hold = int(rule.hold_s * 1000)

    def active(v: float) -> bool:
        return {"gt": v > bound, "gte": v >= bound, "lt": v < bound, "lte": v <= bound, "eq": v == bound, "ne": v != bound}[op]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for ts, value in zip(rows["ts"], rows["value"]):
            if last is not None and ts - last > EXPIRE_S * 1000:
                since = None
            if active(value):
                since = int(ts) if since is None else since
                out.append((key[0], int(ts), float(value), "firing" if ts - since >= hold else "pending", since))
            else:
                since = None
            last = int(ts)
        state.update((since, last))
        state.setTimeoutTimestamp(max(last + EXPIRE_S * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["series_id", "ts", "value", "state", "active_at"]).astype({"series_id": "int64", "ts": "int64", "value": "float64", "active_at": "int64"})

    timed = evaluations.select("series_id", "ts", "seq", "value", F.timestamp_millis("ts").alias("time")).withWatermark("time", late)
    return timed.groupBy("series_id").applyInPandasWithState(step, "series_id long, ts long, value double, state string, active_at long", "since long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what has arrived and stops."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
