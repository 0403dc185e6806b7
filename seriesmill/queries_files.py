"""Registered queries of what is written and read again: the store, formats, protocols, rules' tables and streams.

Each writes to a new folder in the one that the cluster shares, before it returns the lazy result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import aggregate as agg
from .operators import rollup, rules
from .operators.select import Matcher
from .plans.compile import evaluate
from .queries import ALERT, BASE, DAY, END, START, A, B, both, by_type, flat, query, rounded
from .sources import documents, remote, store, text
from .streaming import rollups as streaming

ALL = f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s"


def stored(spark: SparkSession, d: str) -> store.Store:
    """All events, appended in two halves, in a store of its own."""
    s = store.Store(spark, store.scratch(spark, "store"))
    rows = both(spark, d)
    s.append(rows.where("seq % 2 = 0"))
    s.append(rows.where("seq % 2 = 1"))
    return s


# --- the store
@query("s5_block_read", ALL)
def _(spark, d):
    return flat(stored(spark, d).scan("events_value"), "event_type", "user_id")


@query("s6_block_read_by_labels", f"{ALL} WHERE event_type = 'click' AND user_id <> '7'")
def _(spark, d):
    return flat(stored(spark, d).scan("events_value", (Matcher("event_type", "=", "click"), Matcher("user_id", "!=", "7"))), "event_type", "user_id")


@query("s8_block_pruning", f"{ALL} WHERE ts BETWEEN {A} AND {B}")
def _(spark, d):
    return flat(stored(spark, d).scan("events_value", start=A, end=B), "event_type", "user_id")


@query("s9_stored_rollup", f"WITH {BASE} SELECT event_type, user_id, ts - ts % 3600000 AS ts, round(avg(value), 6) AS value FROM s WHERE ts BETWEEN {START} AND {END} GROUP BY 1, 2, 3")
def _(spark, d):
    s = stored(spark, d)
    s.write_rollups(END, ("L3",))
    return flat(rollup.as_samples(s.read_rollup("L3", "events_value")), "event_type", "user_id")


@query("s9_rollup_fallback", f"WITH {BASE} SELECT event_type, user_id, ts - ts % {DAY} AS ts, round(max(value), 6) AS value FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    return flat(rollup.as_samples(stored(spark, d).read_rollup("L4", "events_value"), "max"), "event_type", "user_id")


@query("s10_tier_scan", f"{ALL} WHERE ({END} - ts) / 3600000.0 > 24 AND ({END} - ts) / 3600000.0 <= 168")
def _(spark, d):
    return flat(stored(spark, d).scan("events_value", tier="warm", now=END), "event_type", "user_id")


@query("k7_flushed_days", f"WITH {BASE} SELECT (ts // {DAY})::INTEGER AS day, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    """What is in the folders of the days."""
    return spark.read.parquet(stored(spark, d).samples_path).groupBy("day").agg(F.count("*").alias("n"))


@query("k8_compact", f"WITH {BASE} SELECT event_type, user_id, ts, round(arg_min(value, seq), 6) AS value FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    """Every sample is written twice, later with another value; compaction keeps the first of each series and time."""
    s = stored(spark, d)
    s.append(both(spark, d).withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("value", F.col("value") + 1))
    s.compact(least_files=2)
    return flat(s.scan("events_value"), "event_type", "user_id")


@query("k9_expire", f"{ALL} WHERE ts >= {END} - 7 * {DAY}")
def _(spark, d):
    s, kept = stored(spark, d), store.scratch(spark, "kept")
    s.expire(END, 7, kept)
    return flat(store.Store(spark, kept).scan("events_value"), "event_type", "user_id")


@query("k11_tier_by_access", f"WITH {BASE}, h AS (SELECT user_id, count(*) / (720.0) AS per_hour FROM s GROUP BY 1) SELECT user_id, CASE WHEN per_hour > 10 THEN 'hot' WHEN per_hour > 1 THEN 'warm' WHEN per_hour > 0.1 THEN 'cold' ELSE 'archive' END AS tier FROM h")
def _(spark, d):
    asked = both(spark, d).groupBy(F.col("labels")["user_id"].alias("user_id")).agg((F.count("*") / 720.0).alias("per_hour"))
    return asked.select("user_id", store.tier_by_access(F.col("per_hour")).alias("tier"))


# --- import and export
def _exported(format_: str):
    def run(spark, d):
        path = store.scratch(spark, "export")
        documents.export(both(spark, d).unionByName(model.lineitem(spark, d)), path, format_, metric="events_value")
        return flat(documents.read_any(spark, path, format_), "event_type", "user_id")

    return run


for _format in documents.FORMATS:
    query(f"i8_import_{_format}", ALL)(_exported(_format))


@query("k4_export_task", f"WITH {BASE} SELECT 'completed' AS state, count(*) AS n FROM s")
def _(spark, d):
    path, tasks = store.scratch(spark, "task"), documents.ExportTasks()
    tasks.create("events", both(spark, d), path, "orc")
    task = tasks.wait("events")
    return documents.read_any(spark, path, "orc").agg(F.lit(task.state).alias("state"), F.count("*").alias("n"))


@query("i10_graphite", f"WITH {BASE} SELECT event_type, user_id, ts // 1000 * 1000 AS ts, round(value, 6) AS value FROM s")
def _(spark, d):
    """Lines ``events.value;event_type=...;user_id=... value seconds``."""
    tags = F.concat(F.lit(";event_type="), F.col("labels")["event_type"], F.lit(";user_id="), F.col("labels")["user_id"])
    lines = both(spark, d).select(F.concat_ws(" ", F.concat(F.lit("events.value"), tags), F.col("value").cast("string"), F.floor(F.col("ts") / 1000).cast("string")).alias("value"))
    return flat(text.parse_graphite(lines)[0].where("metric = 'events_value'"), "event_type", "user_id")


@query("i10_line_protocol", ALL)
def _(spark, d):
    tags = F.concat(F.lit("events,event_type="), F.col("labels")["event_type"], F.lit(",user_id="), F.col("labels")["user_id"])
    lines = both(spark, d).select(F.concat_ws(" ", tags, F.concat(F.lit("value="), F.col("value").cast("string")), (F.col("ts") * 1_000_000).cast("string")).alias("value"))
    return flat(text.parse_line_protocol(lines)[0].where("metric = 'events_value'"), "event_type", "user_id")


# --- protocols
def write_bodies(spark: SparkSession, d: str) -> DataFrame:
    return remote.encode_writes(both(spark, d))


@query("i1_remote_write", ALL)
def _(spark, d):
    return flat(remote.parse_writes(write_bodies(spark, d))[0], "event_type", "user_id")


@query("i4_sniffed", f"WITH {BASE}, c AS (SELECT event_type, user_id, ts // {DAY} AS day FROM s GROUP BY 1, 2, 3) SELECT true AS is_text, count(*) AS n FROM s UNION ALL SELECT false, count(*) FROM c")
def _(spark, d):
    """Lines of text are told from request bodies."""
    lines = text.write_exposition(both(spark, d)).select(F.encode("value", "utf-8").alias("body"))
    return lines.unionByName(write_bodies(spark, d)).groupBy(text.is_text_column("body").alias("is_text")).agg(F.count("*").alias("n"))


ASKED = [(START, END, [Matcher("__name__", "=", "events_value"), Matcher("event_type", "=~", "c.*")]), (A, B, [Matcher("user_id", "!=", "3")])]


@query("s12_remote_read", f"WITH {BASE} SELECT 0 AS query, event_type, user_id, ts, round(value, 6) AS value FROM s WHERE ts BETWEEN {START} AND {END} AND event_type LIKE 'c%' UNION ALL SELECT 1, event_type, user_id, ts, round(value, 6) FROM s WHERE ts BETWEEN {A} AND {B} AND user_id <> '3'")
def _(spark, d):
    """The samples that an encoded request asks for."""
    first, second = remote.answer(both(spark, d), remote.encode_read_request(ASKED))
    return flat(first, "event_type", "user_id").withColumn("query", F.lit(0)).unionByName(flat(second, "event_type", "user_id").withColumn("query", F.lit(1)))


@query("s13_remote_read_client", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s WHERE ts BETWEEN {START} AND {END} AND event_type LIKE 'c%'")
def _(spark, d):
    """The answer to the first request, encoded as responses and decoded again."""
    answer = remote.answer(both(spark, d), remote.encode_read_request(ASKED))[0]

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([remote.encode_response([[s]]) for s in batch.column(0).to_pylist()], pa.binary())], names=["body"])

    return flat(remote.parse_responses(remote.encode_results(answer).mapInArrow(bodies, "body binary")), "event_type", "user_id")


# --- rules
RULES = """{"groups": [{"name": "g", "interval": "1h", "rules": [
  {"record": "type:sum", "expr": "sum by (event_type) (events_value)", "labels": {"team": "x"}}, {"alert": "High", "expr": "events_value", "for": "10m", "condition": "gt 30"}]}]}"""


@query("t5_rule_file", f"WITH {BASE} SELECT 'type:sum' AS metric, event_type, 'x' AS team, ts, round(sum(value), 6) AS value FROM s WHERE ts BETWEEN {B} - 3600000 AND {B} GROUP BY event_type, ts")
def _(spark, d):
    """The recording rule of a document, over its last interval."""
    rule = rules.load(RULES)[0]
    rows = rules.evaluate_record(both(spark, d), rule, B, int(rule.interval_s * 1000))
    return flat(rows, "event_type", "team").withColumn("metric", F.lit(rule.name))


def query_log(spark: SparkSession, d: str) -> DataFrame:
    """A log in which each user's events are queries of a metric of the user's own."""
    return both(spark, d).select(F.concat(F.lit("rate(m"), F.col("labels")["user_id"], F.lit("[5m])")).alias("query"), "ts")


LOG = f"{BASE}, f AS (SELECT 'rate(m' || user_id || '[DURATION])' AS query, user_id, count(*) AS n, max(ts) AS last_ts FROM s WHERE ts > {END} - 20 * 86400000::BIGINT AND ts <= {END} GROUP BY 1, 2)"


@query("t7_new_rules", f"WITH {LOG} SELECT query, n FROM f WHERE n >= 20 AND user_id NOT LIKE '%1'")
def _(spark, d):
    """Frequent queries without a rule; those of users whose id ends in 1 have one."""
    frequent = rules.frequencies(query_log(spark, d), END, 20 * DAY)
    registry = frequent.where(F.col("query").contains("1[")).select("query", F.lit(False).alias("auto"))
    return rules.new_rules(frequent, registry, most=1_000_000).select("query", "n")


@query("t7_stale_rules", f"WITH {BASE}, f AS (SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM s WHERE ts <= {END} - 20 * 86400000::BIGINT AND ts > {END} - 40 * 86400000::BIGINT GROUP BY 1), u AS (SELECT DISTINCT user_id FROM s) SELECT 'rate(m' || user_id || '[DURATION])' AS query FROM u LEFT JOIN f USING (user_id) WHERE coalesce(n, 0) / 24.0 < 5 AND coalesce(last_ts, 0) < {END} - 48 * 3600000")
def _(spark, d):
    """Every user's query has an automatic rule; those are stale that the log's first third hardly knows."""
    log = query_log(spark, d)
    registry = log.select(rules.normalised("query").alias("query")).distinct().withColumn("auto", F.lit(True))
    return rules.stale_rules(registry, rules.frequencies(log, END - 20 * DAY, 20 * DAY), END).select("query")


@query("t8_refreshed", f"WITH {BASE} SELECT event_type, ts, round(sum(value), 6) AS value FROM s WHERE ts BETWEEN {B} - 2 * 3600000 AND {B} GROUP BY 1, 2")
def _(spark, d):
    """A pre-aggregate's table, written over its last two intervals and read again."""
    path = store.scratch(spark, "aggregate")
    rules.refresh(both(spark, d), rules.load(RULES)[0], B, path)
    return flat(spark.read.parquet(path), "event_type")


@query("t9_routed", f"WITH {BASE} SELECT event_type, ts, round(sum(value), 6) AS value FROM s WHERE ts BETWEEN {START} AND {END} GROUP BY 1, 2")
def _(spark, d):
    """The entry with the best score among those of equal shape names the table that answers."""
    rows = both(spark, d)
    asked = "sum  BY (event_type) (events_value)"
    tables = {"wrong": rows.where("false"), "right": agg.aggregate(rows, "sum", by=["event_type"]), "other": rows}
    registry = [
        {"query": "sum by (event_type) (events_value)", "table": "wrong", "auto": False, "frequency": 1.0, "last_ts": 0},
        {"query": "sum by (event_type)  (events_value)", "table": "right", "auto": True, "frequency": 30.0, "last_ts": END - 60_000},
        {"query": "events_value", "table": "other", "auto": True, "frequency": 1000.0, "last_ts": END},
    ]
    return flat(tables[rules.route(asked, registry, END)["table"]], "event_type")


STATES = f"""{BASE}, f AS (SELECT *, value > 50 AS active, lag(value > 50) OVER w AS was, ts - lag(ts) OVER w > 3600000 AS gap FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts, seq)),
        i AS (SELECT *, sum(CASE WHEN active AND (NOT coalesce(was, false) OR coalesce(gap, true)) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM f),
        a AS (SELECT *, min(ts) OVER (PARTITION BY event_type, island) AS active_at FROM i WHERE active)"""


@query("t12_template", f"WITH {STATES} SELECT 'critical' AS severity, event_type, ts, round(value, 6) AS value, active_at, CASE WHEN ts - active_at >= 60000 THEN 'firing' ELSE 'pending' END AS state FROM a")
def _(spark, d):
    rule = rules.from_template("critical", "high", "events_value", "gt 50")
    states = rules.alert_states(by_type(spark, d), rule)
    return states.select(F.lit(rule.labels["severity"]).alias("severity"), F.col("labels")["event_type"].alias("event_type"), "ts", rounded(), "active_at", "state")


# --- streams, which work off what has arrived
def _arrived(spark: SparkSession, df: DataFrame) -> str:
    path = store.scratch(spark, "arrived")
    df.write.parquet(path)
    return path


def _worked_off(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path = store.scratch(spark, "stream")
    streaming.run_once(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_rollup", f"WITH {BASE}, w AS (SELECT max(ts) - 600000 AS mark FROM s) SELECT '{{event_type=' || event_type || ', user_id=' || user_id || '}}' AS series, ts - ts % 3600000 AS bucket, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg, count(*) AS count, round(arg_max(value, (ts, seq)), 6) AS last FROM s, w WHERE ts - ts % 3600000 + 3600000 <= mark GROUP BY 1, 2")
def _(spark, d):
    """The windows that the watermark, 10 minutes behind the last sample, has passed."""
    out = _worked_off(spark, streaming.rollup_stream(streaming.read_samples(spark, _arrived(spark, both(spark, d)), files_per_trigger=100_000), "L3"))
    return out.select("series", "bucket", *(rounded(c, name=c) for c in ("min", "max", "avg")), "count", rounded("last", name="last"))


@query(
    "stream_alerts",
    f"""WITH {BASE}, f AS (SELECT *, value > 30 AS active, lag(value > 30) OVER w AS was, ts - lag(ts) OVER w > 3600000 AS gap FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts, seq)),
        i AS (SELECT *, sum(CASE WHEN active AND (NOT coalesce(was, false) OR coalesce(gap, true)) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM f),
        a AS (SELECT *, min(ts) OVER (PARTITION BY event_type, island) AS active_at FROM i WHERE active)
        SELECT event_type, ts, round(value, 6) AS value, active_at, CASE WHEN ts - active_at >= 600000 THEN 'firing' ELSE 'pending' END AS state FROM a""",
)
def _(spark, d):
    """The states of ``alert_states``, kept from batch to batch."""
    rows = by_type(spark, d)
    out = _worked_off(spark, streaming.alert_stream(streaming.read_samples(spark, _arrived(spark, rows), files_per_trigger=100_000), ALERT))
    names = rows.select("series_id", F.col("labels")["event_type"].alias("event_type")).distinct()
    return out.join(names, "series_id").select("event_type", "ts", rounded(), "active_at", "state")


@query("stream_ingest", ALL)
def _(spark, d):
    """Exposition text that arrives in files."""
    path = store.scratch(spark, "lines")
    text.write_exposition(both(spark, d)).write.text(path)
    return flat(_worked_off(spark, streaming.read_lines(spark, path, 0)), "event_type", "user_id")


@query("s15_scrape_files", ALL)
def _(spark, d):
    path = store.scratch(spark, "scraped")
    text.write_exposition(both(spark, d)).write.text(path)
    return flat(text.read_exposition(spark, path, 0)[0], "event_type", "user_id")


@query("f9_at_start_of_store", f"WITH {BASE} SELECT event_type, user_id, {END}::BIGINT AS ts, count(*)::DOUBLE AS value FROM s WHERE ts > {A} AND ts <= {B} GROUP BY 1, 2")
def _(spark, d):
    """A store's scan as the source of a query: it is asked for the range that the selector needs."""
    s = stored(spark, d)
    return flat(evaluate(f"count_over_time(events_value[{B - A}ms] @ {B})", lambda a, b: s.scan("events_value", start=a, end=b), START, END), "event_type", "user_id")
