"""Registered queries of the series engine over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import model
from .functions import scalar as fn
from .operators import aggregate as agg
from .operators import analytics, binary, histogram, metadata, rollup, rules
from .operators import over_time as ot
from .operators import select as sel
from .operators.select import Matcher
from .plans.compile import evaluate, evaluate_range
from .plans.natural import to_query
from .sources import documents, store, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400_000
#: 2024-01-01 and the end of January, UTC.
START, END = 1_704_067_200_000, 1_706_659_200_000
#: 2024-01-10 00:00 to 2024-01-12 12:00.
A, B = START + 9 * DAY, START + 11 * DAY + DAY // 2
BASE = "s AS (SELECT event_type, user_id::VARCHAR AS user_id, epoch_us(ts)//1000 AS ts, value, event_id AS seq FROM events)"
#: Mean of each user and type and day.
DAILY = f"{BASE}, d AS (SELECT event_type, user_id, ts - ts % {DAY} AS ts, avg(value) AS value FROM s GROUP BY ALL)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn_: Query) -> Query:
        QUERIES[name] = fn_
        if sql is not None:
            ORACLES[name] = sql
        return fn_

    return register


def rounded(col: str | Column = "value", digits: int = 6, name: str = "value") -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits).alias(name)


def flat(df: DataFrame, *labels: str, value: Column | None = None) -> DataFrame:
    """Labels as columns, time and value."""
    return df.select(*(F.col("labels").getItem(n).alias(n) for n in labels), "ts", rounded() if value is None else value)


def both(spark: SparkSession, d: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return model.events(spark, d, start=start, end=end)


def by_type(spark: SparkSession, d: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return model.events(spark, d, ("event_type",), start, end)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return rollup.downsample(both(spark, d), "L4")


def expression(name: str, expr: str, sql: str, *labels: str, source: Query = both, start: int = START, end: int = END, digits: int = 6, **options) -> None:
    """A query given as an expression."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return flat(evaluate(expr, lambda a, b: source(spark, d, a, b), start, end, **options), *labels, value=rounded(digits=digits))

    query(name, sql)(run)


def per_sample(name: str, expr: str, sql: str, *labels: str) -> None:
    """A function of each sample, over all samples."""
    expression(name, expr, sql, *labels)


# --- flagship: the daily mean of each series, summed by type
expression(
    "flagship_daily_sum", "sum by (event_type) (events_value)",
    f"WITH {DAILY} SELECT event_type, ts, round(sum(value), 6) AS value FROM d GROUP BY ALL", "event_type", rollup="auto", end=START + 31 * DAY,
)

# --- scans and selection
expression("s1_series_lookup", 'events_value{event_type="click", user_id="7"}', f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s WHERE event_type = 'click' AND user_id = '7' AND ts BETWEEN {START} AND {END}", "event_type", "user_id")
expression("s2_time_range", "events_value", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s WHERE ts BETWEEN {A} AND {B}", "event_type", "user_id", start=A, end=B)
expression("s3_scan_rollup", "events_value", f"WITH {BASE} SELECT event_type, user_id, ts - ts % 300000 AS ts, round(avg(value), 6) AS value FROM s WHERE ts BETWEEN {A} AND {B} GROUP BY 1, 2, 3", "event_type", "user_id", start=A, end=B, rollup="auto")


@query("s4_whole_series", f"WITH {BASE} SELECT event_type, ts, round(value, 6) AS value FROM s WHERE event_type = 'view'")
def _(spark, d):
    rows = by_type(spark, d)
    wanted = rows.where(F.col("labels")["event_type"] == "view").select("series_id").first()
    return flat(sel.series(rows, wanted[0] if wanted else 0), "event_type")


@query("s7_rollup_function", f"WITH {BASE} SELECT event_type, ts - ts % 3600000 AS ts, round(arg_max(value, (ts, seq)), 6) AS value FROM s GROUP BY 1, 2")
def _(spark, d):
    return flat(rollup.as_samples(rollup.rollup(by_type(spark, d), "L3"), "last"), "event_type")


@query("s10_tiers", f"WITH {BASE} SELECT CASE WHEN ({END} - ts) / 3600000.0 <= 24 THEN 'hot' WHEN ({END} - ts) / 3600000.0 <= 168 THEN 'warm' WHEN ({END} - ts) / 3600000.0 <= 720 THEN 'cold' ELSE 'archive' END AS tier, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    return both(spark, d).groupBy(store.tier_of(F.col("ts"), END).alias("tier")).agg(F.count("*").alias("n"))


@query("s14_federated", f"WITH {BASE} SELECT 'a' AS node_name, 'events_value' AS metric, count(*) AS n FROM s UNION ALL SELECT 'b', 'lineitem_l_quantity', count(*) FROM lineitem")
def _(spark, d):
    return store.federated({"a": both(spark, d), "b": model.lineitem(spark, d)}).groupBy("node_name", "metric").agg(F.count("*").alias("n"))


for _name, _matcher, _where in (
    ("f2_match_equal", 'event_type="click"', "event_type = 'click'"),
    ("f3_match_not_equal", 'event_type!="click"', "event_type <> 'click'"),
    ("f4_match_regex", 'event_type=~"click|v.*"', "regexp_full_match(event_type, 'click|v.*')"),
    ("f5_match_not_regex", 'event_type!~"click|v.*"', "NOT regexp_full_match(event_type, 'click|v.*')"),
    ("f6_matchers", 'event_type=~"[cp].*", user_id!="3", job=""', "regexp_full_match(event_type, '[cp].*') AND user_id <> '3'"),
):
    per_sample(_name, f"events_value{{{_matcher}}}", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s WHERE {_where}", "event_type", "user_id")

expression("f7_matrix", 'count_over_time(events_value{event_type="click"}[36h])', f"WITH {BASE} SELECT event_type, user_id, {B}::BIGINT AS ts, round(count(*)::DOUBLE, 6) AS value FROM s WHERE event_type = 'click' AND ts > {B} - 129600000 AND ts <= {B} GROUP BY 1, 2", "event_type", "user_id", start=B, end=B)
expression("f8_offset", "events_value offset 1d", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s WHERE ts BETWEEN {A - DAY} AND {B - DAY}", "event_type", "user_id", start=A, end=B)


@query("f9_at", f"WITH {BASE}, t AS (SELECT max(ts) AS m FROM s) SELECT event_type, user_id, ts, round(value, 6) AS value FROM s, t WHERE ts = m")
def _(spark, d):
    last = both(spark, d).agg(F.max("ts")).first()[0]
    return flat(evaluate(f"events_value @ {last}", both(spark, d), START, END), "event_type", "user_id")


expression("f10_subquery", "events_value[10d:1s]", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s WHERE ts BETWEEN {B - 10 * DAY} AND {B} AND (ts - {B - 10 * DAY}) % 1000 = 0", "event_type", "user_id", start=B, end=B)
expression(
    "f10_subquery_of_daily", "sum_over_time(sum(events_value @ end())[2d:1d])",
    f"WITH {BASE}, g AS (SELECT unnest([{B - 2 * DAY}, {B - DAY}, {B}]) AS t), x AS (SELECT t, sum(value) AS value FROM g JOIN s ON s.ts = g.t GROUP BY t) SELECT {B}::BIGINT AS ts, round(sum(value), 6) AS value FROM x HAVING count(*) > 0", start=B, end=B,
)


_GRID = f"g AS (SELECT unnest(range({B} - 5 * {DAY}, {B} + 1, {DAY})) AS t)"
expression(
    "f10_subquery_of_rates", "max_over_time(sum by (event_type) (increase(events_value[2d]))[5d:1d])",
    f"""WITH {BASE}, {_GRID}, i AS (SELECT event_type, user_id, t, max(ts) AS ts, arg_max(value, (ts, seq)) - arg_min(value, (ts, seq)) AS value FROM g JOIN s ON ts > t - 2 * {DAY} AND ts <= t GROUP BY 1, 2, 3 HAVING max(ts) > min(ts)),
        x AS (SELECT event_type, t, ts, sum(value) AS value FROM i GROUP BY 1, 2, 3) SELECT event_type, {B}::BIGINT AS ts, round(max(value), 6) AS value FROM x GROUP BY 1""",
    "event_type", start=B, end=B,
)
expression(
    "f10_subquery_of_means", "avg_over_time(avg_over_time(events_value[36h])[5d:1d])",
    f"WITH {BASE}, {_GRID}, i AS (SELECT event_type, user_id, t, avg(value) AS value FROM g JOIN s ON ts > t - 129600000 AND ts <= t GROUP BY 1, 2, 3) SELECT event_type, user_id, {B}::BIGINT AS ts, round(avg(value), 6) AS value FROM i GROUP BY 1, 2",
    "event_type", "user_id", start=B, end=B,
)


@query("f15_range_query", f"WITH {BASE} SELECT event_type, ts, round(sum(value), 6) AS value FROM s WHERE ts BETWEEN {START} AND {START + 30 * DAY} GROUP BY 1, 2")
def _(spark, d):
    return flat(evaluate_range("sum by (event_type) (events_value)", partial(both, spark, d), START, START + 30 * DAY, 60_000), "event_type")


@query("f11_compare", f"WITH {BASE} SELECT event_type, value > 50 AS matches, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d):
    return sel.compare(both(spark, d), ">", 50.0).groupBy(F.col("labels")["event_type"].alias("event_type"), "matches").agg(F.count("*").alias("n"))


@query("f12_filter_map", f"WITH {BASE} SELECT event_type, user_id, ts, round(value * 2, 6) AS value FROM s WHERE value >= 90")
def _(spark, d):
    return flat(sel.map_values(sel.where(both(spark, d), F.col("value") >= 90), F.col("value") * 2), "event_type", "user_id")


@query("f13_project_labels", f"WITH {BASE} SELECT '{{user_id=' || user_id || '}}' AS series, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d):
    kept = sel.keep_labels(both(spark, d), ["user_id"])
    return kept.groupBy(model.label_text().alias("series")).agg(F.count("*").alias("n"))


@query("f13_drop_labels", f"WITH {BASE} SELECT '{{event_type=' || event_type || '}}' AS series, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d):
    kept = sel.drop_labels(both(spark, d), ["user_id"])
    return kept.groupBy(model.label_text().alias("series")).agg(F.count("*").alias("n"))


# --- vectors with vectors
def pair(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = daily(spark, d)
    return sel.match(rows, Matcher("event_type", "=", "click")), sel.match(rows, Matcher("event_type", "=", "purchase"))


PAIR = f"{DAILY}, p AS (SELECT a.user_id, a.ts, a.value AS x, b.value AS y FROM d a JOIN d b USING (user_id, ts) WHERE a.event_type = 'click' AND b.event_type = 'purchase')"
_OPS = {
    "j1_join_add": ("+", "x + y"), "j6_sub": ("-", "x - y"), "j6_mul": ("*", "x * y"), "j7_div": ("/", "CASE WHEN y = 0 THEN 'nan'::DOUBLE ELSE x / y END"), "j8_mod": ("%", "CASE WHEN y = 0 THEN 'nan'::DOUBLE ELSE fmod(x, y) END"),
    "j10_greater": (">", "CASE WHEN x > y THEN 1.0 ELSE 0.0 END::DOUBLE"), "j10_less_equal": ("<=", "CASE WHEN x <= y THEN 1.0 ELSE 0.0 END::DOUBLE"), "j10_not_equal": ("!=", "CASE WHEN x <> y THEN 1.0 ELSE 0.0 END::DOUBLE"),
}


def _join(name: str, op: str, sql: str) -> None:
    def run(spark, d):
        a, b = pair(spark, d)
        return flat(binary.vector_vector(a, b, op, ignoring=["event_type"]), "user_id")

    # at a wide scale x % y jumps where x / y is close to a whole number
    query(name, f"WITH {PAIR} SELECT user_id, ts, round({sql}, 6) AS value FROM p")(run)


for _name, (_op, _sql) in _OPS.items():
    _join(_name, _op, _sql)


@query("j3_on", f"WITH {PAIR} SELECT user_id, ts, round(x - y, 6) AS value FROM p")
def _(spark, d):
    a, b = pair(spark, d)
    return flat(binary.vector_vector(a, b, "-", on=["user_id"]), "user_id")


@query("j4_group_left", f"WITH {DAILY}, t AS (SELECT user_id, ts, sum(value) AS total FROM d GROUP BY ALL) SELECT event_type, user_id, ts, round(value / total, 6) AS value FROM d JOIN t USING (user_id, ts)")
def _(spark, d):
    rows = daily(spark, d)
    total = agg.aggregate(rows, "sum", by=["user_id"])
    return flat(binary.vector_vector(rows, total, "/", on=["user_id"], group="left"), "event_type", "user_id")


per_sample("j5_vector_scalar", 'events_value{event_type="view"} * 2 + 1', f"WITH {BASE} SELECT user_id, ts, round(value * 2 + 1, 6) AS value FROM s WHERE event_type = 'view'", "user_id")
@query("j4_group_right", f"WITH {DAILY}, t AS (SELECT user_id, ts, sum(value) AS total, count(*)::VARCHAR AS kinds FROM d GROUP BY ALL) SELECT event_type, user_id, kinds, ts, round(total - value, 6) AS value FROM d JOIN t USING (user_id, ts)")
def _(spark, d):
    """The one side on the left, one of its labels copied to the many."""
    rows = daily(spark, d)
    kinds = agg.aggregate(rows, "count", by=["user_id"]).select(F.col("labels")["user_id"].alias("u"), "ts", F.col("value").cast("int").cast("string").alias("kinds"))
    total = agg.aggregate(rows, "sum", by=["user_id"])
    one = total.join(kinds, (F.col("labels")["user_id"] == F.col("u")) & (total["ts"] == kinds["ts"])).select(*(total[c] for c in model.COLUMNS), "kinds")
    one = one.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("kinds"), "kinds"))).select(model.COLUMNS)
    return flat(binary.vector_vector(one, rows, "-", on=["user_id"], group="right", include=("kinds",)), "event_type", "user_id", "kinds")


@query("j2_positional", f"WITH {DAILY}, n AS (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS k FROM d WHERE event_type IN ('click', 'view')) SELECT a.user_id, a.ts, round(a.value + b.value, 6) AS value FROM n a JOIN n b ON a.k = b.k AND a.ts = b.ts WHERE a.event_type = 'click' AND b.event_type = 'view'")
def _(spark, d):
    rows = daily(spark, d)
    sides = (sel.match(rows, Matcher("event_type", "=", t)) for t in ("click", "view"))
    return flat(binary.positional(*sides, "+"), "user_id")


_MEAN = "scalar(avg(avg_over_time(events_value[31d] @ end())))"
SERIES_MEAN = f"{BASE}, o AS (SELECT avg(v) AS m FROM (SELECT avg(value) AS v FROM s WHERE ts > {END - 31 * DAY} AND ts <= {END} GROUP BY event_type, user_id))"
expression("j5_scalar_left", f"{_MEAN} * events_value", f"WITH {SERIES_MEAN} SELECT event_type, user_id, ts, round(m * value, 6) AS value FROM s, o", "event_type", "user_id")
expression("j5_scalar_nested", f"events_value * ({_MEAN} + 1) - -{_MEAN}", f"WITH {SERIES_MEAN} SELECT event_type, user_id, ts, round(value * (m + 1) + m, 6) AS value FROM s, o", "event_type", "user_id")
expression("j10_scalar_filter", f"events_value > {_MEAN}", f"WITH {SERIES_MEAN} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s, o WHERE value > m", "event_type", "user_id")
expression("j10_scalar_filter_left", f"{_MEAN} >= events_value", f"WITH {SERIES_MEAN} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s, o WHERE m >= value", "event_type", "user_id")
expression("j10_scalar_bool", f"events_value < bool {_MEAN}", f"WITH {SERIES_MEAN} SELECT event_type, user_id, ts, CASE WHEN value < m THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM s, o", "event_type", "user_id")
per_sample("j9_power", 'events_value{event_type="view"} ^ 2', f"WITH {BASE} SELECT user_id, ts, round(value ^ 2, 6) AS value FROM s WHERE event_type = 'view'", "user_id")
per_sample("j10_filter", "events_value > 75", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s WHERE value > 75", "event_type", "user_id")
per_sample("j10_bool", "events_value > bool 75", f"WITH {BASE} SELECT event_type, user_id, ts, CASE WHEN value > 75 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM s", "event_type", "user_id")
per_sample("j11_negate", "-events_value", f"WITH {BASE} SELECT event_type, user_id, ts, round(-value, 6) AS value FROM s", "event_type", "user_id")


@query("j12_array_arithmetic", "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, embedding[2:]), lambda z: CASE WHEN z[2] IS NULL THEN 0 ELSE z[1]::DOUBLE * z[2]::DOUBLE END)), 6) AS value FROM embeddings")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("v", F.col("embedding").cast("array<double>"))
    product = agg.array_arithmetic(F.col("v"), F.slice("v", 2, F.size("v")), "*")
    return rows.select("vec_id", rounded(agg.array_aggregate(product, "sum")))


@query("j13_array_scale", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE / 4)), 6) AS value FROM embeddings")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("v", F.col("embedding").cast("array<double>"))
    return rows.select("vec_id", rounded(agg.array_aggregate(agg.array_scale(F.col("v"), 4.0, "/"), "sum")))


# --- aggregations
_AGGS = {"g1_sum": ("sum", "sum(value)"), "g2_avg": ("avg", "avg(value)"), "g3_min": ("min", "min(value)"), "g4_max": ("max", "max(value)"), "g5_count": ("count", "count(*)::DOUBLE"), "g6_stddev": ("stddev", "stddev_pop(value)"), "g7_stdvar": ("stdvar", "var_pop(value)"), "g10_quantile": ("quantile", "quantile_cont(value, 0.9)")}
for _name, (_op, _sql) in _AGGS.items():
    _head = "quantile by (event_type) (0.9, events_value)" if _op == "quantile" else f"{_op} by (event_type) (events_value)"
    expression(_name, _head, f"WITH {DAILY} SELECT event_type, ts, round({_sql}, 6) AS value FROM d GROUP BY event_type, ts", "event_type", rollup="auto", end=START + 31 * DAY)


def _collapsed(name: str, op: str, sql: str) -> None:
    def run(spark, d):
        return flat(agg.aggregate(both(spark, d), op, by=["event_type"], collapse_time=True, start=START), "event_type")

    query(name, f"WITH {BASE} SELECT event_type, {START}::BIGINT AS ts, round({sql}, 6) AS value FROM s GROUP BY event_type")(run)


for _name, (_op, _sql) in _AGGS.items():
    _collapsed(f"{_name}_over_all", _op, _sql.replace("0.9", "0.5"))

expression("g8_topk", "topk(10, events_value)", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s WHERE ts BETWEEN {START} AND {END} ORDER BY s.value DESC, s.ts, seq LIMIT 10", "event_type", "user_id")
expression("g9_bottomk", "bottomk(10, events_value)", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s WHERE ts BETWEEN {START} AND {END} ORDER BY s.value, s.ts, seq LIMIT 10", "event_type", "user_id")


@query("g8_topk_per_day", f"WITH {DAILY}, m AS (SELECT user_id, ts, sum(value) AS value FROM d GROUP BY ALL) SELECT ts, round(value, 6) AS value FROM m QUALIFY row_number() OVER (PARTITION BY ts ORDER BY value DESC, user_id) <= 3")
def _(spark, d):
    return flat(agg.top(agg.aggregate(daily(spark, d), "sum", by=["user_id"]), 3, per_time=True))


expression("g11_count_values", 'count_values by (event_type) ("v", floor(events_value))', f"WITH {BASE} SELECT event_type, printf('%.0f', floor(value)) AS v, {START}::BIGINT AS ts, count(*)::DOUBLE AS value FROM s WHERE ts BETWEEN {START} AND {END} GROUP BY 1, 2", "event_type", "v")


@query("g12_value_text", f"WITH {BASE} SELECT CASE WHEN value = floor(value) THEN printf('%.0f', value) ELSE regexp_replace(printf('%.6f', value), '\\.?0+$', '') END AS text, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    return both(spark, d).groupBy(agg.value_text().alias("text")).agg(F.count("*").alias("n"))


expression("g14_without", "sum without (user_id) (events_value)", f"WITH {DAILY} SELECT event_type, ts, round(sum(value), 6) AS value FROM d GROUP BY ALL", "event_type", rollup="auto", end=START + 31 * DAY)
expression("g15_global", "avg(events_value)", f"WITH {DAILY} SELECT ts, round(avg(value), 6) AS value FROM d GROUP BY ALL", rollup="auto", end=START + 31 * DAY)


@query("g18_array_aggregate", "SELECT vec_id, round(list_avg(list_transform(embedding, lambda v: v::DOUBLE)), 6) AS mean, round(list_min(embedding)::DOUBLE, 6) AS least, round(list_max(embedding)::DOUBLE, 6) AS greatest, len(embedding)::DOUBLE AS n FROM embeddings")
def _(spark, d):
    v = F.col("embedding").cast("array<double>")
    parts = (("avg", "mean"), ("min", "least"), ("max", "greatest"))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *(rounded(agg.array_aggregate(v, op), name=n) for op, n in parts), agg.array_aggregate(v, "count").alias("n"))


for _op in ("sum", "avg", "min", "max"):

    def _running(spark, d, op=_op):
        return flat(agg.running(both(spark, d), op, slice_ms=3 * DAY), "event_type", "user_id")

    query(f"g19_running_{_op}", f"WITH {BASE} SELECT event_type, user_id, ts, round({_op}(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 6) AS value FROM s")(_running)

# --- over time
LAGGED = f"{BASE}, l AS (SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, seq DESC) AS back FROM s WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, seq))"
ENDS = f"{BASE}, e AS (SELECT event_type, user_id, min(ts) AS a, max(ts) AS b, arg_min(value, (ts, seq)) AS fv, arg_max(value, (ts, seq)) AS lv, count(*) AS n, regr_slope(value, ts - f) AS slope, regr_intercept(value, ts - f) AS cut FROM (SELECT *, min(ts) OVER (PARTITION BY event_type, user_id) AS f FROM s) GROUP BY 1, 2)"
expression("r1_rate", "rate(events_value[31d])", f"WITH {LAGGED} SELECT event_type, user_id, ts, round((value - pv) / (ts - pts), 12) AS value FROM l WHERE ts > pts AND value >= pv", "event_type", "user_id", start=END, end=END, digits=12)


@query("r1_rate_sliced", f"WITH {LAGGED} SELECT event_type, user_id, ts, round((value - pv) / (ts - pts) * 1000, 9) AS value FROM l WHERE ts > pts AND value >= pv")
def _(spark, d):
    return flat(ot.rate(both(spark, d), per_second=True, slice_ms=DAY), "event_type", "user_id", value=rounded(digits=9))


expression("r2_irate", "irate(events_value[31d])", f"WITH {LAGGED} SELECT event_type, user_id, ts, round((value - pv) / (ts - pts), 12) AS value FROM l WHERE back = 1 AND ts > pts", "event_type", "user_id", start=END, end=END, digits=12)
expression("r3_increase", "increase(events_value[31d])", f"WITH {ENDS} SELECT event_type, user_id, b AS ts, round(lv - fv, 6) AS value FROM e WHERE b > a", "event_type", "user_id", start=END, end=END)
expression("r4_delta", "delta(events_value[31d])", f"WITH {ENDS} SELECT event_type, user_id, b AS ts, round(lv - fv, 6) AS value FROM e WHERE n > 1", "event_type", "user_id", start=END, end=END)
expression("r5_idelta", "idelta(events_value[31d])", f"WITH {LAGGED} SELECT event_type, user_id, ts, round(value - pv, 6) AS value FROM l WHERE back = 1 AND pv IS NOT NULL", "event_type", "user_id", start=END, end=END)
expression("r6_resets", "resets(events_value[31d])", f"WITH {LAGGED} SELECT event_type, user_id, {END}::BIGINT AS ts, count(*) FILTER (value < pv)::DOUBLE AS value FROM l GROUP BY 1, 2", "event_type", "user_id", start=END, end=END)
expression("r7_changes", "changes(events_value[31d])", f"WITH {LAGGED} SELECT event_type, user_id, {END}::BIGINT AS ts, count(*) FILTER (value <> pv)::DOUBLE AS value FROM l GROUP BY 1, 2", "event_type", "user_id", start=END, end=END)
expression("r8_deriv", "deriv(events_value[31d])", f"WITH {ENDS} SELECT event_type, user_id, b AS ts, round(slope, 12) AS value FROM e WHERE b > a", "event_type", "user_id", start=END, end=END, digits=12)
expression("r9_predict_linear", "predict_linear(events_value[31d], 3600)", f"WITH {ENDS} SELECT event_type, user_id, {END}::BIGINT AS ts, round(cut + slope * (b - a + 3600000.0::DOUBLE), 4) AS value FROM e WHERE b > a", "event_type", "user_id", start=END, end=END, digits=4)
expression(
    "r10_holt_winters", "holt_winters(events_value[31d], 0.3, 0.1)",
    f"""WITH RECURSIVE {BASE}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, seq) AS k FROM s),
        h AS (SELECT a.event_type, a.user_id, 1 AS k, a.ts, a.value AS level, b.value - a.value AS trend FROM n a JOIN n b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.k = 1 AND b.k = 2
              UNION ALL
              SELECT event_type, user_id, k, ts, l, 0.1::DOUBLE * (l - level) + 0.9::DOUBLE * trend FROM (
                SELECT h.event_type, h.user_id, n.k, n.ts, 0.3::DOUBLE * n.value + 0.7::DOUBLE * (h.level + h.trend) AS l, h.level, h.trend FROM h JOIN n ON n.event_type = h.event_type AND n.user_id = h.user_id AND n.k = h.k + 1))
        SELECT event_type, user_id, ts, round(level + trend, 6) AS value FROM h WHERE k > 1""",
    "event_type", "user_id", start=END, end=END,
)


expression("r11_absent_over_time", "absent_over_time(events_value[1d])", f"WITH {BASE}, k AS (SELECT DISTINCT event_type, user_id FROM s) SELECT event_type, user_id, {A}::BIGINT AS ts, 1.0::DOUBLE AS value FROM k ANTI JOIN (SELECT * FROM s WHERE ts > {A} - 86400000 AND ts <= {A}) USING (event_type, user_id)", "event_type", "user_id", start=A, end=A)


@query("r11_absent_of_known", f"WITH {BASE}, k AS (SELECT DISTINCT event_type, user_id FROM s) SELECT event_type, user_id, {A}::BIGINT AS ts, 1.0::DOUBLE AS value FROM k ANTI JOIN (SELECT * FROM s WHERE ts > {A} - 86400000 AND ts <= {A}) USING (event_type, user_id)")
def _(spark, d):
    rows = both(spark, d)
    return flat(ot.absent_over_time(rows, evaluate("events_value[1d]", rows, A), A), "event_type", "user_id")


expression("r12_present_over_time", "present_over_time(events_value[1d])", f"WITH {BASE} SELECT event_type, user_id, {A}::BIGINT AS ts, count(*)::DOUBLE AS value FROM s WHERE ts > {A} - 86400000 AND ts <= {A} GROUP BY 1, 2", "event_type", "user_id", start=A, end=A)


@query("r13_rate_with_resets", f"WITH {LAGGED} SELECT event_type, user_id, ts, round((value - pv) / (ts - pts), 12) AS value FROM l WHERE ts > pts")
def _(spark, d):
    return flat(ot.rate(both(spark, d), skip_resets=False), "event_type", "user_id", value=rounded(digits=12))


for _op, _sql in {"avg": "avg(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "count": "count(*)::DOUBLE", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)", "quantile": "quantile_cont(value, 0.95)"}.items():
    _args = "0.95, events_value[7d]" if _op == "quantile" else "events_value[7d]"
    expression(f"r14_{_op}_over_time", f"{_op}_over_time({_args})", f"WITH {BASE} SELECT event_type, user_id, {B}::BIGINT AS ts, round({_sql}, 6) AS value FROM s WHERE ts > {B} - 604800000 AND ts <= {B} GROUP BY 1, 2", "event_type", "user_id", start=B, end=B)


@query("r14_sliding_sum", f"WITH {BASE} SELECT event_type, user_id, ts, round(sum(value) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW), 6) AS value FROM s")
def _(spark, d):
    return flat(ot.sliding(both(spark, d), "sum", DAY), "event_type", "user_id")


@query("r14_on_grid", f"WITH {BASE}, g AS (SELECT unnest(range({A}, {B} + 1, 21600000)) AS t) SELECT event_type, user_id, t AS ts, round(avg(value), 6) AS value FROM g JOIN s ON s.ts > t - 86400000 AND s.ts <= t GROUP BY 1, 2, 3")
def _(spark, d):
    return flat(ot.on_grid(both(spark, d), "avg", A, B, DAY // 4, DAY), "event_type", "user_id")


@query("r16_linear_residuals", f"WITH {BASE} SELECT event_type, user_id, ts, round(coalesce(value - (2 * lag(value) OVER w - lag(value, 2) OVER w), value), 6) AS value FROM s WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, seq)")
def _(spark, d):
    return flat(ot.linear_residuals(both(spark, d), 3 * DAY), "event_type", "user_id")


@query("r16_undo_residuals", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 4) AS value FROM s")
def _(spark, d):
    return flat(ot.undo_linear_residuals(ot.linear_residuals(both(spark, d), 3 * DAY), 3 * DAY), "event_type", "user_id", value=rounded(digits=4))


# --- functions of values
def _math(name: str, call: str, sql: str) -> None:
    per_sample(name, call, f"WITH {BASE} SELECT event_type, user_id, ts, round({sql}, 6) AS value FROM s", "event_type", "user_id")


for _name, _call, _sql in (
    ("m1_abs", "abs(events_value - 50)", "abs(value - 50)"), ("m1_ceil", "ceil(events_value)", "ceil(value)"), ("m1_floor", "floor(events_value)", "floor(value)"),
    ("m2_round", "round(events_value, 1)", "floor(value * 10 + 0.5) / 10"), ("m3_clamp", "clamp(events_value, 20, 60)", "least(greatest(value, 20), 60)"), ("m4_clamp_max", "clamp_max(events_value, 60)", "least(value, 60)"), ("m5_clamp_min", "clamp_min(events_value, 20)", "greatest(value, 20)"),
    ("m6_exp", "exp(events_value / 100)", "exp(value / 100)"), ("m6_ln", "ln(events_value + 1)", "ln(value + 1)"), ("m6_log2", "log2(events_value + 1)", "log2(value + 1)"), ("m6_log10", "log10(events_value + 1)", "log10(value + 1)"), ("m6_sqrt", "sqrt(events_value)", "sqrt(value)"),
    ("m7_sin", "sin(events_value)", "sin(value)"), ("m7_cos", "cos(events_value)", "cos(value)"), ("m7_tan", "tan(events_value / 200)", "tan(value / 200)"), ("m7_asin", "asin(events_value / 10000)", "asin(value / 10000)"), ("m7_acos", "acos(events_value / 10000)", "acos(value / 10000)"), ("m7_atan", "atan(events_value)", "atan(value)"),
    ("m7_sinh", "sinh(events_value / 100)", "sinh(value / 100)"), ("m7_cosh", "cosh(events_value / 100)", "cosh(value / 100)"), ("m7_tanh", "tanh(events_value / 100)", "tanh(value / 100)"), ("m7_atanh", "atanh(events_value / 10000)", "atanh(value / 10000)"),
    ("m8_asinh", "asinh(events_value)", "asinh(value)"), ("m8_acosh", "acosh(events_value + 1)", "acosh(value + 1)"), ("m8_deg", "deg(events_value)", "degrees(value)"), ("m8_rad", "rad(events_value)", "radians(value)"),
):
    _math(_name, _call, _sql)

expression("m11_scalar", "vector(scalar(sum(sum_over_time(events_value[1d]))))", f"WITH {BASE} SELECT {A}::BIGINT AS ts, round(sum(value), 6) AS value FROM s WHERE ts > {A} - 86400000 AND ts <= {A}", start=A, end=A)
expression("m12_vector", "vector(7)", f"SELECT {A}::BIGINT AS ts, 7.0::DOUBLE AS value", start=A, end=A)


@query(
    "m13_histogram_quantile",
    f"""WITH {BASE}, b AS (SELECT unnest([25.0::DOUBLE, 50, 100, 200, 'inf'::DOUBLE]) AS le), c AS (SELECT event_type, ts - ts % {DAY} AS ts, le, sum(CASE WHEN value <= le THEN 1.0::DOUBLE ELSE 0 END) AS n FROM s, b GROUP BY 1, 2, 3),
        w AS (SELECT *, lag(le) OVER o AS lower, lag(n) OVER o AS before, max(n) OVER (PARTITION BY event_type, ts) AS total FROM c WINDOW o AS (PARTITION BY event_type, ts ORDER BY le)),
        h AS (SELECT * FROM w WHERE n >= 0.9::DOUBLE * total OR le = 'inf' QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY le) = 1)
        SELECT event_type, ts, round(CASE WHEN total = 0 THEN 'nan'::DOUBLE WHEN le = 'inf' THEN lower ELSE coalesce(lower, 0) + (le - coalesce(lower, 0)) * (0.9::DOUBLE * total - coalesce(before, 0)) / (n - coalesce(before, 0)) END, 6) AS value FROM h""",
)
def _(spark, d):
    rows = by_type(spark, d).withColumn("ts", rollup.bucket("ts", DAY))
    bounds = F.explode(F.array(*map(F.lit, ("25", "50", "100", "200", "+Inf"))))
    rows = rows.withColumn("le", bounds)
    below = F.when((F.col("le") == "+Inf") | (F.col("value") <= F.expr("try_cast(le as double)")), 1.0).otherwise(0.0)
    rows = rows.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("le"), "le"))).withColumn("value", below)
    return flat(histogram.histogram_quantile(agg.aggregate(rows, "sum", by=["event_type", "le"]), 0.9), "event_type")


@query("m13_nearest_rank", f"WITH {BASE} SELECT event_type, user_id, b AS ts, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type, user_id) AS n, max(ts) OVER (PARTITION BY event_type, user_id) AS b FROM s) WHERE k = floor((n - 1) * 0.99::DOUBLE)")
def _(spark, d):
    return flat(histogram.nearest_rank(both(spark, d)), "event_type", "user_id")


def sorted_series(spark: SparkSession, d: str, descending: bool) -> DataFrame:
    """Every series by its first value, with its place: fn.sort's rows numbered by one count for each of their partitions."""
    first = both(spark, d).groupBy("series_id", "metric", "labels").agg(F.min_by("value", model.order()).alias("value"))
    path = store.scratch(spark, "sorted")
    fn.sort(first.withColumns({"ts": F.lit(0).cast("long"), "seq": F.lit(0).cast("long")}), descending).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # the place of the first row of a partition: rows of all partitions before, one row a partition
    counts = numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = numbered.withColumn("p", part).withColumn("row", row).join(before, "p").withColumn("at", F.col("before") + F.col("row") + 1)
    # fn.sort orders equal values by series id, the SQL by labels
    among = Window.partitionBy("value")
    place = F.min("at").over(among) + F.row_number().over(among.orderBy(F.col("labels")["event_type"], F.col("labels")["user_id"])) - 1
    return placed.select(*(F.col("labels")[n].alias(n) for n in ("event_type", "user_id")), rounded(), place.cast("long").alias("place"))


for _name, _order in (("m14_sort", "ASC"), ("m14_sort_desc", "DESC")):
    query(_name, f"WITH {BASE} SELECT event_type, user_id, round(arg_min(value, (ts, seq)), 6) AS value, row_number() OVER (ORDER BY arg_min(value, (ts, seq)) {_order}, event_type, user_id) AS place FROM s GROUP BY 1, 2")(partial(sorted_series, descending=_order == "DESC"))


expression("m15_absent", 'absent(events_value{event_type="none"})', f"SELECT {A}::BIGINT AS ts, 1.0::DOUBLE AS value", start=A, end=B)
per_sample("label_replace", 'label_replace(events_value, "kind", "$1-x", "event_type", "(c.*|v).*")', f"WITH {BASE} SELECT CASE WHEN regexp_full_match(event_type, '(c.*|v).*') THEN regexp_extract(event_type, '^(c.*|v).*$', 1) || '-x' END AS kind, event_type, user_id, ts, round(value, 6) AS value FROM s", "kind", "event_type", "user_id")
per_sample("label_join", 'label_join(events_value, "both", "/", "event_type", "user_id")', f"WITH {BASE} SELECT event_type || '/' || user_id AS both, ts, round(value, 6) AS value FROM s", "both")
expression("date_time", "vector(time())", f"SELECT {A}::BIGINT AS ts, {A // 1000}::DOUBLE AS value", start=A, end=A)
per_sample("date_timestamp", "timestamp(events_value)", f"WITH {BASE} SELECT event_type, user_id, ts, round(ts / 1000.0::DOUBLE, 6) AS value FROM s", "event_type", "user_id")
for _name, _sql in {"day_of_month": "day(t)", "day_of_week": "dayofweek(t)", "day_of_year": "dayofyear(t)", "days_in_month": "day(last_day(t))", "hour": "hour(t)", "minute": "minute(t)", "month": "month(t)", "year": "year(t)"}.items():
    per_sample(f"date_{_name}", f"{_name}(timestamp(events_value))", f"WITH {BASE} SELECT event_type, user_id, ts, ({_sql})::DOUBLE AS value FROM (SELECT *, make_timestamp((ts // 1000) * 1000000) AS t FROM s)", "event_type", "user_id")


# --- sets
def users(spark, d) -> tuple[DataFrame, DataFrame]:
    """All days and users, dealt to two sides that share most users: ids that end in 1 are on the right only, in 2 on the left only."""
    rows = rollup.downsample(model.events(spark, d, ("user_id",)), "L4")
    return sel.match(rows, Matcher("user_id", "!~", ".*1")), sel.match(rows, Matcher("user_id", "!~", ".*2"))


SETS = f"{BASE}, u AS (SELECT user_id, ts - ts % {DAY} AS ts, avg(value) AS value FROM s GROUP BY ALL), l AS (SELECT * FROM u WHERE user_id NOT LIKE '%1'), r AS (SELECT * FROM u WHERE user_id NOT LIKE '%2')"
for _name, _fn, _sql in (
    ("u1_and", binary.and_, "SELECT * FROM l WHERE user_id IN (SELECT user_id FROM r)"),
    ("u2_or", binary.or_, "SELECT * FROM l UNION ALL SELECT * FROM r WHERE user_id NOT IN (SELECT user_id FROM l)"),
    ("u3_unless", binary.unless, "SELECT * FROM l WHERE user_id NOT IN (SELECT user_id FROM r)"),
    ("u6_merge", binary.merge, "SELECT * FROM l UNION SELECT * FROM r"),
):

    def _sets(spark, d, op=_fn):
        return flat(op(*users(spark, d)), "user_id")

    query(_name, f"WITH {SETS} SELECT user_id, ts, round(value, 6) AS value FROM ({_sql})")(_sets)


@query("u1_and_by_time", f"WITH {SETS} SELECT user_id, ts, round(value, 6) AS value FROM l WHERE (user_id, ts) IN (SELECT (user_id, ts) FROM r)")
def _(spark, d):
    return flat(binary.and_(*users(spark, d), by_time=True), "user_id")


# --- what there is
@query("l4_label_names", "SELECT unnest(['__name__', 'event_type', 'user_id']) AS name")
def _(spark, d):
    return metadata.label_names(both(spark, d))


@query("l5_label_values", "SELECT DISTINCT event_type AS value FROM events")
def _(spark, d):
    return metadata.label_values(both(spark, d), "event_type")


@query("l6_series", f"WITH {BASE} SELECT DISTINCT '{{event_type=' || event_type || ', user_id=' || user_id || '}}' AS label_key FROM s WHERE event_type = 'click' OR user_id = '3'")
def _(spark, d):
    return metadata.series(both(spark, d), (Matcher("event_type", "=", "click"),), (Matcher("user_id", "=", "3"),)).select("label_key")


@query("l7_stats", f"WITH {BASE} SELECT count(DISTINCT (event_type, user_id)) AS series, count(*) AS samples, min(ts) AS first_ts, max(ts) AS last_ts FROM s")
def _(spark, d):
    return metadata.stats(both(spark, d))


@query("l8_metadata", "SELECT 'events_value' AS metric, 'gauge' AS type")
def _(spark, d):
    return metadata.metadata(both(spark, d))


@query("l3_limit", "SELECT 'events_value' AS metric, 'gauge' AS type UNION ALL SELECT 'lineitem_l_quantity', 'gauge'")
def _(spark, d):
    return metadata.metadata(both(spark, d).unionByName(model.lineitem(spark, d)).unionByName(model.orders(spark, d)), limit=2)


@query("l9_matrix_result", f"WITH {BASE} SELECT event_type, user_id, ts - ts % {DAY} AS day, count(*) AS n, round(sum(value), 6) AS total, min(ts) AS first_ts, round(arg_max(value, (ts, seq)), 6) AS last FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    rows = metadata.matrix_result(both(spark, d))
    total = F.aggregate("samples", F.lit(0.0), lambda a, p: a + p["value"])
    return rows.select(*(F.col("labels")[n].alias(n) for n in ("event_type", "user_id")), (F.col("chunk") * DAY).alias("day"), F.size("samples").cast("long").alias("n"), rounded(total, name="total"), F.col("samples")[0]["ts"].alias("first_ts"), rounded(F.element_at("samples", -1)["value"], name="last"))


@query("l9_instant_result", f"WITH {BASE} SELECT event_type, user_id, min(ts) AS ts, CASE WHEN v = floor(v) THEN printf('%.0f', v) ELSE regexp_replace(printf('%.6f', v), '\\.?0+$', '') END AS value FROM (SELECT event_type, user_id, min(ts) AS ts, min((ts, value)) AS m, m[2] AS v FROM s GROUP BY 1, 2) GROUP BY 1, 2, v")
def _(spark, d):
    return metadata.instant_result(both(spark, d)).select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"), "ts", "value")


# --- rollups
@query("d2_rollup", f"WITH {BASE} SELECT event_type, user_id, ts - ts % 3600000 AS bucket, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg, round(sum(value), 6) AS sum, count(*) AS count, round(arg_max(value, (ts, seq)), 6) AS last, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    return _rolled(rollup.rollup(both(spark, d), "L3"))


def _rolled(df: DataFrame) -> DataFrame:
    return df.select(*(F.col("labels")[n].alias(n) for n in ("event_type", "user_id")), "bucket", *(rounded(c, name=c) for c in ("min", "max", "avg", "sum")), "count", rounded("last", name="last"), "first_ts", "last_ts")


@query("d2_rollup_nan", f"WITH {BASE}, v AS (SELECT *, CASE WHEN value > 40 THEN 'nan'::DOUBLE ELSE value END AS w FROM s) SELECT event_type, user_id, ts - ts % {DAY} AS bucket, coalesce(min(w) FILTER (NOT isnan(w)), 1.7976931348623157e308) AS min, coalesce(max(w) FILTER (NOT isnan(w)), -1.7976931348623157e308) AS max, count(*) AS count FROM v GROUP BY 1, 2, 3")
def _(spark, d):
    """min and max pass over NaN, in both kinds of rollup."""
    rows = both(spark, d).withColumn("value", F.when(F.col("value") > 40, F.lit(float("nan"))).otherwise(F.col("value")))
    rolled = rollup.rollup_again(rollup.rollup(rows, "L3"), "L4")
    return rolled.select(*(F.col("labels")[n].alias(n) for n in ("event_type", "user_id")), "bucket", "min", "max", "count")


@query("d8_rollup_of_rollup", f"WITH {BASE} SELECT event_type, user_id, ts - ts % {DAY} AS bucket, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS avg, round(sum(value), 6) AS sum, count(*) AS count, round(arg_max(value, (ts, seq)), 6) AS last, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    return _rolled(rollup.rollup_again(rollup.rollup(both(spark, d), "L3"), "L4"))


@query("d2_rollup_lineitem", f"SELECT l_returnflag, l_linestatus, (epoch_us(l_shipdate)//1000) - (epoch_us(l_shipdate)//1000) % {DAY} AS bucket, round(avg(l_quantity), 6) AS avg, count(*) AS count FROM lineitem GROUP BY 1, 2, 3")
def _(spark, d):
    rolled = rollup.rollup(model.lineitem(spark, d), "L4")
    return rolled.select(*(F.col("labels")[n].alias(n) for n in ("l_returnflag", "l_linestatus")), "bucket", rounded("avg", name="avg"), "count")


@query("d7_build_levels", f"WITH {BASE}, k AS (SELECT * FROM s WHERE ts <= {END}) SELECT 'L2' AS level, count(*) AS windows, sum(n)::BIGINT AS samples FROM (SELECT count(*) AS n FROM k GROUP BY event_type, user_id, ts - ts % 300000) UNION ALL SELECT 'L3', count(*), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM k GROUP BY event_type, user_id, ts - ts % 3600000) UNION ALL SELECT 'L4', count(*), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM k GROUP BY event_type, user_id, ts - ts % {DAY})")
def _(spark, d):
    out = None
    for level, df in rollup.build(both(spark, d), END, ("L2", "L3", "L4")).items():
        part = df.agg(F.lit(level).alias("level"), F.count("*").alias("windows"), F.sum("count").alias("samples"))
        out = part if out is None else out.unionByName(part)
    return out


# --- rules
@query("t1_recording_rule", f"WITH {DAILY} SELECT 'type:daily' AS metric, event_type, 'x' AS team, ts, round(sum(value), 6) AS value FROM d GROUP BY event_type, ts")
def _(spark, d):
    rule = rules.Rule("type:daily", "sum by (event_type) (events_value)", labels={"team": "x"})
    return flat(rules.record(evaluate(rule.expr, daily(spark, d), START, END), rule), "event_type", "team").withColumn("metric", F.lit(rule.name))


@query("t2_violations", f"WITH {BASE} SELECT event_type, value > 95 AS active, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d):
    return rules.violations(both(spark, d), rules.Condition.parse("gt 95")).groupBy(F.col("labels")["event_type"].alias("event_type"), "active").agg(F.count("*").alias("n"))


ALERT = rules.Rule("high", "events_value", "alert", hold_s=600.0, condition=rules.Condition("gt", 30.0))


@query(
    "t3_alert_states",
    f"""WITH {BASE}, f AS (SELECT *, value > 30 AS active, lag(value > 30) OVER w AS was, ts - lag(ts) OVER w > 3600000 AS gap FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts, seq)),
        i AS (SELECT *, sum(CASE WHEN active AND (NOT coalesce(was, false) OR coalesce(gap, true)) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM f),
        a AS (SELECT *, min(ts) OVER (PARTITION BY event_type, island) AS active_at FROM i WHERE active)
        SELECT event_type, ts, round(value, 6) AS value, active_at, CASE WHEN ts - active_at >= 600000 THEN 'firing' ELSE 'pending' END AS state FROM a""",
)
def _(spark, d):
    states = rules.alert_states(by_type(spark, d), ALERT)
    return states.select(F.col("labels")["event_type"].alias("event_type"), "ts", rounded(), "active_at", "state")


@query("t6_query_shapes", f"WITH {BASE} SELECT 'sum(x{{a=\"' || user_id || '\",b=\"' || event_type || '\"}}[DURATION]) by (c) > INF' AS query, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    """White space, order of matchers, durations, keywords and constants don't tell queries apart."""
    kind, user = F.col("labels")["event_type"], F.col("labels")["user_id"]
    one = F.concat(F.lit('sum(x{b="'), kind, F.lit('",  a="'), user, F.lit('"}[5m])   BY (c) > inf'))
    two = F.concat(F.lit(' sum(x{a="'), user, F.lit('", b="'), kind, F.lit('"}[2h]) by (c) > inf'))
    log = both(spark, d).select(F.when(F.col("seq") % 2 == 0, one).otherwise(two).alias("query"))
    return log.groupBy(rules.normalised("query").alias("query")).agg(F.count("*").alias("n"))


@query("t6_query_patterns", "SELECT * FROM (VALUES (true, true, true, 'a', 'job=api'), (true, false, false, 'b', 'x!~y'), (false, true, false, 'c,d', ''), (false, false, false, 'e', 'k=v')) t(aggregates, rates, sums, metrics, conditions)")
def _(spark, d):
    texts = ('sum(rate(a{job="api"}[5m])) by (status)', 'max without (z) (b{x!~"y"})', "irate(c[1h]) / on (q) d", 'e{k="v"} offset 1d > 3')
    found = [rules.pattern_of(t) for t in texts]
    rows = [(p.aggregates, p.rates, p.sums, ",".join(p.metrics), ",".join(map("".join, p.conditions))) for p in found]
    return spark.createDataFrame(rows, "aggregates boolean, rates boolean, sums boolean, metrics string, conditions string")


@query("t6_query_frequency", f"WITH {BASE} SELECT event_type || '[DURATION]' AS query, count(*) AS n, max(ts) AS last_ts, count(*) >= 20 AS frequent FROM s WHERE ts > {B} - 86400000 AND ts <= {B} GROUP BY 1")
def _(spark, d):
    log = both(spark, d).select(F.concat(F.col("labels")["event_type"], F.lit("["), F.col("labels")["user_id"], F.lit("m]")).alias("query"), "ts")
    return rules.frequencies(log, B)


# --- analytics
@query("y1_basic_stats", f"WITH {BASE} SELECT event_type, user_id, count(*) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM s GROUP BY 1, 2")
def _(spark, d):
    out = analytics.basic_stats(both(spark, d))
    return out.select(*(F.col("labels")[n].alias(n) for n in ("event_type", "user_id")), "count", *(rounded(c, name=c) for c in ("min", "max", "mean", "median", "std", "p25", "p75", "p95", "p99")))


@query("y2_trend", f"WITH {BASE}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, seq) - 1 AS i FROM s) SELECT event_type, round(regr_slope(value, i), 9) AS slope, round(regr_intercept(value, i), 6) AS intercept, round(CASE WHEN var_pop(value) = 0 THEN 1 ELSE corr(value, i) ^ 2 END, 6) AS r2, CASE WHEN regr_slope(value, i) > 0.001 THEN 'up' WHEN regr_slope(value, i) < -0.001 THEN 'down' ELSE 'stable' END AS direction FROM n GROUP BY 1")
def _(spark, d):
    return analytics.trend(by_type(spark, d)).select(F.col("labels")["event_type"].alias("event_type"), rounded("slope", 9, "slope"), rounded("intercept", name="intercept"), rounded("r2", name="r2"), "direction")


@query("y3_periodicity", f"WITH {BASE}, m AS (SELECT event_type, user_id, ts - ts % 3600000 AS ts, count(*) FROM s GROUP BY 1, 2, 3), l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS step FROM m), c AS (SELECT event_type, user_id, step, count(*) AS n FROM l WHERE step > 0 GROUP BY ALL), k AS (SELECT event_type, user_id, count(*) AS samples FROM m GROUP BY ALL) SELECT event_type, user_id, arg_max(step, (n, -step)) AS period, round(max(n) / sum(n), 6) AS confidence, max(n) / sum(n) > 0.8 AS periodic FROM c JOIN k USING (event_type, user_id) WHERE samples >= 10 GROUP BY 1, 2")
def _(spark, d):
    out = analytics.periodicity(rollup.downsample(both(spark, d), "L3"))
    return out.select(*(F.col("labels")[n].alias(n) for n in ("event_type", "user_id")), "period", rounded("confidence", name="confidence"), "periodic")


@query("y4_thinned", f"WITH {BASE} SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM s) WHERE i % (CASE WHEN c > 100 THEN c // 100 ELSE 1 END) = 0 GROUP BY 1")
def _(spark, d):
    return analytics.thinned(by_type(spark, d), 100).groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("n"), rounded(F.sum("value"), 4, "total"))


@query(
    "y5_time_features",
    f"""WITH {BASE}, k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS m FROM s)
        SELECT event_type, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(avg((value - m) ^ 3) / stddev_pop(value) ^ 3, 6) AS skewness, round(avg((value - m) ^ 4) / var_pop(value) ^ 2 - 3, 6) AS kurtosis,
               round(median(value), 6) AS median, round(max(value) FILTER (k = n // 4), 6) AS q1, round(max(value) FILTER (k = 3 * n // 4), 6) AS q3, round(max(value) - min(value), 6) AS range, count(*) AS count FROM k GROUP BY 1""",
)
def _(spark, d):
    out = analytics.time_features(by_type(spark, d))
    return out.select(F.col("labels")["event_type"].alias("event_type"), *(rounded(c, name=c) for c in ("mean", "variance", "skewness", "kurtosis", "median", "q1", "q3", "range")), "count")


@query(
    "y6_frequency_features",
    f"""WITH {BASE}, n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s),
        u AS (SELECT DISTINCT user_id, n FROM n), k AS (SELECT user_id, unnest(range(0, n // 2)) AS k FROM u WHERE n >= 32),
        p AS (SELECT user_id, k, sum(value * cos(2 * pi() * ((k * i) % n) / n)) ^ 2 + sum(value * sin(2 * pi() * ((k * i) % n) / n)) ^ 2 AS p FROM k JOIN n USING (user_id) GROUP BY 1, 2),
        t AS (SELECT *, sum(p) OVER (PARTITION BY user_id) AS total FROM p), c AS (SELECT *, sum(k * p / total) OVER (PARTITION BY user_id) AS c FROM t),
        f AS (SELECT user_id, arg_max(k, (p, k))::DOUBLE AS dominant, round(max(c), 6) AS centroid, round(sum((k - c) ^ 2 * p / total), 6) AS spread, round(-sum(CASE WHEN p > 0 THEN p / total * ln(p / total) ELSE 0 END), 6) AS entropy, round(max(total), 2) AS power FROM c GROUP BY 1)
        SELECT user_id, dominant, centroid, spread, entropy, power FROM u LEFT JOIN f USING (user_id)""",
)
def _(spark, d):
    rows = model.events(spark, d, ("user_id",))
    out = analytics.frequency_features(rows).join(metadata.series(rows).select("series_id", F.col("labels")["user_id"].alias("user_id")), "series_id")
    return out.select("user_id", *(rounded(c, name=c) for c in ("dominant", "centroid", "spread", "entropy")), rounded("power", 2, "power"))


@query(
    "y7_shape_features",
    f"""WITH {BASE}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, seq) - 1 AS i, lag(value) OVER (PARTITION BY event_type ORDER BY ts, seq) AS b, avg(value) OVER (PARTITION BY event_type) AS m FROM s)
        SELECT event_type, round(regr_slope(value, i), 9) AS slope, round(arg_max(value, i) - arg_min(value, i), 6) AS trend, round(corr(value, i) ^ 2, 6) AS r2, round(sum(CASE WHEN (b >= 0 AND value < 0) OR (b < 0 AND value >= 0) THEN 1.0::DOUBLE ELSE 0 END) / (count(*) - 1), 6) AS zero_crossing_rate,
               round(avg(abs(value - m)), 6) AS mad, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)) / sqrt(avg(value * value)), 6) AS crest, round(sqrt(avg(value * value)) / avg(abs(value - m)), 6) AS shape FROM n GROUP BY 1""",
)
def _(spark, d):
    out = analytics.shape_features(by_type(spark, d))
    return out.select(F.col("labels")["event_type"].alias("event_type"), rounded("slope", 9, "slope"), *(rounded(c, name=c) for c in ("trend", "r2", "zero_crossing_rate", "mad", "rms", "crest", "shape")))


STATS = "count(*) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99"


@query(
    "y4_summary",
    f"""WITH {BASE}, n AS (SELECT *, row_number() OVER w - 1 AS i, ts - lag(ts) OVER w AS step, count(*) OVER (PARTITION BY event_type, user_id) AS c FROM s WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, seq)),
        a AS (SELECT event_type, user_id, {STATS}, round(coalesce(regr_slope(value, i), 0), 9) AS slope, round(regr_intercept(value, i), 6) AS intercept, round(CASE WHEN var_pop(value) = 0 THEN 1 ELSE corr(value, i) ^ 2 END, 6) AS r2, CASE WHEN regr_slope(value, i) > 0.001 THEN 'up' WHEN regr_slope(value, i) < -0.001 THEN 'down' ELSE 'stable' END AS direction FROM n WHERE c >= 10 GROUP BY 1, 2),
        k AS (SELECT event_type, user_id, step, count(*) AS n FROM n WHERE c >= 10 AND step > 0 GROUP BY 1, 2, 3), p AS (SELECT event_type, user_id, arg_max(step, (n, -step)) AS period, round(max(n) / sum(n), 6) AS confidence, max(n) / sum(n) > 0.8 AS periodic FROM k GROUP BY 1, 2)
        SELECT * FROM a LEFT JOIN p USING (event_type, user_id)""",
)
def _(spark, d):
    out = analytics.summary(both(spark, d))
    numbers = ("min", "max", "mean", "median", "std", "p25", "p75", "p95", "p99", "intercept", "r2", "confidence")
    return out.select(*(F.col("labels")[n].alias(n) for n in ("event_type", "user_id")), "count", *(rounded(n, name=n) for n in numbers), rounded("slope", 9, "slope"), "direction", "period", "periodic")


@query(
    "y8_features",
    f"""WITH {BASE}, n AS (SELECT user_id, value, row_number() OVER w - 1 AS i, lag(value) OVER w AS b, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS k FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)),
        t AS (SELECT user_id, count(*) AS count, round(avg(value), 9) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS std, round(avg((value - m) ^ 3) / stddev_pop(value) ^ 3, 6) AS skewness, round(avg((value - m) ^ 4) / var_pop(value) ^ 2 - 3, 6) AS kurtosis, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median,
              round(max(value) FILTER (k = n // 4), 6) AS q1, round(max(value) FILTER (k = 3 * n // 4), 6) AS q3, round(max(value) - min(value), 6) AS range, round(sum(value), 6) AS sum,
              round(regr_slope(value, i), 9) AS slope, round(arg_max(value, i) - arg_min(value, i), 6) AS trend, round(corr(value, i) ^ 2, 6) AS r2, round(sum(CASE WHEN (b >= 0 AND value < 0) OR (b < 0 AND value >= 0) THEN 1.0::DOUBLE ELSE 0 END) / (count(*) - 1), 6) AS zero_crossing_rate,
              round(avg(abs(value - m)), 6) AS mad, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)) / sqrt(avg(value * value)), 6) AS crest, round(sqrt(avg(value * value)) / avg(abs(value - m)), 6) AS shape FROM n WHERE n >= 10 GROUP BY 1),
        u AS (SELECT DISTINCT user_id, n FROM n WHERE n >= 10), kk AS (SELECT user_id, unnest(range(0, n // 2)) AS k FROM u WHERE n >= 32),
        p AS (SELECT kk.user_id, kk.k, sum(value * cos(2 * pi() * ((kk.k * i) % n) / n)) ^ 2 + sum(value * sin(2 * pi() * ((kk.k * i) % n) / n)) ^ 2 AS p FROM kk JOIN n ON kk.user_id = n.user_id GROUP BY 1, 2),
        tt AS (SELECT *, sum(p) OVER (PARTITION BY user_id) AS total FROM p), c AS (SELECT *, sum(k * p / total) OVER (PARTITION BY user_id) AS c FROM tt),
        f AS (SELECT user_id, arg_max(k, (p, k))::DOUBLE AS dominant, round(max(c), 6) AS centroid, round(sum((k - c) ^ 2 * p / total), 6) AS spread, round(-sum(CASE WHEN p > 0 THEN p / total * ln(p / total) ELSE 0 END), 6) AS entropy, round(max(total), 2) AS power FROM c GROUP BY 1)
        SELECT * FROM t LEFT JOIN f USING (user_id)""",
)
def _(spark, d):
    rows = model.events(spark, d, ("user_id",))
    out = analytics.features(rows).join(metadata.series(rows).select("series_id", F.col("labels")["user_id"].alias("user_id")), "series_id")
    fields = {"time": ("variance", "std", "skewness", "kurtosis", "min", "max", "median", "q1", "q3", "range", "sum"), "shape": ("trend", "r2", "zero_crossing_rate", "mad", "rms", "crest", "shape"), "frequency": ("dominant", "centroid", "spread", "entropy")}
    numbers = (rounded(f"{part}.{name}", name=name) for part, names in fields.items() for name in names)
    return out.select("user_id", F.col("time.count").alias("count"), *numbers, rounded("time.mean", 9, "mean"), rounded("shape.slope", 9, "slope"), rounded("frequency.power", 2, "power"))


@query("y10_request", f"WITH {DAILY} SELECT event_type, ts, round(avg(value), 6) AS value FROM d GROUP BY 1, 2")
def _(spark, d):
    return flat(evaluate(to_query("What is the average events value by event type?"), daily(spark, d), START, END), "event_type")


@query("y10_requests", """SELECT * FROM (VALUES ('average cpu usage by host', 'avg by (host) (cpu_usage)'), ('sum of requests in the last 5 minutes', 'sum_over_time(requests[5m])'), ('cpu usage for the last 5 minutes', 'cpu_usage[5m]'), ('cpu usage greater than 80%', 'cpu_usage > 80'),
  ('memory usage less than 50%', 'memory_usage < 50'), ('rate of requests per minute for the last 1 hour', 'rate(requests[1h]) * 60000'), ('top 5 cpu usage', 'topk(5, cpu_usage)'), ('95th percentile of latency', 'quantile(0.95, latency)'), ('increase of errors in the last 2 days', 'increase(errors[2d])'), ('show memory usage', 'memory_usage')) t(request, expression)""")
def _(spark, d):
    requests = ("average cpu usage by host", "sum of requests in the last 5 minutes", "cpu usage for the last 5 minutes", "cpu usage greater than 80%", "memory usage less than 50%", "rate of requests per minute for the last 1 hour", "top 5 cpu usage", "95th percentile of latency", "increase of errors in the last 2 days", "show memory usage")
    return spark.createDataFrame([(r, to_query(r)) for r in requests], "request string, expression string")


def _levels(bounds: tuple[int, ...], finer: int = 0) -> str:
    return "CASE " + " ".join(f"WHEN h <= {most} THEN 'L{max(0, k - finer)}'" for k, most in enumerate(bounds)) + f" ELSE 'L{4 - finer}' END"


@query(
    "d6_level_by_policy",
    f"""WITH {BASE}, e AS (SELECT event_type, user_id, (max(ts) - min(ts)) // 3600000 AS h FROM s GROUP BY 1, 2)
        SELECT event_type, user_id, h AS hours, {_levels((1, 24, 168, 720))} AS auto, {_levels((1, 24, 168, 720))} AS conservative, {_levels((1, 12, 72, 336))} AS aggressive, {_levels((1, 24, 168, 720), 1)} AS rate, {_levels((1, 12, 72, 336), 1)} AS increase, 'L0' AS quantile, 'L0' AS raw FROM e""",
)
def _(spark, d):
    spans = both(spark, d).groupBy("series_id", "labels").agg((F.max("ts") - F.min("ts")).alias("span"))
    levels = {"auto": ("auto", None), "conservative": ("conservative", "sum"), "aggressive": ("aggressive", "avg"), "rate": ("auto", "rate"), "increase": ("aggressive", "increase"), "quantile": ("auto", "quantile"), "raw": ("raw", None)}
    return spans.select(*(F.col("labels")[n].alias(n) for n in ("event_type", "user_id")), F.floor(F.col("span") / 3_600_000).cast("long").alias("hours"), *(rollup.level_column(F.col("span"), *a).alias(n) for n, a in levels.items()))


@query(
    "r15_smoothing_residuals",
    f"""WITH RECURSIVE {BASE}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, seq) AS k FROM s),
        h AS (SELECT a.event_type, a.user_id, 2::BIGINT AS k, b.ts, b.value AS residual, a.value AS level, b.value - a.value AS trend FROM n a JOIN n b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.k = 1 AND b.k = 2
              UNION ALL
              SELECT event_type, user_id, k, ts, value - (level + trend), l, 0.1::DOUBLE * (l - level) + 0.9::DOUBLE * trend FROM (
                SELECT h.event_type, h.user_id, n.k, n.ts, n.value, 0.3::DOUBLE * n.value + 0.7::DOUBLE * (h.level + h.trend) AS l, h.level, h.trend FROM h JOIN n ON n.event_type = h.event_type AND n.user_id = h.user_id AND n.k = h.k + 1))
        SELECT event_type, user_id, ts, round(residual, 6) AS value FROM h UNION ALL SELECT event_type, user_id, ts, round(value, 6) FROM n WHERE k = 1""",
)
def _(spark, d):
    return flat(ot.smoothing_residuals(both(spark, d)), "event_type", "user_id")


SMOOTHED = f"""RECURSIVE {BASE}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY event_type, user_id) AS c FROM s),
        h AS (SELECT a.event_type, a.user_id, 1::BIGINT AS k, a.ts, a.c, a.value AS level, b.value - a.value AS trend FROM n a JOIN n b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.k = 1 AND b.k = 2
              UNION ALL
              SELECT event_type, user_id, k, ts, c, l, 0.1::DOUBLE * (l - level) + 0.9::DOUBLE * trend FROM (
                SELECT h.event_type, h.user_id, n.k, n.ts, h.c, 0.3::DOUBLE * n.value + 0.7::DOUBLE * (h.level + h.trend) AS l, h.level, h.trend FROM h JOIN n ON n.event_type = h.event_type AND n.user_id = h.user_id AND n.k = h.k + 1))"""


THIRDS = SMOOTHED.replace("0.3::DOUBLE", "(1.0::DOUBLE / 3)").replace("0.7::DOUBLE", "(2.0::DOUBLE / 3)").replace("0.1::DOUBLE", "(1.0::DOUBLE / 7)").replace("0.9::DOUBLE", "(6.0::DOUBLE / 7)")


@query("r10_holt_winters_sliced", f"WITH {THIRDS} SELECT event_type, user_id, ts, round(level + trend, 6) AS value FROM h WHERE k > 1")
def _(spark, d):
    """Slices of a day side by side."""
    return flat(ot.holt_winters(both(spark, d), 1 / 3, 1 / 7, slice_ms=DAY), "event_type", "user_id")


@query("r15_residuals_sliced", ORACLES["r15_smoothing_residuals"].replace("0.3::DOUBLE", "(1.0::DOUBLE / 3)").replace("0.7::DOUBLE", "(2.0::DOUBLE / 3)").replace("0.1::DOUBLE", "(1.0::DOUBLE / 7)").replace("0.9::DOUBLE", "(6.0::DOUBLE / 7)"))
def _(spark, d):
    return flat(ot.smoothing_residuals(both(spark, d), 1 / 3, 1 / 7, slice_ms=DAY), "event_type", "user_id")


@query("r15_forecast", f"WITH {SMOOTHED} SELECT event_type, user_id, ts, round(level + trend, 6) AS value FROM h WHERE k = c UNION ALL SELECT event_type, user_id, ts, round(value, 6) FROM n WHERE c = 1")
def _(spark, d):
    return flat(ot.smoothing_forecast(both(spark, d)), "event_type", "user_id")


# --- formats: written and read again
@query("i2_exposition_round_trip", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s")
def _(spark, d):
    return flat(text.parse_exposition(text.write_exposition(both(spark, d)), 0)[0], "event_type", "user_id")


@query("i5_json_puts", f"WITH {BASE} SELECT event_type, user_id, ts // 1000 * 1000 AS ts, round(value, 6) AS value FROM s")
def _(spark, d):
    point = F.struct("metric", F.floor(F.col("ts") / 1000).alias("timestamp"), "value", F.col("labels").alias("tags"))
    return flat(documents.parse_puts(both(spark, d).select(F.to_json(point).alias("value")))[0], "event_type", "user_id")


@query("i6_json_batches", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s")
def _(spark, d):
    pairs = F.transform(F.map_entries(F.map_concat("labels", F.create_map(F.lit("__name__"), "metric"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    series = F.struct(pairs.alias("labels"), F.array(F.struct(F.col("ts").alias("timestamp"), F.col("value").cast("string").alias("value"))).alias("samples"))
    return flat(documents.parse_batches(both(spark, d).select(F.to_json(F.struct(F.array(series).alias("timeseries"))).alias("value")))[0], "event_type", "user_id")


@query("k1_json_export", f"WITH {BASE} SELECT event_type, user_id, ts, round(value, 6) AS value FROM s")
def _(spark, d):
    return flat(documents.parse_export(documents.to_json(both(spark, d))), "event_type", "user_id")


@query("k2_csv_export", f"WITH {BASE} SELECT 'events_value' AS metric_name, 'event_type=' || event_type || ',user_id=' || user_id AS labels, ts AS timestamp, round(value, 6) AS value FROM s")
def _(spark, d):
    return documents.to_csv(both(spark, d)).withColumn("value", F.round("value", 6))


@query("k9_retention", f"WITH {BASE} SELECT event_type, count(*) AS n FROM s WHERE ts >= {END} - 7 * {DAY} GROUP BY 1")
def _(spark, d):
    return store.retained(both(spark, d), END, 7).groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count("*").alias("n"))


@query("custom_function", f"WITH {BASE} SELECT event_type, user_id, ts, round(value * value + 1, 6) AS value FROM s")
def _(spark, d):
    fn.register_function("square_plus", lambda v, n: v * v + n)
    return flat(evaluate("square_plus(events_value, 1)", both(spark, d), START, END), "event_type", "user_id")
