"""Operators on small vectors with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import scalar as fn
from seriesmill.operators import aggregate as agg
from seriesmill.operators import analytics, binary, histogram, metadata, rollup, rules
from seriesmill.operators import over_time as ot
from seriesmill.operators import select as sel
from seriesmill.operators.select import Matcher
from seriesmill.plans.compile import Engine, QueryError, evaluate

COUNTER = [("requests", {"job": "a", "instance": "1"}, t, v) for t, v in ((1000, 100), (2000, 200), (3000, 300))]


@pytest.fixture
def counter(vector):
    return vector(*COUNTER)


def line(vector, *values, name="x", step=1000, labels=None):
    return vector(*((name, labels or {"i": "1"}, (k + 1) * step, v) for k, v in enumerate(values)))


def test_rates(counter, points):
    assert points(ot.rate(counter)) == [(2000, 0.1), (3000, 0.1)]
    assert points(ot.rate(counter, per_second=True)) == [(2000, 100.0), (3000, 100.0)]
    assert points(ot.irate(counter)) == [(3000, 0.1)]
    assert points(ot.increase(counter)) == [(3000, 200.0)]
    assert points(ot.delta(counter)) == [(3000, 200.0)]
    assert points(ot.idelta(counter)) == [(3000, 100.0)]
    assert points(ot.deriv(counter)) == [(3000, 0.1)]
    assert points(ot.predict_linear(counter, 60.0)) == [(3000, 6300.0)]
    assert points(ot.resets(counter)) == [(3000, 0.0)]
    assert points(ot.changes(counter)) == [(3000, 2.0)]


def test_resets_and_single_samples(vector, points):
    up_down = line(vector, 1, 5, 2, 2, 7)
    assert points(ot.rate(up_down)) == [(2000, 0.004), (4000, 0.0), (5000, 0.005)]
    assert points(ot.rate(up_down, skip_resets=False))[1] == (3000, -0.003)
    assert points(ot.resets(up_down, 9)) == [(9, 1.0)] and points(ot.changes(up_down, 9)) == [(9, 3.0)]
    one = line(vector, 4)
    assert points(ot.resets(one, 9)) == [(9, 0.0)]
    for f in (ot.rate, ot.irate, ot.increase, ot.delta, ot.idelta, ot.deriv, ot.predict_linear, ot.holt_winters):
        assert points(f(one)) == []


def test_slices_change_nothing(spark, vector):
    random.seed(3)
    rows = [("x", {"i": str(random.randrange(3))}, random.randrange(100_000), random.randrange(50)) for _ in range(300)]
    whole, cut = (sorted((r.series_id, r.ts, r.value) for r in ot.rate(vector(*rows), slice_ms=s).collect()) for s in (None, 7000))
    assert whole == cut


def test_smoothing(vector, points):
    assert [v for _, v in points(ot.holt_winters(line(vector, 1, 3, 2, 5)))] == [5.0, 6.01, 7.5867]
    values = line(vector, 10, 11, 13, 17, 16)
    residuals = ot.linear_residuals(values)
    assert [v for _, v in points(residuals)] == [10, 11, 1, 2, -5]
    assert points(ot.undo_linear_residuals(residuals)) == points(values)
    # level 10 and trend 1 foretell 11; then 11.6 and 1.06 foretell 12.66
    assert [v for _, v in points(ot.smoothing_residuals(values))][:4] == [10, 11, 2, 4.34]
    assert points(ot.smoothing_residuals(line(vector, 3))) == [(1000, 3)]


def test_over_time(vector, points):
    x = line(vector, 1, 2, 3, 4)
    got = {op: points(ot.over_time(x, op, 9))[0][1] for op in ("avg", "min", "max", "sum", "count", "stddev", "stdvar", "last", "quantile")}
    assert got == {"avg": 2.5, "min": 1, "max": 4, "sum": 10, "count": 4, "stddev": 1.118034, "stdvar": 1.25, "last": 4, "quantile": 2.5}
    assert points(ot.sliding(x, "sum", 2000)) == [(1000, 1), (2000, 3), (3000, 5), (4000, 7)]
    assert points(ot.on_grid(x, "sum", 1000, 4000, 1500, 2000)) == [(1000, 1), (2500, 3), (4000, 7)]
    assert points(ot.present_over_time(x, 9)) == [(9, 4)] and points(ot.present_over_time(x, 9, as_one=True)) == [(9, 1)]
    assert points(ot.absent_over_time(x, x.where("ts > 9000"), 9)) == [(9, 1.0)]


def test_selection(counter, points):
    assert points(evaluate("requests @ 2000", counter, 0, 5000)) == [(2000, 200)]
    assert points(evaluate("requests", counter, 1000, 2000)) == [(1000, 100), (2000, 200)]
    assert points(evaluate("requests offset 1s", counter, 2000, 3000)) == [(1000, 100), (2000, 200)]
    assert points(evaluate("sum_over_time(requests[2s])", counter, 3000)) == [(3000, 500)]
    assert points(evaluate("requests[2s:1s]", counter, 3000)) == [(1000, 100), (2000, 200), (3000, 300)]
    assert points(evaluate("rate(requests[2s])[1s:1s]", counter, 3000)) == [(2000, 0.1), (3000, 0.1)]
    assert points(evaluate("requests", counter, 2500, lookback_ms=1000)) == [(2000, 200)]


def test_matchers(vector):
    x = vector(("m", {"job": "api"}, 1, 1), ("m", {"job": "web"}, 1, 2), ("m", {"env": "x"}, 1, 3))
    find = lambda *ms: sorted(r.value for r in sel.match(x, *(Matcher(*m) for m in ms)).collect())
    assert find(("job", "=", "api")) == [1]
    assert find(("job", "!=", "api")) == [2, 3]
    assert find(("job", "=~", "ap")) == [] and find(("job", "=~", "ap.*")) == [1]
    assert find(("job", "!~", "a.*")) == [2, 3]
    assert find(("job", "=", "")) == [3] and find(("job", "!=", "")) == [1, 2]
    assert find(("job", "=", "a"), ("job", "=", "b")) == []
    assert find(("__name__", "=", "other")) == []


def test_range_checks():
    sel.check_range_query(0, 10, 1)
    for bad in ((10, 0, 1), (-1, 0, 1), (0, 1, 0), (0, 31 * 86_400_000, 1)):
        with pytest.raises(ValueError):
            sel.check_range_query(*bad)


def test_aggregations(vector, points):
    x = vector(*(("cpu", {"instance": f"server{i}", "dc": str(i % 2)}, 1000, 10 * i) for i in range(1, 11)))
    assert points(agg.aggregate(x, "sum")) == [(1000, 550)]
    assert points(agg.aggregate(x, "sum", by=["dc"])) == [(1000, 250), (1000, 300)]
    assert points(agg.aggregate(x, "sum", without=["instance"])) == points(agg.aggregate(x, "sum", by=["dc"]))
    assert sorted(r.value for r in agg.top(x, 3).collect()) == [80, 90, 100]
    assert agg.top(x, 0).count() == 0 and agg.top(x, 99, largest=False).count() == 10
    assert agg.top(x, 1, per_time=True, by=["dc"]).count() == 2
    assert points(evaluate("quantile(0.5, cpu)", x, 0, 2000)) == [(1000, 55)]
    names = {r.metric for r in agg.aggregate(x, "sum", without=["instance"]).collect()}, {r.metric for r in agg.aggregate(x, "sum", by=["dc"]).collect()}
    assert names == ({"cpu"}, {""})
    with pytest.raises(ValueError):
        agg.aggregate(x, "quantile", arg=1.5)


def test_nan_in_min_and_max(vector):
    x = vector(("m", {"a": "1"}, 1, math.nan), ("m", {"a": "2"}, 1, 1.0), ("n", {}, 1, math.nan))
    assert [r.value for r in agg.aggregate(x.where("metric = 'm'"), "min").collect()] == [1.0]
    assert [r.value for r in agg.aggregate(x.where("metric = 'm'"), "max").collect()] == [1.0]
    assert [r.value for r in agg.aggregate(x.where("metric = 'n'"), "min").collect()] == [agg.LARGEST]


def test_count_values(vector):
    x = vector(*(("build", {"instance": str(i)}, 1000, v) for i, v in enumerate((1, 1, 2, 2.5, math.nan, math.inf, -math.inf))))
    got = {r.labels["version"]: r.value for r in agg.count_values(x, "version", start=0).collect()}
    assert got == {"1": 2, "2": 1, "2.5": 1, "NaN": 1, "+Inf": 1, "-Inf": 1}


def test_arithmetic_with_zero(vector):
    x = line(vector, 5, 0, -7.5)
    assert all(math.isnan(r.value) for r in binary.vector_scalar(x, "/", 0).collect())
    assert all(math.isnan(r.value) for r in binary.vector_scalar(x, "%", 0).collect())
    assert sorted(r.value for r in binary.vector_scalar(x, "%", 2).collect()) == [-1.5, 0, 1]
    assert sorted(r.value for r in binary.vector_scalar(x, "-", 1, swapped=True).collect()) == [-4, 1, 8.5]
    assert sorted(r.value for r in evaluate("x > bool 1", x, 0, 9000).collect()) == [0, 0, 1]
    assert [r.value for r in evaluate("x > 1", x, 0, 9000).collect()] == [5]
    assert [r.value for r in evaluate("1 + 2 * 3 ^ 2 - 5 % 3", x, 0).collect()] == [17]


def test_vector_matching(vector):
    a = vector(("a", {"job": "x", "i": "1"}, 1, 10), ("a", {"job": "x", "i": "2"}, 1, 20))
    b = vector(("b", {"job": "x", "zone": "z"}, 1, 2))
    out = binary.vector_vector(a, b, "/", on=["job"], group="left", include=("zone",)).collect()
    assert sorted((r.labels["i"], r.labels["zone"], r.value) for r in out) == [("1", "z", 5), ("2", "z", 10)]
    assert sorted(r.value for r in binary.vector_vector(b, a, "/", on=["job"], group="right").collect()) == [0.1, 0.2]
    assert binary.vector_vector(a, b, "/").count() == 0
    assert binary.vector_vector(a, a.withColumn("metric", F.lit("c")), "+").count() == 2
    with pytest.raises(Exception, match="several series"):
        binary.vector_vector(a, b, "/", on=["job"]).collect()
    assert binary.positional(a, a, "+").count() == 2


def test_sets(vector):
    a = vector(("a", {"i": "1"}, 1, 1), ("a", {"i": "2"}, 1, 2))
    b = vector(("a", {"i": "2"}, 2, 3), ("a", {"i": "3"}, 2, 4))
    values = lambda df: sorted(r.value for r in df.collect())
    assert values(binary.and_(a, b)) == [2] and values(binary.unless(a, b)) == [1] and values(binary.or_(a, b)) == [1, 2, 4]
    assert values(binary.and_(a, b, by_time=True)) == []
    assert values(binary.merge(a, a.withColumn("value", F.lit(9.0)), b)) == [1, 2, 3, 4]


def test_values(vector):
    x = line(vector, -2.5, 2.5, 0.0, math.nan, math.inf, -1.0)
    get = lambda name, *a: [r.value for r in fn.apply(x, name, *a).orderBy("ts").collect()]
    assert get("round")[:3] == [-3, 3, 0] and get("round")[4] == math.inf
    assert get("ln")[2] == -math.inf and math.isnan(get("ln")[5]) and math.isnan(get("sqrt")[0])
    assert get("floor")[0] == -3 and get("ceil")[0] == -2 and math.isnan(get("floor")[3])
    assert math.isnan(get("clamp", 0, 1)[3]) and get("clamp_max", 1)[3] == 1 and get("clamp_min", 0)[3] == 0
    assert math.isnan(get("acosh")[2])
    with pytest.raises(ValueError):
        fn.apply(x, "nothing")
    with pytest.raises(QueryError):
        evaluate("nothing(x)", x, 0)


def test_scalars_in_expressions(vector, points):
    x = vector(("x", {"a": "1"}, 1, 5), ("x", {"a": "2"}, 1, 3), ("y", {}, 1, 2), ("z", {}, 1, 4))
    value = lambda q: sorted(v for _, v in points(evaluate(q, x, 1)))
    assert value("x > scalar(y)") == [3, 5] and value("x > scalar(z)") == [5] and value("scalar(z) > x") == [3] and value("x > bool scalar(z)") == [0, 1]
    assert value("scalar(y) * x") == value("x * scalar(y)") == [6, 10] and value("x * (scalar(y) + 1)") == [9, 15]
    assert value("scalar(y) ^ scalar(z)") == [16] and value("10 - scalar(y)") == [8] and value("-scalar(y) + 1") == [-1] and value("scalar(y) < scalar(z)") == [1]
    assert value("vector(scalar(y) * 2)") == [4] and value("abs(-scalar(y))") == [2] and all(map(math.isnan, value("x + scalar(x)"))) and value("x > scalar(x)") == []
    for bad in ("sum(scalar(y))", "x and scalar(y)", "topk(scalar(y), x)"):
        with pytest.raises(QueryError):
            evaluate(bad, x, 1)


def test_absence_of_each_series(vector, points):
    x = vector(("x", {"a": "1"}, 1000, 5), ("x", {"a": "2"}, 9000, 3), ("y", {}, 1, 2))
    got = evaluate("absent_over_time(x[1s])", x, 9500)
    assert [(r.labels, r.ts, r.value) for r in got.collect()] == [({"a": "1"}, 9500, 1.0)]
    # a store is asked for the series of all times
    got = evaluate("absent_over_time(x[1s])", lambda a, b: x if a is None else x.where(F.col("ts").between(a, b)), 9500)
    assert [r.labels for r in got.collect()] == [{"a": "1"}]
    assert points(evaluate("absent_over_time(none[1s])", x, 9500)) == []


def test_subqueries_by_one_plan(vector):
    """Every instant evaluated by itself, and all together."""
    random.seed(3)
    rows = sorted((int(random.uniform(0, 100_000)), random.choice("abc"), random.choice("pq")) for _ in range(300))
    x = vector(*((random.choice(("x", "y")), {"a": a, "b": b}, t, k % 17) for k, (t, a, b) in enumerate(rows)))
    end, length, step = 90_000, 40_000, 7_000
    for inner in ("rate(x[20s])", "sum by (a) (increase(x[30s] offset 5s))", "avg_over_time(x[15s]) * 2 + 1", "max without (b) (x)", "avg(last_over_time(x[20s])) ", "count_over_time(x[20s]) + on (a, b) count_over_time(y[20s])", "abs(-delta(x[30s])) > 3", 'label_replace(changes(x[30s]), "c", "$1", "a", "(.*)")'):
        together = evaluate(f"({inner})[{length}ms:{step}ms]", x, end)
        want = []
        for t in range(end - length, end + 1, step):
            want += [(t, sorted(r.labels.items()), round(r.value, 9)) for r in evaluate(inner, x, t).collect()]
        got = [(r.ts, sorted(r.labels.items()), round(r.value, 9)) for r in together.collect()]
        assert sorted(got) == sorted(want) and (want or inner == "max without (b) (x)"), inner
        assert together._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + together._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 6
    assert evaluate("max_over_time(scalar(x)[10s:5s])", x, end).count() == 1  # planned for each step


def test_scalars_and_absence(vector, points):
    x = line(vector, 3, 4)
    assert points(evaluate("scalar(sum(x @ 1000))", x, 5)) == [(5, 3)]
    assert math.isnan(evaluate("scalar(x)", x, 0, 9000).first().value)
    assert points(evaluate("x + scalar(vector(2))", x, 0, 9000)) == [(1000, 5), (2000, 6)]
    assert points(evaluate("absent(nothing)", x, 7)) == [(7, 1)] and points(evaluate("absent(x)", x, 0, 9000)) == []
    assert points(evaluate("vector(x)", x, 0, 9000)) == [(1000, 3), (2000, 4)]
    assert evaluate("vector(x)", x, 0, 9000).first().labels == {}
    assert [r.value for r in fn.sort(x, descending=True).collect()] == [3, 4]


def test_dates(vector):
    x = line(vector, 1_709_210_096)  # 2024-02-29 12:34:56, a Thursday
    got = {n: fn.date_part(x, n).first().value for n in fn.DATES}
    assert got == {"day_of_month": 29, "day_of_week": 4, "day_of_year": 60, "days_in_month": 29, "hour": 12, "minute": 34, "month": 2, "year": 2024}


def test_labels(vector):
    x = vector(("m", {"a": "svc-7", "b": "y"}, 1, 1))
    assert fn.label_replace(x, "n", "$1", "a", "svc-(.*)").first().labels == {"a": "svc-7", "b": "y", "n": "7"}
    assert fn.label_replace(x, "n", "$1", "a", "svc").first().labels == {"a": "svc-7", "b": "y"}
    assert fn.label_replace(x, "b", "", "a", ".*").first().labels == {"a": "svc-7"}
    assert fn.label_join(x, "c", "/", "a", "none", "b").first().labels["c"] == "svc-7//y"


def test_histograms(vector, points):
    def h(*counts, top="+Inf"):
        return vector(*(("lat_bucket", {"le": le, "job": "a"}, 1, n) for le, n in zip(("0.1", "0.5", "1", top), counts, strict=False)))

    assert points(histogram.histogram_quantile(h(10, 20, 40, 40), 0.5)) == [(1, 0.5)]
    assert points(histogram.histogram_quantile(h(10, 20, 40, 40), 0.25)) == [(1, 0.1)]
    assert points(histogram.histogram_quantile(h(10, 20, 40, 80), 0.9)) == [(1, 1.0)]
    assert math.isnan(histogram.histogram_quantile(h(10, 20, 40, 40, top="2"), 0.5).first().value)
    assert math.isnan(histogram.histogram_quantile(h(0, 0, 0, 0), 0.5).first().value)
    assert points(histogram.nearest_rank(line(vector, *range(1, 101)), 0.99)) == [(100_000, 99)]


def test_rollups(vector, points):
    x = vector(*(("m", {}, t, v) for t, v in ((1000, 10), (2000, 20), (3000, 30), (11000, 40), (12000, 50))))
    rows = {r.bucket: r for r in rollup.rollup(x, resolution=10_000).collect()}
    assert [(b, r["count"], r["avg"], r["sum"], r["min"], r["max"], r["last"]) for b, r in sorted(rows.items())] == [(0, 3, 20, 60, 10, 30, 30), (10_000, 2, 45, 90, 40, 50, 50)]
    assert points(rollup.downsample(x, resolution=10_000)) == [(0, 20), (10_000, 45)]
    assert points(rollup.downsample(x, "L0")) == points(x)
    ramp = vector(*(("r", {}, 1000 * i, i) for i in range(1000)))
    assert [rollup.rollup(ramp, resolution=s).count() for s in (10_000, 60_000, 300_000, 3_600_000)] == [100, 17, 4, 1]
    fine = rollup.rollup(ramp, "L1")
    again = {r.bucket: (r.min, r.max, round(r.avg, 9), r["count"], r.last) for r in rollup.rollup_again(fine, "L2").collect()}
    assert again == {r.bucket: (r.min, r.max, round(r.avg, 9), r["count"], r.last) for r in rollup.rollup(ramp, "L2").collect()}
    assert points(rollup.as_samples(fine, "nothing")) == points(rollup.as_samples(fine, "avg"))


def test_rollup_of_windows_without_numbers(vector):
    values = {"low": (math.nan, -math.inf), "high": (math.nan, math.inf), "both": (-math.inf, math.nan, math.inf), "none": (math.nan, math.nan), "ends": (math.nan, 1.7976931348623157e308, math.inf), "some": (math.nan, 3.0)}
    x = vector(*((name, {}, 60_000 * k, v) for name, vs in values.items() for k, v in enumerate(vs)))
    once, again = ({r.metric: (r.min, r.max, r["count"]) for r in df.collect()} for df in (rollup.rollup(x, "L2"), rollup.rollup_again(rollup.rollup(x, "L1"), "L2")))
    assert again == once and again["low"] == (-math.inf, -math.inf, 2) and again["high"] == (math.inf, math.inf, 2) and again["some"] == (3, 3, 2)
    assert again["none"] == (1.7976931348623157e308, -1.7976931348623157e308, 2)


def test_levels(spark):
    h = 3_600_000
    # what is begun of an hour doesn't count
    assert [rollup.level_by_policy(0, int(x * h)) for x in (1.5, 2, 24.5, 25, 168.5, 169, 720.9, 721)] == ["L0", "L1", "L1", "L2", "L2", "L3", "L3", "L4"]
    assert [rollup.level_by_policy(0, x * h, "auto", f) for x, f in ((24, "rate"), (1, "delta"), (1000, "increase"), (100, "deriv"), (100, "quantile_over_time"), (100, "histogram_quantile"))] == ["L0", "L0", "L3", "L2", "L2", "L0"]
    spans = [0, h, int(1.99 * h), 2 * h, 24 * h, 25 * h - 1, 25 * h, 400 * h, 720 * h, 721 * h]
    for policy in ("auto", "conservative", "aggressive", "raw"):
        for function in (None, "rate", "quantile", "sum"):
            rows = spark.createDataFrame([(x,) for x in spans], "x long").select("x", rollup.level_column(F.col("x"), policy, function).alias("l")).collect()
            assert [r.l for r in rows] == [rollup.level_by_policy(0, r.x, policy, function) for r in rows]
    assert [rollup.level_for(0, x) for x in (h - 1, h, 24 * h, 168 * h, 720 * h)] == ["L0", "L1", "L2", "L3", "L4"]
    assert [rollup.level_by_policy(0, x * h, "conservative") for x in (1, 24, 168, 720, 721)] == ["L0", "L1", "L2", "L3", "L4"]
    assert [rollup.level_by_policy(0, x * h, "aggressive") for x in (1, 12, 72, 336, 337)] == ["L0", "L1", "L2", "L3", "L4"]
    assert rollup.level_by_policy(0, 100 * h, "auto", "rate") == "L1" and rollup.level_by_policy(0, 1000 * h, "auto", "quantile") == "L0"


def test_rules(spark):
    document = '{"groups": [{"name": "g", "interval": "30s", "rules": [{"record": "a:b", "expr": "sum(x)", "labels": {"t": "1"}}, {"alert": "High", "expr": "x", "for": "10m", "condition": "gt 5"}]}]}'
    record, alert = rules.load(document)
    assert (record.name, record.kind, record.interval_s, record.labels) == ("a:b", "record", 30, {"t": "1"})
    assert (alert.kind, alert.hold_s, alert.condition) == ("alert", 600, rules.Condition("gt", 5.0))
    with pytest.raises(ValueError):
        rules.load('{"groups": [{"rules": [{"record": "a"}]}]}')
    with pytest.raises(ValueError):
        rules.Condition.parse("over 5")
    assert rules.from_template("critical", "n", "x", "lt 1").labels == {"severity": "critical"}


def test_recorded_samples(vector):
    rule = rules.Rule("a:b", "sum by (i) (x)", labels={"t": "1"})
    out = rules.evaluate_record(line(vector, 1, 2), rule, 2000).collect()
    assert sorted((r.metric, r.labels["i"], r.labels["t"], r.ts, r.value) for r in out) == [("a:b", "1", "1", 1000, 1), ("a:b", "1", "1", 2000, 2)]


def test_alert_states(vector):
    minute = 60_000
    x = vector(*(("x", {}, t * minute, v) for t, v in ((0, 9), (5, 9), (10, 9), (11, 1), (12, 9), (200, 9), (204, 9))))
    rule = rules.Rule("a", "x", "alert", 300.0, condition=rules.Condition("gt", 5.0))
    states = rules.alert_states(x, rule)
    got = [(r.ts // minute, r.state, r.active_at // minute) for r in states.orderBy("ts").collect()]
    assert got == [(0, "pending", 0), (5, "firing", 0), (10, "firing", 0), (12, "pending", 12), (200, "pending", 200), (204, "pending", 200)]
    assert [r.state for r in rules.current_alerts(states, 205 * minute).collect()] == ["pending"]
    assert rules.current_alerts(states, 500 * minute).count() == 0


def test_query_log(spark):
    assert rules.normalise('sum( x{b="2", a="1"}[5m] )  BY (c)') == 'sum( x{a="1",b="2"}[DURATION] ) by (c)'
    texts = ['sum( x{b="2", a="1"}[5m] )  BY (c)', "x > inf", " true  AND\n nan", "x[1h] OFFSET 5m", 'a{x="1"} + b{z="2",y="3"}', "", "info"]
    rows = spark.createDataFrame([(t,) for t in texts], "q string").select("q", rules.normalised("q").alias("n")).collect()
    assert [r.n for r in rows] == [rules.normalise(r.q) for r in rows]
    found = rules.pattern_of('sum(rate(http_requests_total{job="api"}[5m])) by (status)')
    assert (found.aggregates, found.rates, found.sums, found.metrics, found.conditions) == (True, True, True, ("http_requests_total",), (("job", "=", "api"),))
    assert rules.pattern_of("up").metrics == ("up",) and not rules.pattern_of("up").aggregates
    log = spark.createDataFrame([("x[5m]", 10), ("x[1h]", 20), ("y", 20), ("x[5m]", -99_999_999)], "query string, ts long")
    got = {r.query: (r.n, r.frequent) for r in rules.frequencies(log, 100, threshold=2).collect()}
    assert got == {"x[DURATION]": (2, True), "y": (1, False)}
    registry = spark.createDataFrame([("z", True)], "query string, auto boolean")
    assert [r.query for r in rules.new_rules(rules.frequencies(log, 100, threshold=2), registry).collect()] == ["x[DURATION]"]
    assert [r.query for r in rules.stale_rules(registry, rules.frequencies(log, 100), 10**12).collect()] == ["z"]
    entries = [{"query": "x[5m]", "auto": True, "frequency": 0}, {"query": "x[1h]", "auto": False, "frequency": 100, "last_ts": 0}]
    assert rules.route("x[9m]", entries, 1000)["frequency"] == 100 and rules.route("y", entries, 0) is None
    assert rules.route("x[9m]", entries[:1], 10**12) is None


def test_analytics(vector):
    r = analytics.basic_stats(line(vector, 10, 20, 30, 40, 50)).first()
    assert (r["mean"], r["median"], r["p25"]) == (30, 30, 20)
    t = analytics.trend(line(vector, 10, 20, 30, 40, 50)).first()
    assert (round(t.slope, 9), t.direction, round(t.r2, 9)) == (10, "up", 1)
    assert analytics.trend(line(vector, 5, 5, 5)).first().r2 == 1
    periodic = line(vector, *(50 + i % 12 for i in range(20)), step=300_000)
    p = analytics.periodicity(periodic).first()
    assert (p.period, p.confidence, p.periodic) == (300_000, 1, True)
    assert analytics.periodicity(line(vector, 1, 2, 3)).count() == 0 and analytics.summary(line(vector, 1, 2)).count() == 0
    assert analytics.summary(periodic).first()["count"] == 20
    f = analytics.features(line(vector, *(math.sin(math.pi * k / 8) for k in range(64)))).first()
    assert f.frequency.dominant == 4 and abs(f.frequency.power - 32.0**2) < 1e-6 and f.time["count"] == 64
    assert analytics.features(line(vector, *range(12))).first().frequency.dominant is None


def test_metadata(vector):
    x = vector(("a_total", {"job": "1"}, 1, 2.5), ("a_total", {"job": "1"}, 2, 3), ("b", {"env": "e"}, 5, 1))
    assert {r.name for r in metadata.label_names(x).collect()} == {"__name__", "job", "env"}
    assert [r.value for r in metadata.label_values(x, "job").collect()] == ["1"]
    assert {r.metric: r.type for r in metadata.metadata(x).collect()} == {"a_total": "counter", "b": "gauge"}
    assert tuple(metadata.stats(x).first()) == (2, 3, 1, 5)
    assert metadata.series(x, (Matcher("job", "=", "1"),), (Matcher("job", "=", "1"),), distinct=False).count() == 2
    assert {r.metric: r.value for r in metadata.instant_result(x).collect()} == {"a_total": "2.5", "b": "1"}
    assert {r.metric: [tuple(s) for s in r.samples] for r in metadata.matrix_result(x).collect()} == {"a_total": [(1, 2.5), (2, 3)], "b": [(5, 1)]}


def test_known_data(vector):
    rows = [("known", {"job": f"j{i % 3}", "instance": f"i{i}"}, 15_000 * j, 50 + 10 * i + 0.1 * j) for i in range(10) for j in range(20)]
    got = {r.ts: round(r.value, 6) for r in evaluate("sum(known)", vector(*rows), 0, 10**6).collect()}
    assert got == {15_000 * j: 950.0 + j for j in range(20)}


def test_engine_keeps_results(counter):
    engine = Engine(counter, entries=1)
    assert engine.query("requests", 0, 5000) is engine.query("requests", 0, 5000)
    first = engine.query("requests", 0, 5000)
    engine.replace(counter)
    assert engine.query("requests", 0, 5000) is not first
    assert engine.query("vector(time())", 0) is not engine.query("vector(time())", 0)


def test_random_rates_against_plain_python(vector):
    random.seed(11)
    rows = sorted((t, random.randrange(100)) for t in random.sample(range(10_000), 60))
    want = [(t, round((v - pv) / (t - pt), 6)) for (pt, pv), (t, v) in zip(rows, rows[1:]) if v >= pv]
    got = sorted((r.ts, round(r.value, 6)) for r in ot.rate(vector(*(("x", {}, t, v) for t, v in rows))).collect())
    assert got == want


def test_empty(vector, counter):
    none = counter.where("false")
    for f in (ot.rate, ot.irate, ot.increase, ot.resets, ot.holt_winters, analytics.basic_stats, analytics.features, metadata.label_names):
        assert f(none).count() == 0
    assert agg.aggregate(none, "sum").count() == 0 and metadata.stats(none).first().samples == 0


def test_slices_change_nothing(vector):
    """Every function of a series' order, by slices of several lengths and whole."""
    random.seed(11)
    rows = [("x", {"i": str(k % 3)}, int(random.uniform(0, 50_000)), random.choice((1, 2.5, -3, 7, 7))) for k in range(150)] + [("x", {"i": "one"}, 5, 4), ("x", {"i": "two"}, 5, 4), ("x", {"i": "two"}, 49_000, 6)]
    x = vector(*rows)

    def values(df):
        return sorted((r.series_id, r.ts, r.seq, round(r.value, 6)) for r in df.collect())

    undone = lambda df, s: ot.undo_linear_residuals(ot.linear_residuals(df, s), s)
    functions = [lambda df, s: ot.rate(df, slice_ms=s), lambda df, s: ot.resets(df, slice_ms=s), lambda df, s: ot.changes(df, slice_ms=s), ot.linear_residuals, undone]
    functions += [lambda df, s, op=op: agg.running(df, op, s) for op in agg.RUNNING]
    functions += [lambda df, s, f=f: f(df, 1 / 3, 1 / 7, s) for f in (ot.holt_winters, ot.smoothing_residuals, ot.smoothing_forecast)]
    for f in functions:
        want = values(f(x, None))
        for slice_ms in (700, 20_000):
            assert values(f(x, slice_ms)) == want
    assert values(undone(x, 700)) == values(x)


def test_quantiles_of_any_values(spark):
    """Against Spark's exact percentile, and places against sorted lists."""
    from seriesmill.operators.quantiles import at_places, quantiles

    random.seed(12)
    pools = {
        "normal": [random.gauss(0, 1) for _ in range(500)], "equal": [7.0] * 200, "few": [random.choice((1.0, -1.0, 0.0, 2.5)) for _ in range(300)], "one": [3.0], "two": [5.0, -5.0],
        "close": [1 + k * 1e-12 for k in range(300)], "wide": [random.choice((-1, 1)) * 10 ** random.uniform(-300, 300) for _ in range(400)], "ends": [math.inf, -math.inf, 0.0, 1.0, 1.0, math.nan],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in pools.items() for v in vs] + [("one", None)], "k string, value double")
    places = {"first": lambda n: n * 0, "middle": lambda n: F.floor(n / 2), "last": lambda n: n - 1}
    for r in at_places(rows, ["k"], places).collect():
        vs = sorted(pools[r.k], key=lambda v: (math.isnan(v), v))
        got, want = (r["first"], r.middle, r["last"]), (vs[0], vs[len(vs) // 2], vs[-1])
        assert r.n == len(vs) and all(a == b or a != a and b != b for a, b in zip(got, want)), r
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.987, "e": 1.0}
    want = {r.k: r.p for r in rows.where("k <> 'ends'").groupBy("k").agg(F.percentile("value", F.array(*map(F.lit, shares.values()))).alias("p")).collect()}
    for r in quantiles(rows.where("k <> 'ends'"), ["k"], shares).collect():
        assert all(math.isclose(r[name], x, rel_tol=1e-9, abs_tol=1e-300) for name, x in zip(shares, want[r.k])), (r, want[r.k])
    assert quantiles(rows.where("false"), ["k"], shares).count() == 0
