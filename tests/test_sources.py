import math
import time

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import rules
from seriesmill.operators.select import Matcher
from seriesmill.sources import documents, remote, store, text
from seriesmill.streaming import rollups


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_exposition(spark):
    good, bad = text.parse_exposition(
        lines(spark, "# HELP x y", "", 'a{l="v 1",m="x,y}"} 1.5 1000', "b 2", "c{} NaN 5", 'd{q="a\\"b\\\\n\\n"} +Inf 7', '{__name__="e"} -3e2 -9', "f{x=unquoted} 1", "g", "h{a=\"1\"} x", "i 1 2 3"), 42
    )
    got = {r.metric: (r.labels, r.ts, r.value) for r in good.collect()}
    assert math.isnan(got.pop("c")[2])
    assert got == {"a": ({"l": "v 1", "m": "x,y}"}, 1000, 1.5), "b": ({}, 42, 2), "d": ({"q": 'a"b\\n\n'}, 7, math.inf), "e": ({}, -9, -300)}
    assert sorted(r.line for r in bad.collect()) == ["f{x=unquoted} 1", "g", 'h{a="1"} x', "i 1 2 3"]
    again = text.parse_exposition(text.write_exposition(good), 0)[0]
    assert sorted((r.metric, str(sorted(r.labels.items())), r.ts, str(r.value)) for r in again.collect()) == sorted((r.metric, str(sorted(r.labels.items())), r.ts, str(r.value)) for r in good.collect())


def test_other_lines(spark):
    good, bad = text.parse_graphite(lines(spark, "a.b.c 1.5 1700000000", "x;dc=1 2 5", "junk", "a b c"))
    assert sorted((r.metric, r.labels, r.ts, r.value) for r in good.collect()) == [("a_b_c", {}, 1_700_000_000_000, 1.5), ("x", {"dc": "1"}, 5000, 2)]
    assert bad.count() == 2
    good, bad = text.parse_line_protocol(lines(spark, "cpu,host=a\\ b usage=1.5,n=3i 2000000", "# no", "mem free=x", "z v=1"), now=9)
    assert sorted((r.metric, r.labels, r.ts, r.value) for r in good.collect()) == [("cpu_n", {"host": "a b"}, 2, 3), ("cpu_usage", {"host": "a b"}, 2, 1.5), ("z_v", {}, 9, 1)]
    assert bad.count() == 1


def test_puts(spark):
    good, bad = documents.parse_puts(lines(
        spark, '{"metric":"a","timestamp":1700000000,"value":1,"tags":{"h":"1"}}', '[{"metric":"b","timestamp":1700000000123,"value":"2.5","tags":{"h":"1"}},{"metric":"","timestamp":1,"value":1,"tags":{"h":"1"}}]',
        '{"metric":"c","timestamp":1,"value":"x","tags":{"h":"1"}}', '{"metric":"d","timestamp":1,"value":1,"tags":{}}', "not json",
    ))
    assert sorted((r.metric, r.ts, r.value) for r in good.collect()) == [("a", 1_700_000_000_000, 1), ("b", 1_700_000_000_123, 2.5)]
    assert sorted(r.error for r in bad.collect()) == ["bad value", "no metric", "no metric", "no tags"]
    assert tuple(documents.put_summary(good, bad).first()) == (2, 4)


def test_batches(spark):
    body = '{"timeseries":[{"labels":[{"name":"__name__","value":"m"},{"name":"a","value":"1"}],"samples":[{"timestamp":1,"value":2},{"timestamp":2,"value":"x"}]}]}'
    good, bad = documents.parse_batches(lines(spark, body))
    assert [(r.metric, r.labels, r.ts, r.value) for r in good.collect()] == [("m", {"a": "1"}, 1, 2)] and bad.count() == 1


@pytest.mark.parametrize("format_", ["json", "csv", "parquet", "orc"])
def test_export_and_import(spark, vector, tmp_path, format_):
    x = vector(("m", {"a": "1", "b": "x y"}, 1, 2.5), ("m", {"a": "2", "b": "z"}, 3, -4), ("other", {"a": "1"}, 1, 1))
    documents.export(x, str(tmp_path / "x"), format_, metric="m")
    got = sorted((r.metric, sorted(r.labels.items()), r.ts, r.value) for r in documents.read_any(spark, str(tmp_path / "x"), format_).collect())
    assert got == [("m", [("a", "1"), ("b", "x y")], 1, 2.5), ("m", [("a", "2"), ("b", "z")], 3, -4)]
    with pytest.raises(ValueError):
        documents.read_any(spark, "x", "avro")


def test_export_tasks(vector, tmp_path):
    x = vector(("m", {}, 1, 1))
    spark = x.sparkSession
    tasks = documents.ExportTasks()
    tasks.create("a", x, str(tmp_path / "a"), "parquet")
    done = tasks.wait("a")
    assert (done.state, done.error) == ("completed", None) and done.completed_at >= done.created_at > 0
    assert not tasks.cancel("a", spark) and not tasks.cancel("none", spark) and tasks.status("none") is None
    slow = spark.range(0, 4, 1, 4).mapInArrow(lambda batches: (time.sleep(60) or b for b in batches), "id long")
    slow = slow.selectExpr("id AS series_id", "'m' AS metric", "cast(map() AS map<string,string>) AS labels", "id AS ts", "1.0D AS value", "id AS seq")
    tasks.create("slow", slow, str(tmp_path / "slow"), "parquet")
    tasks.create("later", x, str(tmp_path / "later"), "csv")
    tasks.create("bad", x.where(F.raise_error(F.lit("no")).isNull()), str(tmp_path / "bad"), "csv")
    assert tasks.status("later").state == "pending" and tasks.cancel("later", spark)
    while tasks.status("slow").state == "pending":
        time.sleep(0.05)
    time.sleep(1)
    began = time.monotonic()
    assert tasks.cancel("slow", spark) and not tasks.cancel("slow", spark)
    assert "no" in tasks.wait("bad").error and time.monotonic() - began < 45
    assert [(t.name, t.state) for t in tasks.list()] == [("a", "completed"), ("slow", "cancelled"), ("later", "cancelled"), ("bad", "failed")]
    with pytest.raises(ValueError):
        tasks.create("a", x, "x", "csv")
    with pytest.raises(ValueError):
        tasks.create("b", x, "x", "avro")


def test_remote(spark, vector):
    series = [({"__name__": "m", "a": "é"}, [(1, 2.5), (-3, math.inf)]), ({"__name__": "n"}, [(5, 1.0)])]
    bodies = spark.createDataFrame([(bytearray(remote.encode_write_request(series)),), (bytearray(b"\x05junk"),), (bytearray(b""),)], "body binary")
    good, bad = remote.parse_writes(bodies)
    assert sorted((r.metric, r.labels, r.ts, r.value) for r in good.collect()) == [("m", {"a": "é"}, -3, math.inf), ("m", {"a": "é"}, 1, 2.5), ("n", {}, 5, 1)]
    assert bad.count() == 2
    x = vector(("m", {"a": "1"}, 1, 1), ("m", {"a": "2"}, 2, 2), ("m", {"a": "3"}, 9, 3))
    block = remote.encode_read_request([(0, 5, [Matcher("__name__", "=", "m"), Matcher("a", "!~", "1")]), (9, 9, [])])
    first, second = remote.answer(x, block)
    assert [r.value for r in first.collect()] == [2] and [r.value for r in second.collect()] == [3]
    labels, points = remote.time_series(dict(remote.fields(bytes(remote.encode_results(second).first().series)))[1])
    assert (labels, points) == ({"__name__": "m", "a": "3"}, [(9, 3.0)])
    assert text.is_text(b"a 1\n") and not text.is_text(bytes(range(128, 200)))


def test_store(spark, vector, tmp_path):
    day = store.DAY
    x = vector(("m", {"a": "1"}, day, 1), ("m", {"a": "1"}, 3 * day + 5, 2), ("m", {"a": "2"}, 3 * day, 3), ("n", {}, day, 4))
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.scan().count() == 0
    s.append(x)
    s.append(x.where("value = 1").withColumn("value", F.lit(7.0)).withColumn("seq", F.lit(99).cast("long")))
    assert sorted(r.value for r in s.scan("m", (Matcher("a", "=", "1"),), 0, 2 * day).collect()) == [1, 7]
    plan = s.scan("m", start=3 * day)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1][:200]
    files = lambda: sorted(p.relative_to(tmp_path / "s" / "samples").as_posix() for p in (tmp_path / "s" / "samples").rglob("*.parquet"))
    before = files()
    assert s.compact(least_files=3) == 0 and files() == before
    # only the day with two files is rewritten
    assert s.compact(least_files=2) == 1
    assert [f for f in files() if "day=1/" not in f or "metric=n" in f] == [f for f in before if "day=1/" not in f or "metric=n" in f] and len(files()) == len(before) - 1
    compacted = s
    assert sorted(r.value for r in compacted.scan().collect()) == [1, 2, 3, 4]
    compacted.expire(3 * day, 1, str(tmp_path / "kept"))
    assert sorted(r.value for r in store.Store(spark, str(tmp_path / "kept")).scan().collect()) == [2, 3]
    before = {tuple(r) for r in compacted.read_rollup("L4", "m").select("bucket", "sum").collect()}
    compacted.write_rollups(4 * day, ("L3", "L4"))
    assert {tuple(r) for r in compacted.read_rollup("L4", "m").select("bucket", "sum").collect()} == before == {(day, 1), (3 * day, 2), (3 * day, 3)}
    tiers = [r.t for r in x.select(store.tier_of(F.col("ts"), 9 * day).alias("t")).collect()]
    assert tiers == ["cold", "warm", "warm", "cold"]
    assert [r.t for r in spark.createDataFrame([(20.0,), (5.0,), (0.5,), (0.0,)], "n double").select(store.tier_by_access(F.col("n")).alias("t")).collect()] == ["hot", "warm", "cold", "archive"]
    assert store.federated({"a": x, "b": x}, ["a"]).select("node_name").distinct().first()[0] == "a"
    with pytest.raises(ValueError):
        store.federated({"a": x}, ["c"])


def test_streams(spark, vector, tmp_path):
    x = vector(*(("m", {"a": "1"}, 1000 * t, t) for t in range(0, 600, 10)))
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    rollups.run_once(rollups.rollup_stream(rollups.read_samples(spark, str(tmp_path / "in")), "L1", "1 minute"), str(tmp_path / "out"), str(tmp_path / "c1"))
    got = {r.bucket: (r["sum"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # windows that end by the last time less a minute are out
    assert got == {k * 60_000: (sum(range(k * 60, k * 60 + 60, 10)), 6) for k in range(8)}
    rule = rules.Rule("a", "m", "alert", 30.0, condition=rules.Condition("gte", 500.0))
    rollups.run_once(rollups.alert_stream(rollups.read_samples(spark, str(tmp_path / "in")), rule), str(tmp_path / "alerts"), str(tmp_path / "c2"))
    stream = sorted((r.ts, r.state, r.active_at) for r in spark.read.parquet(str(tmp_path / "alerts")).collect())
    assert stream == sorted((r.ts, r.state, r.active_at) for r in rules.alert_states(x, rule).collect())
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text('m{a="1"} 5 1000\nbad line here\n')
    rollups.run_once(rollups.read_lines(spark, str(tmp_path / "lines"), 0), str(tmp_path / "parsed"), str(tmp_path / "c3"))
    assert [(r.metric, r.value) for r in spark.read.parquet(str(tmp_path / "parsed")).collect()] == [("m", 5)]
