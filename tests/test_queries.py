"""Registered queries against their SQL, on the smallest tables there are."""

import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from seriesmill import queries

DATA = Path(os.environ.get("SERIES_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't there")


def test_every_query_has_a_name_and_sql():
    assert set(queries.ORACLES) == set(queries.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("events", "lineitem", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def plain(value):
    return None if value != value else float(f"{value:.9g}") if isinstance(value, float) else value


SOME = [
    "flagship_daily_sum", "f4_match_regex", "f6_matchers", "f10_subquery_of_rates", "f15_range_query", "j2_positional", "j4_group_left", "j4_group_right", "j5_scalar_nested", "j10_scalar_filter", "g8_topk", "g10_quantile", "r1_rate_sliced",
    "r2_irate", "r9_predict_linear", "r10_holt_winters", "r11_absent_over_time", "r15_smoothing_residuals", "r15_forecast", "m1_abs", "label_join", "date_hour", "custom_function", "m13_histogram_quantile", "m14_sort", "u2_or", "u3_unless", "u6_merge",
    "d2_rollup_nan", "d6_level_by_policy", "d8_rollup_of_rollup", "t3_alert_states", "t6_query_shapes", "y3_periodicity", "y4_summary", "y6_frequency_features", "y8_features", "l9_matrix_result", "i5_json_puts", "s6_block_read_by_labels",
    "s9_stored_rollup", "k8_compact", "i1_remote_write", "s13_remote_read_client", "t7_new_rules", "stream_rollup", "stream_alerts",
]


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in answer.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_rollup_of_infinite_values_against_sql(spark, tmp_path, monkeypatch):
    """An hour without numbers doesn't hide that its day has nothing else than -inf."""
    duck = pytest.importorskip("duckdb").connect()
    values = "CASE event_id % 4 WHEN 0 THEN '-inf'::DOUBLE WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN NULL ELSE value END"
    duck.execute(f"COPY (SELECT * REPLACE (user_id % 3 AS user_id, {values} AS value) FROM '{DATA}/events.parquet' WHERE event_id % 3 = 0) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    monkeypatch.setitem(globals(), "DATA", tmp_path)
    test_against_sql(spark, duck, "d2_rollup_nan")


def test_every_residual_is_returned(spark, duck):
    rows = queries.QUERIES["r15_smoothing_residuals"](spark, str(DATA)).count()
    assert rows == duck.execute("SELECT count(*) FROM events").fetchone()[0] == len(duck.execute(queries.ORACLES["r15_smoothing_residuals"]).fetchall())


def test_every_series_has_its_place(spark, monkeypatch):
    called = []
    sort = queries.fn.sort
    monkeypatch.setattr(queries.fn, "sort", lambda *a, **b: called.append(1) or sort(*a, **b))
    places = sorted(r.place for r in queries.QUERIES["m14_sort_desc"](spark, str(DATA)).collect())
    assert called and len(places) > 20 and places == list(range(1, len(places) + 1))


def test_functions_of_samples_read_all_times():
    """Only queries whose feature is a range, an instant or an age may have a condition on time."""
    ranges = r"s2|s3|s8|s10|s12|s13|f7|f8|f9|f10|f15|r11|r12|r14|g8|g9|g11|s1_|s9|m11|d7|t\d|k9|j5_scalar|j10_scalar"
    for name, sql in queries.ORACLES.items():
        if re.search(r"\bts (BETWEEN|>|>=|<|<=) ?\d", sql):
            assert re.match(ranges, name), name


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
