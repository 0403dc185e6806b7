"""Functions over the ordered samples of each series.  Times are milliseconds, so rates are per millisecond.

Where neighbours are needed, ``previous`` provides them: by a plain window, or for series too long for one task
cut into slices of time, whose ends are joined through a table of one row per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import COLUMNS, order
from .quantiles import quantiles

PER_SECOND = 1000.0
NAN = float("nan")


def _by_time() -> Window:
    return Window.partitionBy("series_id").orderBy("ts", "seq")


def previous(samples: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Adds ``prev``: (ts, value) of the sample before, null for the first of a series."""
    if slice_ms is None:
        return samples.withColumn("prev", F.lag(F.struct("ts", "value")).over(_by_time()))
    cut = samples.withColumn("__slice", F.floor(F.col("ts") / slice_ms))
    inside = Window.partitionBy("series_id", "__slice").orderBy("ts", "seq")
    ends = cut.groupBy("series_id", "__slice").agg(F.max_by(F.struct("ts", "value"), order()).alias("__end"))
    before = ends.withColumn("__before", F.lag("__end").over(Window.partitionBy("series_id").orderBy("__slice"))).drop("__end")
    own = cut.withColumn("prev", F.lag(F.struct("ts", "value")).over(inside))
    return own.join(before, ["series_id", "__slice"], "left").withColumn("prev", F.coalesce("prev", "__before")).drop("__slice", "__before")


def before(samples: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Adds ``one`` and ``two``: the values of the last sample but none and but one, null where there are none."""
    if slice_ms is None:
        return samples.withColumn("one", F.lag("value", 1).over(_by_time())).withColumn("two", F.lag("value", 2).over(_by_time()))
    cut = samples.withColumn("__slice", F.floor(F.col("ts") / slice_ms))
    inside = Window.partitionBy("series_id", "__slice").orderBy("ts", "seq")
    latest = Window.partitionBy("series_id", "__slice").orderBy(F.desc("ts"), F.desc("seq"))
    # the last two values of each slice, the earlier first; a slice of one has the other in the slice before
    last = cut.withColumn("__back", F.row_number().over(latest)).where("__back <= 2").groupBy("series_id", "__slice")
    last = last.agg(F.max(F.when(F.col("__back") == 2, F.col("value"))).alias("a"), F.max(F.when(F.col("__back") == 1, F.col("value"))).alias("b"), F.count(F.lit(1)).alias("n"))
    slices = Window.partitionBy("series_id").orderBy("__slice")
    two_before = F.when(F.lag("n").over(slices) == 2, F.lag("a").over(slices)).otherwise(F.lag("b", 2).over(slices))
    last = last.select("series_id", "__slice", F.lag("b").over(slices).alias("__b"), two_before.alias("__a"))
    rows = cut.withColumn("__k", F.row_number().over(inside)).withColumn("one", F.lag("value", 1).over(inside)).withColumn("two", F.lag("value", 2).over(inside))
    rows = rows.join(last, ["series_id", "__slice"], "left")
    two = F.when(F.col("__k") == 1, F.col("__a")).when(F.col("__k") == 2, F.col("__b")).otherwise(F.col("two"))
    return rows.withColumn("two", two).withColumn("one", F.when(F.col("__k") == 1, F.col("__b")).otherwise(F.col("one"))).drop("__slice", "__k", "__a", "__b")


def running_sum(samples: DataFrame, column: str, slice_ms: int | None = None) -> DataFrame:
    """``column`` replaced by its sum up to each sample; by slices, what stood before a slice comes from one row for each."""
    if slice_ms is None:
        return samples.withColumn(column, F.sum(column).over(_by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = samples.withColumn("__slice", F.floor(F.col("ts") / slice_ms))
    slices = Window.partitionBy("series_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("series_id", "__slice").agg(F.sum(column).alias("__sum")).select("series_id", "__slice", F.coalesce(F.sum("__sum").over(slices), F.lit(0.0)).alias("__sum"))
    inside = Window.partitionBy("series_id", "__slice").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn(column, F.sum(column).over(inside)).join(totals, ["series_id", "__slice"]).withColumn(column, F.col(column) + F.col("__sum")).drop("__slice", "__sum")


def _per_series(samples: DataFrame, ts: Column, value: Column, *more: Column, keep: Column | None = None) -> DataFrame:
    """One sample for each series; ``keep`` drops series."""
    # metric and labels are keys, as fixed-size aggregates beside them can then be hashed
    out = samples.groupBy("series_id", "metric", "labels").agg(ts.alias("ts"), value.alias("value"), *more)
    out = out if keep is None else out.where(keep)
    return out.select("series_id", "metric", "labels", F.col("ts").cast("long").alias("ts"), F.col("value").cast("double").alias("value"), F.lit(0).cast("long").alias("seq"))


def rate(samples: DataFrame, per_second: bool = False, skip_resets: bool = True, slice_ms: int | None = None) -> DataFrame:
    """The slope between each sample and the one before, at the later time; falls of the value are skipped."""
    dt, dv = F.col("ts") - F.col("prev.ts"), F.col("value") - F.col("prev.value")
    rows = previous(samples, slice_ms).where((dt > 0) & (dv >= 0) if skip_resets else dt > 0)
    return rows.withColumn("value", dv / dt * (PER_SECOND if per_second else 1.0)).select(COLUMNS)


def _last_two(samples: DataFrame) -> DataFrame:
    """Per series its last sample with the one before as ``prev``: one shuffle, to which each task sends two rows a series."""
    latest = Window.partitionBy("series_id").orderBy(F.desc("ts"), F.desc("seq"))
    two = samples.withColumn("__back", F.row_number().over(latest)).where("__back <= 2")
    ends = two.withColumn("prev", F.lead(F.struct("ts", "value")).over(latest)).where("__back = 1 AND prev IS NOT NULL")
    return ends.drop("__back").withColumn("seq", F.lit(0).cast("long"))


def irate(samples: DataFrame, per_second: bool = False) -> DataFrame:
    """The slope of the last two samples of each series."""
    dt = F.col("ts") - F.col("prev.ts")
    return _last_two(samples).where(dt > 0).withColumn("value", (F.col("value") - F.col("prev.value")) / dt * (PER_SECOND if per_second else 1.0)).select(COLUMNS)


def idelta(samples: DataFrame) -> DataFrame:
    """The difference of the last two samples."""
    return _last_two(samples).withColumn("value", F.col("value") - F.col("prev.value")).select(COLUMNS)


def _last_less_first() -> Column:
    return F.max_by("value", order()) - F.min_by("value", order())


def increase(samples: DataFrame) -> DataFrame:
    """Last minus first, for series that last at all."""
    return _per_series(samples, F.max("ts"), _last_less_first(), (F.max("ts") - F.min("ts")).alias("span"), F.count(F.lit(1)).alias("n"), keep=F.expr("span > 0 and n > 1"))


def delta(samples: DataFrame) -> DataFrame:
    """Last minus first, for series of two samples or more."""
    return _per_series(samples, F.max("ts"), _last_less_first(), F.count(F.lit(1)).alias("n"), keep=F.col("n") > 1)


def _count_steps(samples: DataFrame, step: Column, end: int | None, slice_ms: int | None) -> DataFrame:
    ts = F.max("ts") if end is None else F.lit(end)
    return _per_series(previous(samples, slice_ms), ts, F.coalesce(F.sum(F.when(F.col("prev").isNotNull() & step, 1.0)), F.lit(0.0)))


def resets(samples: DataFrame, end: int | None = None, slice_ms: int | None = None) -> DataFrame:
    """How often the value fell, at ``end`` (or the last sample)."""
    return _count_steps(samples, F.col("value") < F.col("prev.value"), end, slice_ms)


def changes(samples: DataFrame, end: int | None = None, slice_ms: int | None = None) -> DataFrame:
    """How often the value changed; NaN after NaN is a change."""
    return _count_steps(samples, F.isnan("value") | (F.col("value") != F.col("prev.value")), end, slice_ms)


def _line(samples: DataFrame, origin: int) -> DataFrame:
    """Samples with x, the time since ``origin``, such as a query's start: smaller numbers lose less in sums."""
    return samples.withColumn("x", (F.col("ts") - F.lit(origin)).cast("double"))


def _span() -> Column:
    return (F.max("x") - F.min("x")).alias("span")


def deriv(samples: DataFrame, origin: int = 0) -> DataFrame:
    """Slope of the least-squares line, at the last sample; series at a single time are dropped."""
    return _per_series(_line(samples, origin), F.max("ts"), F.regr_slope("value", "x"), _span(), keep=F.col("span") > 0)


def predict_linear(samples: DataFrame, seconds: float = 60.0, end: int | None = None, origin: int = 0) -> DataFrame:
    """Value of the least-squares line ``seconds`` after the last sample, stamped ``end`` (or the last sample)."""
    # from the means, through which the line goes: the value at x = 0 may be far off
    ahead = F.avg("value") + F.regr_slope("value", "x") * (F.max("x") + F.lit(seconds * 1000.0) - F.avg("x"))
    return _per_series(_line(samples, origin), F.max("ts") if end is None else F.lit(end), ahead, _span(), keep=F.col("span") > 0)


def _smoothed(samples: DataFrame, smoothing: float, trend: float, skip: int, slice_ms: int | None) -> DataFrame:
    """Samples with ``level`` and ``slope``: the state of double exponential smoothing before each of them.

    The state begins with the first value and the step to the second; the first ``skip`` values don't change it.
    A value changes it by a fixed matrix and a multiple of itself, so what a slice of time does to any state is
    that matrix to the power of its length, and what it does to the state 0.  Slices are worked out side by side, the
    states at their beginnings follow from one row for each, and every slice is gone through again from there.
    ``level`` is null at the first sample.
    """
    matrix = np.array([[1 - smoothing, 1 - smoothing], [-trend * smoothing, 1 - trend * smoothing]])
    (a, b), (c, d) = matrix.tolist()
    e, f = smoothing, trend * smoothing
    cut = samples.withColumn("slice", F.floor(F.col("ts") / slice_ms) if slice_ms else F.lit(0).cast("long"))
    early = Window.partitionBy("series_id").orderBy("ts", "seq")
    starts = samples.withColumn("k", F.row_number().over(early)).where("k <= 2").groupBy("series_id").agg(
        F.max(F.when(F.col("k") == 1, F.col("value"))).alias("v1"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("v2"), F.max(F.when(F.col("k") == 1, F.struct("ts", "seq"))).alias("o1"), F.max(F.when(F.col("k") == 2, F.struct("ts", "seq"))).alias("o2")
    )
    # the samples that change the state
    late = F.struct("ts", "seq") > F.col("o1" if skip == 1 else "o2")
    rows = cut.join(starts, "series_id").select("series_id", "slice", "ts", "seq", "value", F.coalesce(late, F.lit(False)).alias("counts"), "v1", (F.col("v2") - F.col("v1")).alias("v12"), "metric", "labels")
    rows = rows.repartition("series_id", "slice").sortWithinPartitions("series_id", "slice", "ts", "seq")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, x, y = None, 0, 0.0, 0.0
        for batch in batches:
            out = []
            for series, at, value, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (series, at) != key:
                    if key:
                        out.append((*key, n, x, y))
                    key, n, x, y = (series, at), 0, 0.0, 0.0
                if counts:
                    n, x, y = n + 1, a * x + b * y + e * value, c * x + d * y + f * value
            yield _batch(out, ("series_id", "slice", "n", "x", "y"), (pa.int64(),) * 3 + (pa.float64(),) * 2)
        if key:
            yield _batch([(*key, n, x, y)], ("series_id", "slice", "n", "x", "y"), (pa.int64(),) * 3 + (pa.float64(),) * 2)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, np.zeros(2)
        for batch in batches:
            out = []
            for series, at, n, x, y, v1, v12 in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if series != now:
                    now, state = series, np.array([v1, np.nan if v12 is None else v12])
                out.append((series, at, *state.tolist()))
                state = np.linalg.matrix_power(matrix, n) @ state + (x, y)
            yield _batch(out, ("series_id", "slice", "x", "y"), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))

    if slice_ms:
        done = rows.select("series_id", "slice", "value", "counts").mapInArrow(effects, "series_id long, slice long, n long, x double, y double")
        done = done.join(starts.select("series_id", "v1", (F.col("v2") - F.col("v1")).alias("v12")), "series_id").repartition("series_id").sortWithinPartitions("series_id", "slice")
        begins = done.mapInArrow(begun, "series_id long, slice long, x double, y double")
        rows = rows.join(begins, ["series_id", "slice"]).repartition("series_id", "slice").sortWithinPartitions("series_id", "slice", "ts", "seq")
    else:
        rows = rows.withColumnsRenamed({"v1": "x", "v12": "y"})

    def gone_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, level, slope = None, 0.0, 0.0
        for batch in batches:
            levels, slopes = [], []
            for series, at, value, counts, x, y in zip(*(batch.column(name).to_pylist() for name in ("series_id", "slice", "value", "counts", "x", "y")), strict=True):
                if (series, at) != key:
                    key, level, slope = (series, at), x, y
                levels.append(level)
                slopes.append(slope)
                if counts:
                    new = smoothing * value + (1 - smoothing) * (level + slope)
                    level, slope = new, trend * (new - level) + (1 - trend) * slope
            columns = {name: batch.column(name) for name in ("series_id", "metric", "labels", "ts", "value", "seq", "counts")} | {"level": pa.array(levels, pa.float64()), "slope": pa.array(slopes, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(gone_through, "series_id long, metric string, labels map<string,string>, ts long, value double, seq long, counts boolean, level double, slope double")


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))


def holt_winters(samples: DataFrame, smoothing: float = 0.3, trend: float = 0.1, slice_ms: int | None = None) -> DataFrame:
    """Double exponential smoothing; each sample from the second on becomes level plus trend after it."""
    rows = _smoothed(samples, smoothing, trend, 1, slice_ms).where("counts")
    level = smoothing * F.col("value") + (1 - smoothing) * (F.col("level") + F.col("slope"))
    slope = trend * (level - F.col("level")) + (1 - trend) * F.col("slope")
    return rows.withColumn("value", level + slope).select(COLUMNS)


def smoothing_residuals(samples: DataFrame, smoothing: float = 0.3, trend: float = 0.1, slice_ms: int | None = None) -> DataFrame:
    """Each value from the third on minus its double exponential forecast; the first two stay as they are.

    The first forecast is the line through the first two values; level and trend follow from there.
    """
    rows = _smoothed(samples, smoothing, trend, 2, slice_ms)
    return rows.withColumn("value", F.when(F.col("counts"), F.col("value") - (F.col("level") + F.col("slope"))).otherwise(F.col("value"))).select(COLUMNS)


def smoothing_forecast(samples: DataFrame, smoothing: float = 0.3, trend: float = 0.1, slice_ms: int | None = None) -> DataFrame:
    """The next value of each series by double exponential smoothing, at its last sample; a single value forecasts itself."""
    from .rollup import _last_value

    seen = _per_series(samples, F.max("ts"), _last_value(), F.count(F.lit(1)).alias("n"), keep=F.col("n") == 1)
    ahead = holt_winters(samples, smoothing, trend, slice_ms)
    return seen.unionByName(_per_series(ahead, F.max("ts"), _last_value()))


def linear_residuals(samples: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Each value minus the line through the two before it; the first two stay as they are."""
    rows = before(samples, slice_ms)
    return rows.withColumn("value", F.coalesce(F.col("value") - (F.col("one") * 2 - F.col("two")), F.col("value"))).select(COLUMNS)


def undo_linear_residuals(residuals: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """The values whose linear_residuals these are: residuals are second differences, so values are sums of sums."""
    # differences of values: the second residual less the first, then running sums of the others; the first value is its own
    rows = before(residuals, slice_ms)
    first, second = F.col("one").isNull(), F.col("one").isNotNull() & F.col("two").isNull()
    rows = rows.withColumn("__first", F.when(first, F.col("value")).otherwise(0.0)).withColumn("__step", F.when(first, 0.0).when(second, F.col("value") - F.col("one")).otherwise(F.col("value")))
    rows = running_sum(rows, "__step", slice_ms)
    return running_sum(rows.withColumn("value", F.col("__first") + F.col("__step")), "value", slice_ms).select(COLUMNS)


def absent_over_time(all_series: DataFrame, samples: DataFrame, end: int) -> DataFrame:
    """1 for every series of ``all_series`` without a sample in ``samples``."""
    known = all_series.dropDuplicates(["series_id"]).select("series_id", "metric", "labels")
    missing = known.join(samples.select("series_id").distinct(), "series_id", "left_anti")
    return missing.select("series_id", "metric", "labels", F.lit(end).cast("long").alias("ts"), F.lit(1.0).alias("value"), F.lit(0).cast("long").alias("seq"))


def absent_within(samples: DataFrame, after: int, until: int, at: int) -> DataFrame:
    """1, stamped ``at``, for every series without a sample in (after, until]: one aggregation, no join."""
    inside = F.count(F.when((F.col("ts") > after) & (F.col("ts") <= until), 1))
    return _per_series(samples, F.lit(at), F.lit(1.0), inside.alias("inside"), keep=F.col("inside") == 0)


def present_over_time(samples: DataFrame, end: int | None = None, as_one: bool = False) -> DataFrame:
    """The number of samples of each series, or 1."""
    value = F.lit(1.0) if as_one else F.count(F.lit(1)).cast("double")
    return _per_series(samples, F.max("ts") if end is None else F.lit(end), F.max(F.lit(1.0)) if as_one else value)


OVER_TIME = {
    "avg": lambda q: F.avg("value"),
    "min": lambda q: F.min(F.when(~F.isnan("value"), F.col("value"))),
    "max": lambda q: F.max(F.when(~F.isnan("value"), F.col("value"))),
    "sum": lambda q: F.sum("value"),
    "count": lambda q: F.count(F.lit(1)).cast("double"),
    "stddev": lambda q: F.stddev_pop("value"),
    "stdvar": lambda q: F.var_pop("value"),
    "last": lambda q: F.max_by("value", order()),
    "quantile": lambda q: F.percentile("value", q),
}


def over_time(samples: DataFrame, op: str, end: int | None = None, q: float = 0.5) -> DataFrame:
    """avg, min, max, sum, count, stddev, stdvar, last or quantile of each series' samples."""
    if op == "quantile":
        ends = _per_series(samples, F.max("ts") if end is None else F.lit(end), F.lit(0.0)).drop("value")
        return ends.join(quantiles(samples, ["series_id"], {"value": q}), "series_id").select(COLUMNS)
    return _per_series(samples, F.max("ts") if end is None else F.lit(end), OVER_TIME[op](q))


def sliding(samples: DataFrame, op: str, range_ms: int) -> DataFrame:
    """avg, min, max, sum or count over (ts - range, ts], at every sample."""
    window = Window.partitionBy("series_id").orderBy("ts").rangeBetween(-(range_ms - 1), Window.currentRow)
    what = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[op]
    return samples.withColumn("value", what("value").over(window).cast("double"))


def on_grid(samples: DataFrame, op: str, start: int, end: int, step: int, range_ms: int, q: float = 0.5) -> DataFrame:
    """over_time at start, start + step, ... end, each over (t - range, t].

    Every sample is sent to the points whose window holds it: no join, and range / step rows for each sample.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    first = F.greatest(F.lit(0), F.ceil((F.col("ts") - start) / step))
    last = F.least(F.lit((end - start) // step), F.ceil((F.col("ts") + range_ms - start) / step) - 1)
    inside = samples.where((F.col("ts") > start - range_ms) & (F.col("ts") <= end)).withColumn("__first", first.cast("long")).withColumn("__last", last.cast("long"))
    points = inside.where("__first <= __last").withColumn("__k", F.explode(F.sequence("__first", "__last"))).withColumn("__t", F.col("__k") * step + start)
    out = points.groupBy("series_id", "metric", "labels", "__t").agg(OVER_TIME[op](q).alias("value"))
    return out.select("series_id", "metric", "labels", F.col("__t").cast("long").alias("ts"), F.col("value").cast("double").alias("value"), F.lit(0).cast("long").alias("seq"))
