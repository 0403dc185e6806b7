"""From syntax trees to DataFrames.

An expression over [start, end] is one lazy DataFrame of samples: every node is a transformation of its children's,
and Spark plans the whole.  A range selector reads (start - range, end].  With ``rollup="auto"``, plain selectors
give window means by the length of the query's range; "off" reads samples as they are.  Numbers are folded before
anything is planned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..model import COLUMNS, series_id
from ..operators import aggregate as agg
from ..operators import binary, histogram, over_time
from ..operators import rollup as roll
from ..operators.select import check_range_query, select
from .parser import COMPARISONS, Aggregation, Binary, Call, Expr, Number, Selector, Subquery, Text, Unary, parse


@dataclass(frozen=True)
class Context:
    samples: DataFrame
    start: int
    end: int
    rollup: str = "off"
    per_second: bool = False
    lookback_ms: int = 0
    #: Length of the slices that series too long for one task are cut into; by default a 64th of what a query reads, if that is long.
    slice_ms: int | None = None
    #: The same for smoothing, whose slices give the last digits otherwise: for longer queries only.
    smooth_ms: int | None = None
    default_step_ms: int = 60_000
    #: Samples of all times, from which the series that exist are known; by default ``samples``.
    known: Callable[[], DataFrame] | None = None
    #: First instant, step and number of the instants that are evaluated together.
    grid: tuple[int, int, int] | None = None


@dataclass(frozen=True)
class Scalar:
    """A number that is known when the query runs: a frame of one sample without labels."""

    frame: DataFrame


class QueryError(ValueError):
    """An expression that parses but has no meaning."""


Value = DataFrame | Scalar | float


def bounds(e: Expr, start: int, end: int, lookback_ms: int = 0) -> tuple[int, int] | None:
    """The least time range that holds every sample an expression reads over [start, end]; None if it reads none."""
    if isinstance(e, Selector):
        if e.at is not None:
            start = end = {"start": start, "end": end}.get(e.at, e.at)
        return start - (e.range_ms or lookback_ms) - e.offset_ms, end - e.offset_ms
    if isinstance(e, Subquery):
        last = (end if e.at is None else {"start": start, "end": end}.get(e.at, e.at)) - e.offset_ms
        return bounds(e.expr, last - e.range_ms, last, lookback_ms)
    inner = {Binary: ("left", "right"), Aggregation: ("expr", "param"), Unary: ("expr",)}.get(type(e), ())
    parts = [getattr(e, name) for name in inner] if inner else list(getattr(e, "args", ()))
    found = [b for p in parts if p is not None and (b := bounds(p, start, end, lookback_ms))]
    return (min(a for a, _ in found), max(b for _, b in found)) if found else None


def evaluate(query: str | Expr, samples: DataFrame | Callable[[int, int], DataFrame], start: int, end: int | None = None, **options) -> DataFrame:
    """Samples of a query over [start, end] (or at an instant).

    ``samples`` may be a function of a time range, such as a store's scan: it is asked for what the query reads.
    """
    tree = parse(query) if isinstance(query, str) else query
    known = None
    if callable(samples):
        last = start if end is None else end
        known = partial(samples, None, None)
        samples = samples(*(bounds(tree, start, last, options.get("lookback_ms", 0)) or (start, last)))
    last = start if end is None else end
    reads = bounds(tree, start, last, options.get("lookback_ms", 0)) or (start, last)
    given = options.pop("slice_ms", None)
    options |= {"slice_ms": given or slice_for(*reads), "smooth_ms": given or slice_for(*reads, whole_ms=60 * 86_400_000)}
    c = Context(samples, start, last, known=known, **options)
    return _as_vector(_value(tree, c), c)


def slice_for(start: int, end: int, whole_ms: int = 2 * 86_400_000, slices: int = 64) -> int | None:
    """The length of time that a series' samples are taken together for, in a query that reads [start, end]; None: all of them."""
    return max(3_600_000, (end - start) // slices) if end - start > whole_ms else None


def evaluate_range(query: str | Expr, samples: DataFrame | Callable[[int, int], DataFrame], start: int, end: int, step: int, **options) -> DataFrame:
    """``evaluate`` for a range query, whose bounds and step are checked first."""
    check_range_query(start, end, step)
    return evaluate(query, samples, start, end, **options)


def _as_vector(value: Value, c: Context, at: int | None = None) -> DataFrame:
    """A number as a sample without labels, at the start of the query."""
    if isinstance(value, Scalar):
        return value.frame
    if isinstance(value, float):
        return fn.without_labels(c.samples.sparkSession.range(1).select(F.lit(value).alias("value")), c.start if at is None else at)
    return value


def _value(e: Expr, c: Context) -> Value:
    if isinstance(e, Number):
        return e.value
    if isinstance(e, Selector):
        return _selector(e, c)
    if isinstance(e, Subquery):
        return _subquery(e, c)
    if isinstance(e, Unary):
        inner = _value(e.expr, c)
        if isinstance(inner, float):
            return -inner if e.op == "-" else inner
        if isinstance(inner, Scalar):
            return Scalar(binary.negate(inner.frame)) if e.op == "-" else inner
        return binary.negate(inner) if e.op == "-" else inner
    if isinstance(e, Binary):
        return _binary(e, c)
    if isinstance(e, Aggregation):
        return _aggregation(e, c)
    if isinstance(e, Call):
        return _call(e, c)
    raise QueryError(f"{e} can't stand alone")


def _instant(at: int | str | None, c: Context) -> int | None:
    return c.start if at == "start" else c.end if at == "end" else at


def _selector(e: Selector, c: Context) -> DataFrame:
    if c.grid:
        return _on_grid(e, c)
    at = _instant(e.at, c)
    look = e.range_ms if e.range_ms is not None else c.lookback_ms or None
    out = select(c.samples, e.metric, e.matchers, c.start, c.end, e.offset_ms, at, look)
    if c.rollup == "auto" and e.range_ms is None:
        return roll.downsample(out, roll.level_for(c.start, c.end))
    return out


#: The label that tells instants that are evaluated together; instants that are planned one by one, or share a sample, at most.
STEP, MOST_STEPS = "__step__", 11_000
#: Functions and aggregations that treat each series, or each label set and time, by itself.
_BY_SERIES = frozenset("rate irate increase delta idelta resets changes deriv predict_linear holt_winters double_exponential_smoothing present_over_time quantile_over_time label_replace label_join".split())
_BY_LABELS = frozenset("sum avg min max count stddev stdvar group quantile".split())


def _together(e: Expr) -> bool:
    """Whether an expression can be worked out for many instants at once."""
    if isinstance(e, Selector):
        return e.at is None
    if isinstance(e, Unary):
        return _together(e.expr)
    if isinstance(e, Aggregation):
        return e.op in _BY_LABELS and _together(e.expr) and (e.param is None or isinstance(e.param, Number))
    if isinstance(e, Binary):
        vectors = [x for x in (e.left, e.right) if not isinstance(x, Number)]
        return bool(vectors) and all(map(_together, vectors))
    if isinstance(e, Call):
        name = e.name.lower()
        known = name in _BY_SERIES or name in fn.MATH or name in ("clamp", "clamp_max", "clamp_min") or name.removesuffix("_over_time") in over_time.OVER_TIME
        vectors = [x for x in e.args if not isinstance(x, Number | Text)]
        return known and bool(vectors) and all(map(_together, vectors))
    return False


def _on_grid(e: Selector, c: Context) -> DataFrame:
    """A selector at every instant of the grid: a row for each sample and instant whose window (or time) is the sample's."""
    first, step, n = c.grid
    look = e.range_ms if e.range_ms is not None else c.lookback_ms or None
    if look and look // step > MOST_STEPS:
        raise QueryError(f"each sample is in {look // step} windows of a subquery, more than {MOST_STEPS}")
    rows = select(c.samples, e.metric, e.matchers, first, first + step * (n - 1), e.offset_ms, None, look)
    since = F.col("ts") + F.lit(e.offset_ms - first)
    begin = F.ceil(since / step)
    last = F.floor(since / step) if look is None else F.ceil((since + look) / step) - 1
    begin, last = F.greatest(F.lit(0), begin).cast("long"), F.least(F.lit(n - 1), last).cast("long")
    rows = rows.withColumn("__a", begin).withColumn("__b", last).where("__a <= __b").withColumn("__k", F.explode(F.sequence("__a", "__b")))
    labels = F.map_concat("labels", F.create_map(F.lit(STEP), (F.col("__k") * step + first).cast("string")))
    return rows.withColumn("labels", labels).withColumn("series_id", F.xxhash64("series_id", "__k")).select(COLUMNS)


def _absent_over_time(e: Selector, c: Context) -> DataFrame:
    """1 for each series that the selector's matchers know of and that has no sample in its range."""
    at = _instant(e.at, c)
    start, end = ((c.start, c.end) if at is None else (at, at))
    known = select(c.known() if c.known else c.samples, e.metric, e.matchers)
    return over_time.absent_within(known, start - e.offset_ms - (e.range_ms or 0), end - e.offset_ms, c.end)


def _subquery(e: Subquery, c: Context) -> DataFrame:
    """The expression at end - range, end - range + step, ... end, its samples stamped with those instants.

    All instants are evaluated by one plan: each sample is sent to the instants whose window holds it, which are a
    label of their own while the expression is worked out.  Only expressions with a part that depends on the instant
    in another way (time(), absent(), topk ...) are planned for each step and put together.
    """
    step = e.step_ms or c.default_step_ms
    end = (c.end if e.at is None else _instant(e.at, c)) - e.offset_ms
    first = end - e.range_ms
    steps = (end - first) // step + 1
    if _together(e.expr):
        rows = _value(e.expr, replace(c, start=first, end=end, grid=(first, step, steps)))
        moved = rows.withColumn("ts", F.col("labels")[STEP].cast("long")).withColumn("labels", F.map_filter("labels", lambda k, _: k != STEP))
        return moved.withColumn("series_id", series_id())
    if c.grid:
        raise QueryError("such a subquery can't stand within another")
    if steps > MOST_STEPS:
        raise QueryError(f"a subquery has {steps} steps, more than {MOST_STEPS}")
    parts = []
    for t in range(first, end + 1, step):
        inner = _as_vector(_value(e.expr, replace(c, start=t, end=t)), c, t)
        parts.append(inner.withColumn("ts", F.lit(t).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FOLD = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b if b else math.nan, "%": lambda a, b: math.fmod(a, b) if b else math.nan, "^": lambda a, b: a**b,
    "==": lambda a, b: float(a == b), "!=": lambda a, b: float(a != b), "<": lambda a, b: float(a < b), "<=": lambda a, b: float(a <= b), ">": lambda a, b: float(a > b), ">=": lambda a, b: float(a >= b),
}


def _binary(e: Binary, c: Context) -> Value:
    left, right = _value(e.left, c), _value(e.right, c)
    if isinstance(left, float) and isinstance(right, float):
        if e.op not in _FOLD:
            raise QueryError(f"{e.op} needs vectors")
        return _FOLD[e.op](left, right)
    m = e.matching
    if e.op in ("and", "or", "unless"):
        if not isinstance(left, DataFrame) or not isinstance(right, DataFrame):
            raise QueryError(f"{e.op} needs vectors")
        key = binary.match_key(None if m.on is None else [*m.on, *([STEP] if c.grid else [])], list(m.ignoring) if m.ignoring is not None else None)
        return {"and": binary.and_, "or": binary.or_, "unless": binary.unless}[e.op](left, right, True, key)
    if isinstance(left, Scalar) and not isinstance(right, DataFrame):
        # numbers compare to 1 and 0
        return Scalar(binary.vector_scalar(left.frame, e.op, right) if isinstance(right, float) else binary.vector_scalar_frame(left.frame, e.op, right.frame))
    if isinstance(right, Scalar):
        if isinstance(left, float):
            return Scalar(binary.vector_scalar(right.frame, e.op, left, swapped=True))
        return binary.vector_scalar_frame(left, e.op, right.frame, e.as_bool)
    if isinstance(left, Scalar):
        return binary.vector_scalar_frame(right, e.op, left.frame, e.as_bool, swapped=True)
    if isinstance(right, float):
        return binary.vector_scalar(left, e.op, right, e.as_bool)
    if isinstance(left, float):
        return binary.vector_scalar(right, e.op, left, e.as_bool, swapped=True)
    on = None if m.on is None else [*m.on, *([STEP] if c.grid else [])]
    return binary.vector_vector(left, right, e.op, on, list(m.ignoring) if m.ignoring is not None else None, m.group, m.include, e.as_bool)


def _number(e: Expr | None, c: Context, what: str) -> float:
    value = _value(e, c) if e is not None else None
    if not isinstance(value, float):
        raise QueryError(f"{what} must be a number")
    return value


def _aggregation(e: Aggregation, c: Context) -> DataFrame:
    inner = _value(e.expr, c)
    if not isinstance(inner, DataFrame):
        raise QueryError(f"{e.op} needs a vector")
    by, without = list(e.by) if e.by is not None else None, list(e.without) if e.without is not None else None
    if c.grid and without is None:
        by = [*(by or ()), STEP]
    if e.op in ("topk", "bottomk"):
        return agg.top(inner, int(_number(e.param, c, "k")), e.op == "topk", per_time=by is not None or without is not None, by=by, without=without)
    if e.op == "quantile":
        return agg.aggregate(inner, "quantile", by, without, arg=_number(e.param, c, "the quantile"))
    if e.op == "count_values":
        if not isinstance(e.param, Text):
            raise QueryError("count_values needs a label name")
        return agg.count_values(inner, e.param.value, by, without, c.start)
    return agg.aggregate(inner, e.op, by, without)


def _call(e: Call, c: Context) -> Value:
    name, args = e.name.lower(), e.args
    if name == "time":
        return fn.time(c.start)
    if name == "label_replace" or name == "label_join":
        texts = [a.value for a in args[1:] if isinstance(a, Text)]
        if len(texts) != len(args) - 1:
            raise QueryError(f"{name} takes a vector and texts")
        return (fn.label_replace if name == "label_replace" else fn.label_join)(_vector(args[0], c, name), *texts)
    if name == "vector":
        inner = _value(args[0], c)
        return fn.vector(inner) if isinstance(inner, DataFrame) else _as_vector(inner, c)
    if name in fn.DATES:
        return fn.date_part(_as_vector(_value(args[0], c) if args else fn.time(c.start), c), name)
    if name == "histogram_quantile":
        return histogram.histogram_quantile(_vector(args[1], c, name), _number(args[0], c, "the quantile"))
    if name == "quantile_over_time":
        return over_time.over_time(_vector(args[1], c, name), "quantile", c.end, _number(args[0], c, "the quantile"))
    if not args:
        raise QueryError(f"{e.name} needs an argument")
    numbers = [_number(a, c, f"an argument of {e.name}") for a in args[1:]]
    if name in fn.MATH or name in ("clamp", "clamp_max", "clamp_min") or e.name in fn.REGISTERED:
        return fn.apply(_as_vector(_value(args[0], c), c), e.name if e.name in fn.REGISTERED else name, *numbers)
    if name == "absent_over_time" and isinstance(args[0], Selector):
        return _absent_over_time(args[0], c)
    x = _vector(args[0], c, name)
    if name == "absent_over_time":
        return fn.absent(x, c.end)
    if name.endswith("_over_time") and name[: -len("_over_time")] in over_time.OVER_TIME:
        return over_time.over_time(x, name[: -len("_over_time")], c.end)
    plain = {
        "rate": lambda: over_time.rate(x, c.per_second, slice_ms=c.slice_ms), "irate": lambda: over_time.irate(x, c.per_second), "increase": lambda: over_time.increase(x),
        "delta": lambda: over_time.delta(x), "idelta": lambda: over_time.idelta(x), "resets": lambda: over_time.resets(x, c.end, c.slice_ms), "changes": lambda: over_time.changes(x, c.end, c.slice_ms),
        "deriv": lambda: over_time.deriv(x, c.start), "predict_linear": lambda: over_time.predict_linear(x, *(numbers or [60.0]), end=c.end, origin=c.start), "holt_winters": lambda: over_time.holt_winters(x, *numbers, slice_ms=c.smooth_ms),
        "double_exponential_smoothing": lambda: over_time.holt_winters(x, *numbers, slice_ms=c.smooth_ms), "present_over_time": lambda: over_time.present_over_time(x, c.end),
        "absent": lambda: fn.absent(x, c.start), "scalar": lambda: Scalar(fn.scalar(x, c.start)), "timestamp": lambda: fn.timestamp(x), "sort": lambda: fn.sort(x), "sort_desc": lambda: fn.sort(x, True),
    }
    if name not in plain:
        raise QueryError(f"unknown function {e.name!r}")
    return plain[name]()


def _vector(e: Expr, c: Context, what: str) -> DataFrame:
    inner = _value(e, c)
    if not isinstance(inner, DataFrame):
        raise QueryError(f"{what} needs a vector")
    return inner


class Engine:
    """Queries over one frame of samples, with plans kept by text, bounds and data version.

    What is kept is the lazy frame, so a repeated query isn't parsed and planned again; ``stored=True`` also asks
    Spark to keep its rows (in memory and on disk) until the entry is dropped.
    """

    def __init__(self, samples: DataFrame | Callable[[int, int], DataFrame], entries: int = 100, stored: bool = False, **options):
        self.samples, self.entries, self.stored, self.options = samples, entries, stored, options
        self.version = 0
        self._kept: dict[tuple, DataFrame] = {}

    def query(self, text: str, start: int, end: int | None = None) -> DataFrame:
        """Expressions of the present time aren't kept."""
        key = (text, start, end, self.version)
        if key not in self._kept:
            out = evaluate(text, self.samples, start, end, **self.options)
            if "time()" in text:
                return out
            while len(self._kept) >= self.entries:
                self._drop(next(iter(self._kept)))
            self._kept[key] = out.persist(StorageLevel.MEMORY_AND_DISK) if self.stored else out
        return self._kept[key]

    def _drop(self, key: tuple) -> None:
        out = self._kept.pop(key)
        if self.stored:
            out.unpersist()

    def replace(self, samples: DataFrame) -> None:
        """New data: kept results no longer hold."""
        self.samples, self.version = samples, self.version + 1
        for key in list(self._kept):
            self._drop(key)
