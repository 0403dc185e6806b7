"""Recording rules, alerting rules with their states, and pre-aggregation by query frequency."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, is_dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import COLUMNS, label_text

#: Seconds for which a condition must hold before an alert fires, and after which a silent alert is over.
HOLD_S, EXPIRE_S = 300, 3600
CONDITIONS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "==", "ne": "!="}


@dataclass(frozen=True)
class Condition:
    op: str = "ne"
    threshold: float = 0.0

    @classmethod
    def parse(cls, text: str) -> Condition:
        """``gt 5`` and the like."""
        words = text.split()
        if len(words) != 2 or words[0].lower() not in CONDITIONS:
            raise ValueError(f"not a condition: {text!r}")
        return cls(words[0].lower(), float(words[1]))

    def holds(self, value: Column) -> Column:
        return {">": value > self.threshold, ">=": value >= self.threshold, "<": value < self.threshold, "<=": value <= self.threshold, "==": value == self.threshold, "!=": value != self.threshold}[CONDITIONS[self.op]]


@dataclass(frozen=True)
class Rule:
    name: str
    expr: str
    kind: str = "record"
    hold_s: float = HOLD_S
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)
    condition: Condition = Condition()
    interval_s: float = 60.0
    group: str = ""


def seconds(text: str | float | None, default: float) -> float:
    """A duration such as 5m or 1h30m in seconds."""
    from ..plans.parser import duration_ms

    if text is None:
        return default
    return float(text) if isinstance(text, int | float) else duration_ms(text) / 1000


def load(text: str) -> list[Rule]:
    """Rules of a document ``groups: [{name, interval, rules: [{record or alert, expr, for, labels, annotations}]}]``: JSON, or YAML where a reader is installed."""
    try:
        document = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the rules are not JSON, and no YAML reader is installed") from e
        document = yaml.safe_load(text)
    rules = []
    for group in (document or {}).get("groups") or []:
        for r in group.get("rules") or []:
            kind = r.get("type") or ("alert" if "alert" in r else "record")
            name = r.get("name") or r.get(kind)
            if not name or not r.get("expr"):
                raise ValueError(f"a rule lacks its name or expression: {r}")
            condition = Condition.parse(r["condition"]) if r.get("condition") else Condition()
            rules.append(Rule(name, r["expr"], kind, seconds(r.get("for"), HOLD_S), r.get("labels") or {}, r.get("annotations") or {}, condition, seconds(group.get("interval"), 60.0), group.get("name", "")))
    return rules


def load_file(path: str) -> list[Rule]:
    return load(Path(path).read_text())


def _literal_map(labels: dict[str, str]) -> Column:
    from ..model import no_labels

    return F.create_map(*(F.lit(x) for pair in sorted(labels.items()) for x in pair)) if labels else no_labels()


def record(result: DataFrame, rule: Rule, keep_labels: bool = True) -> DataFrame:
    """A rule's result as samples of the rule's name; its labels go over those of the result (or replace them)."""
    names = list(rule.labels)
    own = _literal_map(rule.labels)
    labels = F.map_concat(F.map_filter("labels", lambda k, _: ~k.isin(names)), own) if keep_labels else own
    out = result.withColumn("metric", F.lit(rule.name)).withColumn("labels", labels)
    return out.withColumn("series_id", F.xxhash64("metric", F.array_sort(F.map_entries("labels")))).select(COLUMNS)


def evaluate_record(samples: DataFrame, rule: Rule, now: int, window_ms: int = 300_000, keep_labels: bool = True) -> DataFrame:
    """The rule's expression over [now - window, now], recorded."""
    from ..plans.compile import evaluate

    return record(evaluate(rule.expr, samples, now - window_ms, now), rule, keep_labels)


def violations(samples: DataFrame, condition: Condition) -> DataFrame:
    """Samples with ``active``: whether the condition holds."""
    return samples.withColumn("active", condition.holds(F.col("value")))


def alert_states(evaluations: DataFrame, rule: Rule) -> DataFrame:
    """(series_id, series, ts, value, state, active_at): pending, then firing once the condition has held for the rule's time.

    ``evaluations``: samples, one for each evaluation of a series.  A run of active evaluations is an island: it ends
    where the condition fails or an evaluation is more than EXPIRE_S late.
    """
    by_time = Window.partitionBy("series_id").orderBy("ts", "seq")
    rows = violations(evaluations, rule.condition)
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(by_time) > EXPIRE_S * 1000, F.lit(True))
    starts = F.col("active") & (~F.coalesce(F.lag("active").over(by_time), F.lit(False)) | gap)
    rows = rows.withColumn("__island", F.sum(F.when(starts, 1).otherwise(0)).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("active").withColumn("active_at", F.min("ts").over(Window.partitionBy("series_id", "__island")))
    state = F.when(F.col("ts") - F.col("active_at") >= rule.hold_s * 1000, "firing").otherwise("pending")
    return rows.select("series_id", "metric", "labels", label_text().alias("series"), "ts", "value", state.alias("state"), "active_at")


def current_alerts(states: DataFrame, now: int) -> DataFrame:
    """The last state of each series that was evaluated within EXPIRE_S of ``now``."""
    last = F.max_by(F.struct("series", "ts", "value", "state", "active_at"), "ts")
    return states.where((F.col("ts") <= now) & (F.col("ts") >= now - EXPIRE_S * 1000)).groupBy("series_id").agg(last.alias("s")).select("series_id", "s.*")


#: Templates by severity: condition, seconds to hold.
TEMPLATES = {
    "critical": {"hold_s": 60.0, "labels": {"severity": "critical"}},
    "warning": {"hold_s": 300.0, "labels": {"severity": "warning"}},
    "info": {"hold_s": 600.0, "labels": {"severity": "info"}},
}


def from_template(severity: str, name: str, expr: str, condition: str) -> Rule:
    t = TEMPLATES[severity]
    return Rule(name, expr, "alert", t["hold_s"], dict(t["labels"]), {}, Condition.parse(condition))


# --- queries by frequency, and pre-aggregates that answer them

_CONSTANTS = "true|false|inf|nan"
_WORDS = "by|without|on|ignoring|offset|bool|group_left|group_right|and|or|unless"


def normalise(query: str) -> str:
    """A query's shape: white space collapsed, durations named, matchers in order of label, constants in capitals."""
    text = re.sub(r"\s+", " ", query.strip())
    text = re.sub(r"\{([^}]*)\}", lambda m: "{" + ",".join(sorted(p.strip() for p in m.group(1).split(",") if p.strip())) + "}", text)
    text = re.sub(r"\[[^\]]*\]", "[DURATION]", text)
    text = re.sub(r"\boffset\s+-?\w+", "offset DURATION", text, flags=re.I)
    text = re.sub(rf"\b({_WORDS})\b", lambda m: m.group(1).lower(), text, flags=re.I)
    return re.sub(rf"\b({_CONSTANTS})\b", lambda m: m.group(1).upper(), text)


def normalised(query: Column | str) -> Column:
    """``normalise`` for a column of queries."""
    col = F.col(query) if isinstance(query, str) else query
    text = F.regexp_replace(F.trim(F.regexp_replace(col, r"\s+", " ")), r"\[[^\]]*\]", "[DURATION]")
    # pieces between and within braces, the latter's matchers sorted
    between, within = F.split(text, r"\{[^}]*\}", -1), F.regexp_extract_all(text, F.lit(r"\{([^}]*)\}"), F.lit(1))
    matchers = F.transform(within, lambda w: F.concat(F.lit("{"), F.array_join(F.array_sort(F.filter(F.transform(F.split(w, ","), lambda m: F.trim(m)), lambda m: m != "")), ","), F.lit("}")))
    text = F.array_join(F.zip_with(between, matchers, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.regexp_replace(text, r"(?i)\boffset\s+-?\w+", "offset DURATION")
    for word in (*_WORDS.split("|"), *_CONSTANTS.split("|")):
        capital = word in _CONSTANTS.split("|")
        text = F.regexp_replace(text, rf"\b{word}\b" if capital else rf"(?i)\b{word}\b", word.upper() if capital else word)
    return text


@dataclass(frozen=True)
class Pattern:
    """What a query is made of: its shape, whether it aggregates, sums, takes rates, its metrics and label conditions."""

    query: str
    aggregates: bool
    rates: bool
    sums: bool
    metrics: tuple[str, ...]
    conditions: tuple[tuple[str, str, str], ...]


def pattern_of(query: str) -> Pattern:
    """The pattern of a query, from its syntax tree.  A query that can't be parsed is an error."""
    from ..plans.parser import Aggregation, Call, Selector, parse

    aggregates = rates = sums = False
    metrics: list[str] = []
    conditions: list[tuple[str, str, str]] = []
    todo = [parse(query)]
    while todo:
        e = todo.pop(0)
        if isinstance(e, Aggregation):
            aggregates, sums = True, sums or e.op == "sum"
        elif isinstance(e, Call):
            rates = rates or e.name.lower() in ("rate", "irate", "increase")
        elif isinstance(e, Selector):
            metrics += [e.metric] if e.metric else []
            conditions += [(m.label, m.op, m.value) for m in e.matchers]
        children = [getattr(e, name, None) for name in ("param", "expr", "left", "right")]
        todo = [x for x in children if is_dataclass(x)] + list(getattr(e, "args", ())) + todo
    return Pattern(normalise(query), aggregates, rates, sums, tuple(dict.fromkeys(metrics)), tuple(dict.fromkeys(conditions)))


def frequencies(log: DataFrame, now: int, window_ms: int = 86_400_000, threshold: int = 20) -> DataFrame:
    """(query, n, last_ts, frequent) of a log (query, ts) over its last 24 hours."""
    recent = log.where((F.col("ts") > now - window_ms) & (F.col("ts") <= now))
    return recent.groupBy(normalised("query").alias("query")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")).withColumn("frequent", F.col("n") >= threshold)


def new_rules(frequent: DataFrame, registry: DataFrame, most: int = 100) -> DataFrame:
    """Frequent queries that no registered rule answers yet, the most frequent first, as far as ``most`` rules allow."""
    auto = registry.where("auto").count() if "auto" in registry.columns else 0
    return frequent.where("frequent").join(registry.select("query"), "query", "left_anti").orderBy(F.desc("n"), "query").limit(max(0, most - auto))


def stale_rules(registry: DataFrame, frequent: DataFrame, now: int, per_hour: float = 5.0, idle_ms: int = 48 * 3_600_000) -> DataFrame:
    """Automatic rules that are asked for less than 5 times an hour and not in 48 hours."""
    rows = registry.where("auto").join(frequent.select("query", "n", F.col("last_ts").alias("__last")), "query", "left")
    return rows.where((F.coalesce(F.col("n"), F.lit(0)) / 24.0 < per_hour) & (F.coalesce("__last", F.lit(0)) < now - idle_ms)).select(registry.columns)


def route(query: str, registry: list[dict], now: int) -> dict | None:
    """The pre-aggregate that answers a query: equal shape, the best score above 0.

    Entries: query, auto, frequency (an hour), last_ts.  score = 0.1 if automatic + log10(frequency) / 10 +
    0.3, 0.2 or 0.1 if used in the last 1, 6 or 24 hours.
    """
    best, top = None, 0.0
    for entry in registry:
        if normalise(entry["query"]) != normalise(query):
            continue
        age = (now - entry.get("last_ts", 0)) / 3_600_000
        recent = 0.3 if age < 1 else 0.2 if age < 6 else 0.1 if age < 24 else 0.0
        f = entry.get("frequency", 0)
        score = (0.1 if entry.get("auto") else 0.0) + (math.log10(f) / 10 if f > 0 else -math.inf) + recent
        if score > top:
            best, top = entry, score
    return best


def refresh(samples: DataFrame, rule: Rule, now: int, path: str) -> None:
    """Computes a pre-aggregate over its last two intervals and replaces its table."""
    from ..plans.compile import evaluate

    evaluate(rule.expr, samples, int(now - 2 * rule.interval_s * 1000), now).write.mode("overwrite").parquet(path)
