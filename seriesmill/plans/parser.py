"""The query language: a recursive-descent parser to a small syntax tree.

    expr     = or ; and, unless bind tighter than or, then comparisons, + -, * / %, unary signs, ^ (to the right)
    binary   = expr op ["bool"] [("on" | "ignoring") "(" names ")" [("group_left" | "group_right") ["(" names ")"]]] expr
    aggr     = name [("by" | "without") "(" names ")"] "(" [expr ","] expr ")" [("by" | "without") "(" names ")"]
    selector = [metric] ["{" matcher ("," matcher)* "}"]
    suffixes = "[" duration "]" | "[" duration ":" [duration] "]" | "offset" ["-" | "+"] duration | "@" (ms | start() | end())

Errors carry their position; nothing is dropped in silence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..operators.select import Matcher

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
AGGREGATIONS = frozenset("sum avg min max count stddev stdvar topk bottomk quantile count_values group".split())
COMPARISONS = frozenset(("==", "!=", "<", "<=", ">", ">="))
LEVELS = ({"or"}, {"and", "unless"}, COMPARISONS, {"+", "-"}, {"*", "/", "%"})
_KEYWORDS = frozenset("and or unless by without on ignoring group_left group_right bool offset".split())


class ParseError(ValueError):
    """What is wrong, and where."""

    def __init__(self, message: str, text: str, at: int):
        super().__init__(f"{message} at position {at}: {text[at : at + 20]!r}")
        self.at = at


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Selector:
    metric: str | None = None
    matchers: tuple[Matcher, ...] = ()
    range_ms: int | None = None
    offset_ms: int = 0
    at: int | str | None = None


@dataclass(frozen=True)
class Subquery:
    expr: Expr
    range_ms: int
    step_ms: int | None = None
    offset_ms: int = 0
    at: int | str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Aggregation:
    op: str
    expr: Expr
    param: Expr | None = None
    by: tuple[str, ...] | None = None
    without: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Unary:
    op: str
    expr: Expr


@dataclass(frozen=True)
class Matching:
    on: tuple[str, ...] | None = None
    ignoring: tuple[str, ...] | None = None
    group: str | None = None
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr
    matching: Matching = field(default_factory=Matching)
    as_bool: bool = False


Expr = Number | Text | Selector | Subquery | Call | Aggregation | Unary | Binary

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<duration>(?:\d+(?:ms|[smhdwy]))+(?![\w.]))|(?P<number>0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_:]*)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<op>=~|!~|==|!=|<=|>=|[-+*/%^<>=(){}\[\],:@])"""
)


def duration_ms(text: str) -> int:
    """5m, 1h30m, 250ms ... in milliseconds."""
    if not re.fullmatch(r"(?:\d+(?:ms|[smhdwy]))+", text):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * UNITS[unit] for n, unit in re.findall(r"(\d+)(ms|[smhdwy])", text))


def _unquoted(text: str) -> str:
    if text[0] == "`":
        return text[1:-1]
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)) if m.group(1) in "ntr\\\"'" else m.group(0), text[1:-1])


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        # colons belong to metric names but also part the durations of a subquery
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError("unexpected character", text, at)
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.k = 0

    @property
    def now(self) -> tuple[str, str, int]:
        return self.tokens[self.k]

    def fail(self, message: str) -> ParseError:
        return ParseError(message, self.text, self.now[2])

    def take(self) -> tuple[str, str, int]:
        token = self.now
        self.k += 1
        return token

    def has(self, value: str) -> bool:
        kind, text, _ = self.now
        return kind in ("op", "name") and text.lower() == value

    def accept(self, value: str) -> bool:
        if self.has(value):
            self.k += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise self.fail(f"expected {value!r}")

    def kind(self, kind: str) -> str:
        if self.now[0] != kind:
            raise self.fail(f"expected a {kind}")
        return self.take()[1]

    def names(self) -> tuple[str, ...]:
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(self.kind("name"))
            if not self.has(")"):
                self.expect(",")
        return tuple(out)

    def whole(self) -> Expr:
        out = self.binary(0)
        if self.now[0] != "end":
            raise self.fail("unexpected text")
        return out

    def binary(self, level: int) -> Expr:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.now[0] in ("op", "name") and self.now[1].lower() in LEVELS[level]:
            op = self.take()[1].lower()
            as_bool, matching = self.modifiers(op)
            left = Binary(op, left, self.binary(level + 1), matching, as_bool)
        return left

    def modifiers(self, op: str) -> tuple[bool, Matching]:
        as_bool = op in COMPARISONS and self.accept("bool")
        matching = Matching()
        if self.accept("on"):
            matching = Matching(on=self.names())
        elif self.accept("ignoring"):
            matching = Matching(ignoring=self.names())
        for side in ("left", "right"):
            if self.accept(f"group_{side}"):
                matching = replace(matching, group=side, include=self.names() if self.has("(") else ())
        return as_bool, matching

    def unary(self) -> Expr:
        if self.has("-") or self.has("+"):
            op = self.take()[1]
            inner = self.unary()
            if isinstance(inner, Number):
                return Number(-inner.value if op == "-" else inner.value)
            return Unary(op, inner)
        return self.power()

    def power(self) -> Expr:
        left = self.suffixed()
        if self.accept("^"):
            as_bool, matching = self.modifiers("^")
            return Binary("^", left, self.unary(), matching, as_bool)
        return left

    def duration(self) -> int:
        sign = -1 if self.accept("-") else 1
        if sign > 0:
            self.accept("+")
        kind, text, _ = self.now
        if kind != "duration":
            raise self.fail("expected a duration")
        self.take()
        return sign * duration_ms(text)

    def suffixed(self) -> Expr:
        out = self.primary()
        while True:
            if self.accept("["):
                size = self.duration()
                if self.accept(":"):
                    step = None if self.has("]") else self.duration()
                    out = Subquery(out, size, step)
                elif isinstance(out, Selector) and out.range_ms is None:
                    out = replace(out, range_ms=size)
                else:
                    raise self.fail("only a selector can have a range")
                self.expect("]")
            elif self.has("offset"):
                if not isinstance(out, Selector | Subquery):
                    raise self.fail("only a selector or subquery can have an offset")
                self.take()
                out = replace(out, offset_ms=self.duration())
            elif self.has("@"):
                if not isinstance(out, Selector | Subquery):
                    raise self.fail("only a selector or subquery can have an instant")
                self.take()
                out = replace(out, at=self.instant())
            else:
                return out

    def instant(self) -> int | str:
        if self.now[0] == "name" and self.now[1] in ("start", "end"):
            name = self.take()[1]
            self.expect("(")
            self.expect(")")
            return name
        sign = -1 if self.accept("-") else 1
        return sign * int(float(self.kind("number")))

    def primary(self) -> Expr:
        kind, text, _ = self.now
        if kind == "number":
            self.take()
            return Number(float(int(text, 16)) if text.lower().startswith("0x") else float(text))
        if kind == "duration":
            raise self.fail("a duration can't stand here")
        if kind == "text":
            self.take()
            return Text(_unquoted(text))
        if self.accept("("):
            out = self.binary(0)
            self.expect(")")
            return out
        if self.has("{"):
            return Selector(None, self.matchers(None))
        if kind != "name":
            raise self.fail("expected an expression")
        low = text.lower()
        after = self.tokens[self.k + 1][1].lower()
        if low in ("nan", "inf") and after not in ("(", "{", "["):
            self.take()
            return Number(float(low))
        if low in AGGREGATIONS and after in ("(", "by", "without"):
            return self.aggregation()
        if low in _KEYWORDS:
            raise self.fail("expected an expression")
        self.take()
        if self.accept("("):
            args = []
            while not self.accept(")"):
                args.append(self.binary(0))
                if not self.has(")"):
                    self.expect(",")
            return Call(text, tuple(args))
        return Selector(text, self.matchers(text) if self.has("{") else ())

    def aggregation(self) -> Expr:
        op = self.take()[1].lower()
        by, without = self.grouping()
        self.expect("(")
        args = [self.binary(0)]
        while self.accept(","):
            args.append(self.binary(0))
        self.expect(")")
        if by is None and without is None:
            by, without = self.grouping()
        wanted = 2 if op in ("topk", "bottomk", "quantile", "count_values") else 1
        if op == "quantile" and len(args) == 1:
            args.insert(0, Number(0.5))
        if len(args) != wanted:
            raise self.fail(f"{op} takes {wanted} arguments")
        return Aggregation(op, args[-1], args[0] if wanted == 2 else None, by, without)

    def grouping(self) -> tuple[tuple[str, ...] | None, tuple[str, ...] | None]:
        if self.accept("by"):
            return self.names(), None
        if self.accept("without"):
            return None, self.names()
        return None, None

    def matchers(self, metric: str | None) -> tuple[Matcher, ...]:
        self.expect("{")
        out = []
        while not self.accept("}"):
            label = self.kind("name")
            if self.now[1] not in ("=", "!=", "=~", "!~"):
                raise self.fail("expected = != =~ or !~")
            op = self.take()[1]
            if self.now[0] == "text":
                value = _unquoted(self.take()[1])
            elif self.now[0] in ("name", "number"):
                value = self.take()[1]  # bare values are allowed
            else:
                raise self.fail("expected a value")
            out.append(Matcher(label, op, value))
            if not self.has("}"):
                self.expect(",")
        if metric is None and not out:
            raise self.fail("a selector needs a name or a matcher")
        return tuple(out)


def parse(text: str) -> Expr:
    return _Parser(text).whole()
