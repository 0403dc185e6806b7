import pytest

from seriesmill.operators.select import Matcher
from seriesmill.plans.natural import to_query
from seriesmill.plans.parser import Aggregation, Binary, Call, Matching, Number, ParseError, Selector, Subquery, Text, Unary, duration_ms, parse


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("up", Selector("up")),
        ('up{job="a",x!="b"}', Selector("up", (Matcher("job", "=", "a"), Matcher("x", "!=", "b")))),
        ("up{job='a', x=~\"b.*\", y!~`c`,}", Selector("up", (Matcher("job", "=", "a"), Matcher("x", "=~", "b.*"), Matcher("y", "!~", "c")))),
        ('{job="a"}', Selector(None, (Matcher("job", "=", "a"),))),
        ("up[5m] offset 1h", Selector("up", (), 300_000, 3_600_000)),
        ("up @ 2000 offset -1h30m", Selector("up", (), None, -5_400_000, 2000)),
        ("up offset 1h @ end()", Selector("up", (), None, 3_600_000, "end")),
        ("rate(up[5m])[1h:5m]", Subquery(Call("rate", (Selector("up", (), 300_000),)), 3_600_000, 300_000)),
        ("up[1h:]", Subquery(Selector("up"), 3_600_000)),
        ("sum by (a, b) (up)", Aggregation("sum", Selector("up"), None, ("a", "b"))),
        ("SUM(up) without (a)", Aggregation("sum", Selector("up"), None, None, ("a",))),
        ("topk(3, up)", Aggregation("topk", Selector("up"), Number(3.0))),
        ("quantile(up)", Aggregation("quantile", Selector("up"), Number(0.5))),
        ('count_values("v", up)', Aggregation("count_values", Selector("up"), Text("v"))),
        ("1 + 2 * 3 ^ 2 ^ 2", Binary("+", Number(1.0), Binary("*", Number(2.0), Binary("^", Number(3.0), Binary("^", Number(2.0), Number(2.0)))))),
        ("-2 ^ 2", Unary("-", Binary("^", Number(2.0), Number(2.0)))),
        ("a - b - c", Binary("-", Binary("-", Selector("a"), Selector("b")), Selector("c"))),
        ("a or b and c", Binary("or", Selector("a"), Binary("and", Selector("b"), Selector("c")))),
        ("a > bool 5", Binary(">", Selector("a"), Number(5.0), as_bool=True)),
        ("a / on(x) group_left(y) b", Binary("/", Selector("a"), Selector("b"), Matching(on=("x",), group="left", include=("y",)))),
        ("sum(rate(a[5m])) / sum(rate(b[5m]))", Binary("/", Aggregation("sum", Call("rate", (Selector("a", (), 300_000),))), Aggregation("sum", Call("rate", (Selector("b", (), 300_000),))))),
        ("time()", Call("time", ())),
        ("Inf", Number(float("inf"))),
        ("0x1f", Number(31.0)),
        (r'label_replace(a, "b", "\"$1", "c", "(.*)\\d")', Call("label_replace", (Selector("a"), Text("b"), Text('"$1'), Text("c"), Text("(.*)\\d")))),
    ],
)
def test_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "sum(", 'x{a="b"', "x[5]", "x[5m][5m]", "x)", "a b", "{}", "a +", "topk(x)", "1m", "x offset", "a offset 5", "sum(x) by a", "&", "x{a~b}"])
def test_errors_have_positions(text):
    with pytest.raises(ParseError, match="position"):
        parse(text)


def test_durations():
    assert [duration_ms(t) for t in ("1ms", "5s", "1h30m", "2d", "1w", "1y")] == [1, 5000, 5_400_000, 172_800_000, 604_800_000, 31_536_000_000]
    with pytest.raises(ValueError):
        duration_ms("5")


@pytest.mark.parametrize(
    ("request_", "expr"),
    [
        ("average cpu usage by host", "avg by (host) (cpu_usage)"), ("What is the max memory in the last 2 hours?", "max_over_time(memory[2h])"), ("rate of http requests per second", "rate(http_requests[1s])"),
        ("top 5 cpu usage", "topk(5, cpu_usage)"), ("95th percentile of latency", "quantile(0.95, latency)"), ("cpu usage above 80", "cpu_usage > 80"), ("total errors", "sum(errors)"), ("show requests", "requests"),
        ("increase of errors over the last day", "increase(errors[1d])"),
    ],
)
def test_requests(request_, expr):
    assert to_query(request_) == expr
    parse(expr)


@pytest.mark.parametrize(
    ("request_", "expr"),
    [
        ("cpu usage for the last 5 minutes", "cpu_usage[5m]"), ("average memory usage by host", "avg by (host) (memory_usage)"), ("max disk usage in the last 1 hour", "max_over_time(disk_usage[1h])"),
        ("rate of requests per second", "rate(requests[1s])"), ("sum of network traffic by datacenter", "sum by (datacenter) (network_traffic)"), ("min temperature in the last 24 hours", "min_over_time(temperature[24h])"),
        ("count of errors in the last 30 minutes", "count_over_time(errors[30m])"), ("cpu usage greater than 80%", "cpu_usage > 80"), ("memory usage less than 50%", "memory_usage < 50"),
        ("rate of requests per minute for the last 1 hour", "rate(requests[1h]) * 60000"),
    ],
)
def test_sentences_of_the_reference(request_, expr):
    assert to_query(request_) == expr
    parse(expr)


def test_unknown_requests():
    with pytest.raises(ValueError):
        to_query("make me a sandwich, please do")
