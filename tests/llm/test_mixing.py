import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from seriesmill.llm import mixing


def filled(sizes, weights, epochs):
    """Targets by clamping and resharing, in exact numbers."""
    total, full = Fraction(sum(sizes.values())), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[t] for t in sizes if t not in full) for s in sizes if s not in full}
        over = {s for s, x in share.items() if x > epochs * sizes[s]}
        if not over:
            return {s: Fraction(epochs * sizes[s]) if s in full else share[s] for s in sizes}
        full |= over


def test_targets_and_takes(docs):
    random.seed(2)
    texts = [(" ".join("w" * random.randrange(1, 5) for _ in range(random.randrange(60))), s) for s, n in (("b", 300), ("a", 4), (None, 2), ("Z", 40), ("é", 1)) for _ in range(n)]
    texts += [(None, "b"), ("", "a"), texts[0], texts[0]]
    rows = mixing.mix(docs(texts)).collect()
    assert len(rows) == len(texts)
    sizes, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 3 * r.size
    weights = dict(zip(sorted((s for s in sizes if s), key=lambda s: s), (1, 2, 3, 1))) | {None: 2}
    want = filled({s: n for s, n in sizes.items()}, weights, 3)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs(texts).repartition(5)).collect()))
    repeats = Counter(r.doc_id for r in mixing.repeat(docs(texts)).collect())
    assert repeats == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixing.repeat(docs(texts)).columns == docs(texts).columns


@pytest.mark.parametrize(("digits", "sent"), [(1, 0), (3, 0), (1, 50_000)])
def test_against_the_whole_order(docs, monkeypatch, digits, sent):
    """Each source's rows in their order, one after the other; buckets of either size and both kinds of join."""
    monkeypatch.setattr(mixing, "DIGITS", digits)
    monkeypatch.setattr(mixing, "SENT", sent)
    random.seed(digits)
    texts = [(" ".join("w" for _ in range(random.randrange(30))), random.choice("aaaaaabbc")) for _ in range(400)]
    rows = {r.doc_id: r for r in mixing.mix(docs(texts)).collect()}
    for source in "abc":
        mine = sorted((hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), r.size, i) for i, r in rows.items() if r.source == source)
        size, target = rows[mine[0][2]].source_size, rows[mine[0][2]].target
        whole, done = int(target // size), 0
        for _, n, i in mine:
            extra = done + n / 2 <= target - whole * size
            assert rows[i].copies == (min(3, whole + extra) if n else 0)
            done += n
    repeats = Counter(r.doc_id for r in mixing.repeat(docs(texts)).collect())
    assert repeats == Counter({i: r.copies for i, r in rows.items() if r.copies})


def test_given_weights_and_nothing(spark, docs):
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, weight double")
    rows = {r.source: r for r in mixing.mix(docs([("x y", "a"), ("x y", "b")]), weights=weights).collect()}
    assert (rows["a"].target, rows["b"].target) == (4, 0)
    assert mixing.mix(docs([])).count() == 0
    assert [r.taken for r in mixing.mix(docs([("", "a"), (None, None)])).collect()] == [0, 0]
