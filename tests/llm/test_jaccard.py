import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from seriesmill.llm import graph, jaccard


def brute(texts, words, percent):
    def shingles(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(ws[k : k + words]) for k in range(len(ws) - words + 1)} if len(ws) >= words else {tuple(ws)} if ws else set()

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label)]


def corpus(seed, n=120):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    bases = [[random.choice(vocabulary) for _ in range(random.randrange(1, 70))] for _ in range(n // 8)]
    passage = "the quick brown fox jumps over the lazy dog again and again".split()
    out = []
    for _ in range(n):
        t = list(random.choice(bases))
        for _ in range(random.choice((0, 0, 1, 1, 2, 6))):
            t[random.randrange(len(t))] = random.choice(vocabulary)
        if random.random() < 0.3:
            t = passage + t
        out.append(random.choice((" ", "\n", "  ")).join(w.upper() if random.random() < 0.1 else w for w in t))
    return out


def test_shingles():
    texts = [None, "", " \n", "A b", "a B  c", "a b c d\te", "x " * 50, "é É"]
    for words in (1, 3):
        got = [len(s) for s in jaccard.shingle_sets(texts, words)]
        assert got == [n for n, _ in brute(texts, words, 100)]
    one, two = jaccard.shingle_sets(["Ab c d e", "aB  c\td e"], 3)
    assert (one == two).all()
    long = " ".join(f"w{k}" for k in range(2000))
    window, whole = jaccard._words_of(long.encode(), 100), jaccard.word_hashes(long.encode())[0]
    assert (window == whole).all()


@pytest.mark.parametrize(("words", "percent", "settings"), [(3, 90, {}), (5, 80, {"listed": 3, "block": 4}), (2, 60, {"hot_entries": 5, "listed": 10, "block": 6})])
def test_against_all_pairs(docs, odd, words, percent, settings):
    texts = [*corpus(words), *odd, *odd]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs(texts), words, percent, **settings).collect()}
    assert got == dict(enumerate(brute(texts, words, percent)))


def test_blocks_find_all_links():
    rng = np.random.default_rng(0)
    for _ in range(40):
        base = rng.integers(0, 30, 12)
        sets = [np.unique(np.where(rng.random(12) < 0.1, rng.integers(0, 60, 12), base)) for _ in range(15)]
        label = list(range(15))
        for i, j in combinations(range(15), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        found = list(range(15))
        for a, b in jaccard.block_links(np.arange(15), sets, 80):
            found = [min(found[a], found[b]) if x in (found[a], found[b]) else x for x in found]
        assert found == label


def test_one_of_each(docs, odd):
    texts = [*corpus(9, 40), *odd]
    table = docs(texts)
    kept = jaccard.one_of_each(table.unionByName(table.where("doc_id = 3")), 5, 80)
    want = Counter(i for i, (n, c) in enumerate(brute(texts, 5, 80)) if i == c)
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == table.columns
    assert jaccard.classes(docs([]), 3, 90).count() == 0
    assert sorted(str(r.component_id) for r in jaccard.classes(docs(["a b c d", "a b c d"], ids=[None, None]), 3, 90).collect()) == ["None", "None"]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 140)]
    links = spark.createDataFrame([*chain, *star, (200, 200), (301, 300), (300, 301)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300}
    assert graph.components(links.where("false")).count() == 0
