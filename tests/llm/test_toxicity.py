import random
import re
import time
import zlib

import pytest

from seriesmill.llm import toxicity
from seriesmill.llm.toxicity import Lexicon, Matcher, fold


def test_folding():
    assert fold("An IDIOT! 1d10t id1ot ѕtuріd ｍｏｒｏｎ i­diot i​diot") == ["an", "idiot", "idiot", "ldlot", "idiot", "idlot", "stupid", "moron", "idiot", "idiot"]
    assert fold("$tupid cl0wn 2024 été") == ["stupid", "clown", "2024", "été"]
    assert fold("") == []


def test_matching():
    m = Matcher(Lexicon({"trash": 3.0, "idiot": 5.0}, {"lowei": 4.0}, ("trash can",), (-3.0, 1.0, 0.0, 0.0)))
    assert m.features("the trash can") == (0, 0, 0)
    assert m.features("the trash can is trash")[0] == 3
    assert m.features("loweiing alowei idiots")[0] == 4 and m.features("IDIOT")[0] == 5
    assert m.score("nice") == pytest.approx(1 / (1 + 2.718281828459045**3)) and m.score("1d1ot") > 0.8 > 0.5 > m.score("")
    assert Matcher(Lexicon()).features("a b") == (0, 0, 0)


def labelled(spark, n=400):
    random.seed(4)
    words = ["".join(random.choice("abdegklmnoprstuv") for _ in range(random.randrange(3, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        text = [random.choice(words) for _ in range(random.randrange(5, 80))]
        bad = i % 5 == 0
        if bad:
            text[random.randrange(len(text))] = random.choice(["zonkwit", "grimfoo", "zork" + random.choice(["al", "ec", "id", "of", "um"])])
        elif i % 7 == 0:
            text += ["zonkwit", "fair"]  # harmless there
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(n, None), (n + 1, ""), (n + 2, "zorkyx zonkwit fair"), (n + 3, "zorkyx"), (n + 4, "GRIMF00 z0nkwit")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (n, None), (None, 1)], "doc_id long, toxic int")


def test_learning(spark):
    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(rows) == 405 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(r.predicted, int(i % 5 == 0)) for i, r in rows.items() if r.held_out and i < 400]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert (rows[400].predicted, rows[401].predicted, rows[404].predicted) == (0, 0, 1)


def test_only_near_copies_are_dropped(spark):
    words = sorted((a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nprstvz"), key=lambda w: zlib.crc32(w.encode()))
    least, rest = words[:3], words[3:]
    texts = [least + rest[:40], least + rest[1:40], least + rest[100:140], least + rest[:40], least + rest[102:140], ["other"], []]
    train = spark.createDataFrame([*((k, " ".join(t), int(k == 3)) for k, t in enumerate(texts)), (7, "", 0)], "doc_id long, text string, label int")
    # 1 is nearly 0 and 4 nearly 2; 3 is 0 with another label; 2 shares with 0 no more than the three least words
    assert sorted(r.doc_id for r in toxicity._without_copies(train).collect()) == [0, 2, 3, 5, 6]


def plain_matches(lexicon, words):
    """Where counted matches begin, each word and phrase looked for by itself."""
    text = f" {' '.join(words)} "
    free = [(m.start(), m.start() + len(p) + 1) for p in lexicon.exceptions for m in re.finditer(f"(?= {re.escape(p)} )", text)]
    found = {}
    for m in re.finditer(" (?=([^ ]+))", text):
        w, at = m.group(1), m.start()
        weights = [v for k, v in lexicon.words.items() if k == w] + [v for k, v in lexicon.stems.items() if w.startswith(k)]
        if weights and not any(a <= at < b for a, b in free):
            found[at] = max(weights)
    return found


def test_against_plain_search():
    random.seed(8)
    for _ in range(300):
        vocabulary = ["".join(random.choice("ab") for _ in range(random.randrange(1, 4))) for _ in range(8)]
        lexicon = Lexicon({w: random.random() for w in vocabulary[:3]}, {w: random.random() for w in vocabulary[3:5]}, tuple({f"{random.choice(vocabulary)} {random.choice(vocabulary)}" for _ in range(3)}))
        words = random.choices(vocabulary, k=random.randrange(30))
        assert Matcher(lexicon).matches(words)[1] == plain_matches(lexicon, words)


def test_many_matches_and_exceptions_take_linear_time():
    m = Matcher(Lexicon({"trash": 3.0}, {}, ("trash can",)))
    began = time.monotonic()
    assert m.matches(["trash", "can"] * 300_000)[1] == {}
    assert time.monotonic() - began < 10


def test_long_words_are_learned(spark):
    word = "zonk" * 13
    rows = [(k, f"{word} a" if k % 3 == 0 else f"b{k % 7} a", int(k % 3 == 0)) for k in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    # texts that are copies of each other count once, so each is made different
    docs = docs.selectExpr("doc_id", "concat(text, ' ', repeat(concat('w', doc_id, ' '), 3), 'x', doc_id, ' y', doc_id) AS text")
    assert word in toxicity.learn(docs, labels).words
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in toxicity.classify(docs, labels).collect())


def test_odd_texts(spark, docs, odd):
    table = docs([*odd, "same", "same"], ids=[*range(len(odd)), 77, 77])
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(odd))], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.score) for r in toxicity.classify(table, labels).collect())
    assert len(got) == len(odd) + 2 and all(0 <= s <= 1 for _, s in got) and got[-1] == got[-2] and got[0][1] == got[1][1]


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark, 100)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, turned)


def test_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert len(toxicity.learn(docs, labels.where("toxic = 0"))) == 0
    assert toxicity.classify(docs.where("false"), labels.where("false")).count() == 0
    # one class only: every row gets the share of that class
    assert {r.predicted for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0}
    assert toxicity.keep_clean(docs, labels.where("toxic = 0")).count() == docs.count()
    assert toxicity.keep_clean(docs, labels.where("toxic = 1")).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels.where("false"))).collect()} == {0.5}
