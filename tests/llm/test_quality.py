import random
import zlib

import numpy as np

from seriesmill.llm import quality


def test_passages_cover_the_text():
    for n in (0, 1, 63, 64, 65, 127, 128, 129, 1000):
        for blank in (" ", "\t", "\n", " \r\n "):
            text = blank.join(str(k) for k in range(n))
            parts = quality.passages(text)
            assert "".join(t for t, _ in parts) == text and [w for _, ws in parts for w in ws] == text.split()
            assert len(parts) == max(1, n // 64) and all(len(ws) < 128 for _, ws in parts)
    assert len(quality.bag(None)) == len(quality.bag("")) == len(quality.bag(" \t")) == 1 and quality.bag("x y").shape[1] == quality.WIDTH


def test_text_without_blanks_has_passages():
    text = "漢字かな交じり文。" * 2000
    parts = quality.passages(text)
    assert "".join(t for t, _ in parts) == text and len(parts) == len(text) // quality.LONGEST // 64
    assert len(quality.bag(text)) == len(parts)


def plain_hashed(words):
    """The inputs of one passage, counted one by one."""
    data = " ".join(words).lower().encode() + b"   "
    counts = np.zeros((2, quality.HASHED))
    for word in data.split():
        total = 0
        for place, byte in enumerate(word):
            x = (byte + 257 * (place + 1)) * 0xBF58476D1CE4E5B9 % 2**64
            total += x ^ (x >> 29)
        counts[0, (total * 0x94D049BB133111EB % 2**64 >> 40) % quality.HASHED] += 1
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[1, ((a << 16 | b << 8 | c) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % quality.HASHED] += 1
    return np.log1p(counts / (1 + counts.sum(1, keepdims=True)) * quality.HASHED).ravel()


def test_words_and_triples_are_inputs():
    assert np.allclose(quality.hashed([("", ["Some", "été", "words"])])[0], plain_hashed(["Some", "été", "words"]), atol=1e-5)
    one, two = quality.bag("alpha beta"), quality.bag("alpha zeta")
    assert not np.allclose(one[:, quality.SHAPE :], two[:, quality.SHAPE :])


def test_gradients():
    """Back-propagation against differences of the loss, for every weight."""
    rng = np.random.default_rng(0)
    sizes, d, width, gate = (1, 3, 2, 4), 5, 6, 4
    doc, y = np.repeat(np.arange(4), sizes), np.array([0.0, 1.0, 1.0, 0.0])
    x = rng.normal(size=(len(doc), d))
    w = {"W": rng.normal(size=(d, width)), "b": rng.normal(size=width), "V": rng.normal(size=(width, gate)), "U": rng.normal(size=(width, gate)), "a": rng.normal(size=gate), "c": rng.normal(size=width), "d": np.array(0.3)}

    def loss(weights):
        p = quality.Model(np.zeros(d), np.ones(d), weights).forward(x, doc, 4)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    found = quality.Model(np.zeros(d), np.ones(d), w).gradients(x, doc, y)
    for name, value in w.items():
        for at in np.ndindex(value.shape):
            step = np.zeros(value.shape)
            step[at] = 1e-6
            want = (loss(w | {name: value + step}) - loss(w | {name: value - step})) / 2e-6
            assert abs(want - np.asarray(found[name])[at]) < 1e-6, (name, at)


def test_fitting():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, 5)) for k in (1, 3, 2, 4)]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    model = quality.fit(bags * 20, np.tile(y, 20), width=6, gate=4, epochs=60, batch=16)
    assert ((model.scores(bags) > 0.5) == y).all()
    a = model.forward((np.concatenate(bags) - model.center) / model.scale, np.repeat(np.arange(4), [1, 3, 2, 4]), 4)["attention"]
    assert np.allclose(np.add.reduceat(a, [0, 1, 4, 6]), 1)


def test_scores_do_not_depend_on_batches(monkeypatch):
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k % 7 + 1, quality.WIDTH)) for k in range(30)]
    model = quality.fit(bags, np.arange(30) % 2.0, epochs=2)
    want = model.scores(bags)
    monkeypatch.setattr(quality, "AT_ONCE", 3)
    assert np.allclose(want, model.scores(bags))


def test_one_bad_passage_tells(spark):
    random.seed(1)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randrange(2, 9)))
    rows = []
    for i in range(300):
        good = i % 4 > 0
        text = [word() for _ in range(random.randrange(20, 400))]
        if not good:
            at = random.randrange(max(1, len(text) - 64))
            text[at : at + 64] = ["SPAM!!"] * 64
        rows.append((i, " ".join(text), int(good)))
    docs = spark.createDataFrame([*[r[:2] for r in rows], (300, None), (301, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(got) == 302 and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    model = quality.learn(docs, labels)
    assert abs(model.attention(rows[0][1]).sum() - 1) < 1e-9


def test_all_passages_of_a_document_are_learned_from(spark, monkeypatch):
    sizes = {1: 100, 2: 3, 3: 70, 4: 1, 5: 200}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in sizes)
    docs = spark.createDataFrame([(i, " ".join(["word"] * quality.PASSAGE * n)) for i, n in sizes.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in sizes], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit", lambda bags, ys: [len(b) for b in bags])
    assert quality.learn(docs, labels) == list(sizes.values())
    some = quality.learn(docs, labels, max_passages=180)
    assert sum(some) <= 180 and set(some) < set(sizes.values())


def test_odd_texts(spark, docs, odd):
    table = docs([*odd, "same", "same"], ids=[*range(len(odd)), 77, 77])
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(odd))], "doc_id long, quality int")
    got = sorted((r.doc_id, r.score) for r in quality.classify(table, labels, epochs=2).collect())
    assert len(got) == len(odd) + 2 and all(0 <= s <= 1 for _, s in got) and got[-1] == got[-2]
    assert got[0][1] == got[1][1]  # null and empty
