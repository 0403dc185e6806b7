"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of words).  Every passage is described by sizes, shares and signs, by its
words and by its letter triples (both hashed to a fixed number of inputs), and encoded by a small network; learned
gated attention weighs the encodings, and the weighted sum, which stands for the document, is scored.  Only document
labels are known in training: which passages tell is learned with the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written
from .labelled import fold_of, training_rows

#: Words of a passage; the last one may have up to twice as many less one.
PASSAGE = 64
#: Characters of a word; what is longer, as in scripts without spaces, counts as several words.
LONGEST = 64
#: Inputs for the words of a passage and for its letter triples.
HASHED = 32
#: Passages encoded at a time.
AT_ONCE = 20_000
#: Documents learned from, at most, and passages that these have in all.
MAX_TRAIN = 12_000
MAX_PASSAGES = 400_000

_SIGNS = (".", ",", "!", "?", "|", "#", "%", "*", "&", "$", "@", "=", "/", "_", "\n", "{", "<")


_WORD = re.compile(rf"[^\x20\x09-\x0D]{{1,{LONGEST}}}")


def passages(text: str) -> list[tuple[str, list[str]]]:
    """The passages of a whole text, as text and words; they join to the text.  An empty text is one empty passage."""
    found = list(_WORD.finditer(text))
    words = [m.group() for m in found]
    begins = range(0, max(1, len(words) - PASSAGE + 1), PASSAGE)
    cuts = [0, *(found[k].start() for k in begins[1:]), len(text)]
    return [(text[i:j], words[k : k + PASSAGE if k != begins[-1] else None]) for k, i, j in zip(begins, cuts, cuts[1:])]


def features(text: str, words: list[str]) -> list[float]:
    """Numbers that describe a passage: sizes, shares of character classes, repetition."""
    words = words or [""]
    chars, n = len(text) + 1, len(words)
    distinct = set(words)
    k = len(distinct)
    upper = sum(map(str.isupper, words))
    lines = text.split("\n")
    out = [
        np.log1p(chars) / 8, np.log1p(n) / 5, k / n, upper / n, sum(map(str.isalpha, words)) / n, sum(map(str.istitle, words)) / n,
        min(1.0, sum(map(len, distinct)) / k / 16), sum(map(str.isdigit, text)) / chars, len(set(lines)) / len(lines), min(1.0, len(lines) / n * 8),
        len(set(map(str.lower, words))) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), min(1.0, max(map(len, words)) / 64),
    ]
    out += [min(1.0, 8 * text.count(s) / n) for s in _SIGNS]
    return out


SHAPE = 13 + len(_SIGNS)
WIDTH = SHAPE + 2 * HASHED


def hashed(parts: list[tuple[str, list[str]]]) -> np.ndarray:
    """For each passage, how often its words and its letter triples fall to each of HASHED numbers, as logarithms per size."""
    data = [" ".join(words).lower().encode("utf-8", "surrogatepass") + b"   " for _, words in parts]
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(data)), [len(d) for d in data])
    out = np.zeros((len(data), 2, HASHED), np.float32)
    # triples: those across two passages begin in the blanks between them
    triples = (raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]) * np.uint64(0x9E3779B97F4A7C15)
    out[:, 1] = np.bincount(row[:-2] * HASHED + (triples >> np.uint64(40)).astype(np.int64) % HASHED, minlength=len(data) * HASHED).reshape(len(data), HASHED)
    # words: sums of mixed bytes by place
    inside = raw != 32
    begins = np.nonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)[0]
    if len(begins):
        number = np.cumsum(np.diff(inside.astype(np.int8), prepend=0) == 1)[inside] - 1
        place = np.nonzero(inside)[0] - begins[number]
        mixed = (raw[inside] + np.uint64(257) * (place.astype(np.uint64) + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), np.searchsorted(number, np.arange(len(begins)))) * np.uint64(0x94D049BB133111EB)
        out[:, 0] = np.bincount(row[begins] * HASHED + (sums >> np.uint64(40)).astype(np.int64) % HASHED, minlength=len(data) * HASHED).reshape(len(data), HASHED)
    return np.log1p(out / (1 + out.sum(axis=2, keepdims=True)) * HASHED).reshape(len(data), 2 * HASHED)


def bag(text: str | None) -> np.ndarray:
    """One row of inputs for each passage of a text."""
    parts = passages(text or "")
    out = np.empty((len(parts), WIDTH), np.float32)
    out[:, :SHAPE] = [features(t, w) for t, w in parts]
    out[:, SHAPE:] = hashed(parts)
    return out


@dataclass(frozen=True)
class Model:
    """A passage encoder, gated attention over its encodings, and a classifier of their weighted sum."""

    center: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, doc: np.ndarray, n_docs: int) -> dict[str, np.ndarray]:
        """``doc``: the number of each passage's document, ascending.  Softmax and sums run within documents."""
        w = self.weights
        h = np.maximum(0, x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        starts = np.searchsorted(doc, np.arange(n_docs))
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        attention = e / np.add.reduceat(e, starts)[doc]
        z = np.add.reduceat(h * attention[:, None], starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"h": h, "t": t, "g": g, "attention": attention, "z": z, "p": p}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(bags))
        first = 0
        while first < len(bags):
            last, size = first, 0
            while last < len(bags) and (last == first or size + len(bags[last]) <= AT_ONCE):
                size += len(bags[last])
                last += 1
            part = bags[first:last]
            x = ((np.concatenate(part) - self.center) / self.scale).astype(np.float32)
            out[first:last] = self.forward(x, np.repeat(np.arange(len(part)), [len(b) for b in part]), len(part))["p"]
            first = last
        return out

    def attention(self, text: str | None) -> np.ndarray:
        """The weights of a text's passages; they sum to 1."""
        x = bag(text)
        return self.forward((x - self.center) / self.scale, np.zeros(len(x), int), 1)["attention"]


    def gradients(self, x: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by back-propagation through the attention."""
        w, n = self.weights, len(labels)
        f = self.forward(x, doc, n)
        dlogit = (f["p"] - labels) / n
        dz = dlogit[:, None] * w["c"]
        dh = dz[doc] * f["attention"][:, None]
        pull = (dz[doc] * f["h"]).sum(1)
        mean = np.add.reduceat(pull * f["attention"], np.searchsorted(doc, np.arange(n)))[doc]
        de = f["attention"] * (pull - mean)
        dtg = de[:, None] * w["a"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ w["V"].T + dg @ w["U"].T
        dh *= f["h"] > 0
        return {
            "W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dlogit, "d": dlogit.sum(),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, width: int = 24, gate: int = 12, epochs: int = 30, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss over all passages, a few documents at a time; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    n = sum(map(len, bags))
    center = sum(b.sum(0, dtype=float) for b in bags) / n
    scale = np.sqrt(sum(((b - center) ** 2).sum(0) for b in bags) / n) + 0.05
    d = len(center)
    w = {
        "W": rng.normal(0, np.sqrt(2 / d), (d, width)), "b": np.zeros(width), "V": rng.normal(0, width**-0.5, (width, gate)), "U": rng.normal(0, width**-0.5, (width, gate)),
        "a": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, width**-0.5, width), "d": np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)),
    }
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    model, step = Model(center, scale, w), 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x, doc = (np.concatenate([bags[i] for i in chosen]) - center) / scale, np.repeat(np.arange(len(chosen)), [len(bags[i]) for i in chosen])
            grad = model.gradients(x, doc, labels[chosen])
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] * (1 - now * decay) - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_passages: int = MAX_PASSAGES, **fitting) -> Model:
    """Learn from labels.quality of documents outside fold 0, from all passages of each.

    ``max_train`` bounds the documents used and ``max_passages`` the passages of all of them; so features of a
    bounded size reach the driver.  A document with which there would be more passages is left out as a whole.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, ys, flat, n = [], [], [], []
        for key, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b = bag(text)
            ids.append(key)
            ys.append(y)
            n.append(len(b))
            flat.append(b.astype(np.float32).tobytes())
        yield {"doc_id": ids, "label": ys, "n": n, "bag": flat}

    train = training_rows(docs, labels, "quality", max_train).select("doc_id", "text", "label")
    bagged = written(map_rows(train, rows, "doc_id long, label int, n int, bag binary"))
    room, left_out = max_passages, []
    for r in bagged.groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # max_train rows
        if r["n"] <= room:
            room -= r["n"]
        else:
            left_out.append(r["doc_id"])
    found = (bagged.where(~F.col("doc_id").isin(left_out)) if left_out else bagged).toPandas().sort_values(["doc_id", "label", "bag"])
    if not len(found):
        width = WIDTH
        return Model(np.zeros(width), np.ones(width), {"W": np.zeros((width, 1)), "b": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "a": np.zeros(1), "c": np.zeros(1), "d": np.float64(0)})
    bags = [np.frombuffer(b, np.float32).reshape(n, -1) for n, b in zip(found["n"], found["bag"], strict=True)]
    return fit(bags, found["label"].to_numpy(float), **fitting)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row, over all passages of its whole text.

    Null counts as empty, which is one empty passage; repeated rows score alike; no shuffle.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        out: list[float] = []
        part: list[np.ndarray] = []
        size = 0
        for text in batch.column(1):
            part.append(bag(text.as_py()))
            size += len(part[-1])
            if size > AT_ONCE:
                out += model.scores(part).tolist()
                part, size = [], 0
        if part:
            out += model.scores(part).tolist()
        yield {"doc_id": batch.column(0), "score": out}

    return map_rows(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), rows, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **learning) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts are one empty passage; rows with a null id are held out; repeated rows score alike; without
    labels every row scores 0.5; an empty table gives none.
    """
    scored = score(docs, learn(docs, labels, **learning))
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
