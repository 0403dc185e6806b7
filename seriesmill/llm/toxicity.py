"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding undoes look-alike letters of other alphabets, full-width and styled forms, invisible characters and
digits or signs set for letters inside words.  Lexicon entries are whole words, or word beginnings where many
words share one; their weights are log odds learned from labelled documents.  A match within an exception
phrase doesn't count.  Weights are summed, also per length, and a logistic curve turns them into a score.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, written
from .labelled import MAX_TRAIN, fold_of, training_rows

#: Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ԍ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x",
    "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
}
#: Signs set for letters inside words; 1 and | also stand for l.
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

#: The share of all distinct words of two texts that near copies have in common.
COPY = 0.8

_GLYPHS = str.maketrans(HOMOGLYPHS)
_AS_I = str.maketrans(SUBSTITUTES)
_AS_L = str.maketrans(SUBSTITUTES | {"1": "l", "|": "l", "!": "l"})
_WORDS = re.compile(r"[^\W_]+(?:[@$!|€][^\W_]+)*|[@$][^\W_]+(?:[@$!|€][^\W_]+)*").findall
_SIGNS = re.compile(r"[^\W\d_][0-9@$!|€]+[^\W\d_]|[0-9@$|€][^\W\d_]|[^\W\d_][0-9$]").search
_INVISIBLE = re.compile("[­​-‏⁠﻿̀-ͯ]")


def fold(text: str) -> list[str]:
    """The words of a text, folded."""
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", unicodedata.normalize("NFC", text))).lower().translate(_GLYPHS)
    else:
        if "­" in text:
            text = text.replace("­", "")
    words = _WORDS(text)
    if _SIGNS(text):
        out = []
        for w in words:
            if w.isalpha() or not any(map(str.isalpha, w)):
                out.append(w)
            else:
                out.append(a := w.translate(_AS_I))
                if (b := w.translate(_AS_L)) != a:
                    out.append(b)
        words = out
    return words


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and of word beginnings, phrases in which they don't count, and the score's curve."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (-3.0, 1.0, 0.0, 0.0)

    def __len__(self) -> int:
        return len(self.words) + len(self.stems) + len(self.exceptions)


class Matcher:
    """Aho-Corasick over a lexicon."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        # entries can coincide (a word that begins another), so each string has a list of (kind, weight, length)
        entries: dict[str, list[tuple[int, float]]] = {}
        for w, weight in lexicon.words.items():
            entries.setdefault(f" {w} ", []).append((0, weight))
        for w, weight in lexicon.stems.items():
            entries.setdefault(f" {w}", []).append((1, weight))
        for phrase in lexicon.exceptions:
            entries.setdefault(f" {phrase} ", []).append((2, 0.0))
        self.machine = ahocorasick.Automaton()
        for text, what in entries.items():
            self.machine.add_word(text, (len(text), what))
        if entries:
            self.machine.make_automaton()

    def matches(self, words: list[str]) -> tuple[str, dict[int, float]]:
        """The joined text; where a counted match's word begins, its largest weight."""
        text = f" {' '.join(words)} "
        found: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        if len(self.machine):
            for end, (length, what) in self.machine.iter(text):
                start = end - length + 1
                for kind, weight in what:
                    if kind == 2:
                        free.append((start, end))
                    else:
                        found[start] = max(weight, found.get(start, 0.0))
        free.sort()
        reach, k = -1, 0  # how far the phrases that begin up to here reach
        for start in sorted(found) if free else ():
            while k < len(free) and free[k][0] <= start:
                reach = max(reach, free[k][1])
                k += 1
            if start < reach:
                del found[start]
        return text, found

    def features(self, text: str) -> tuple[float, float, float]:
        """The strongest weight, the sum's logarithm, and the sum per 100 words (at most 20 of it)."""
        words = fold(text)
        _, found = self.matches(words)
        total = sum(found.values())
        return max(found.values(), default=0.0), float(np.log1p(total)), min(20.0, 100 * total / (len(words) + 20))

    def score(self, text: str) -> float:
        b, *w = self.lexicon.curve
        x = b + sum(a * f for a, f in zip(w, self.features(text), strict=True))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _word_counts(train: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(term, kind, toxic, clean): documents of either label with a word (kind 0) or a beginning of words (kind: its length)."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        count: Counter = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(fold(text))
            count.update((w, 0, label) for w in words)
            count.update({(w[:n], n, label) for w in words for n in lengths if len(w) > n})
        yield {"term": [k[0] for k in count], "kind": [k[1] for k in count], "label": [k[2] for k in count], "n": list(count.values())}

    counted = map_rows(train.select("text", "label"), rows, "term string, kind int, label int, n long")
    return counted.groupBy("term", "kind").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")
    )


def _without_copies(train: DataFrame) -> DataFrame:
    """Rows without near copies, so that those of a text are one witness, not many.

    Rows that agree in label and three least word hashes are compared in the order of their ids: one that shares
    COPY of all distinct words with a row kept before is a near copy.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(1).to_pylist()
        yield {"doc_id": batch.column(0), "text": texts, "label": batch.column(2), "sig": [str(sorted(zlib.crc32(w.encode()) for w in set(fold(t)))[:3]) for t in texts]}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, []
        for batch in (part for whole in batches for part in slices(whole)):
            new = []
            for key, label, text in zip(batch.column("sig").to_pylist(), batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if (key, label) != group:
                    group, kept = (key, label), []
                words = set(fold(text))
                new.append(not any(_near(words, k) for k in kept))
                if new[-1]:
                    kept.append(words)
            yield batch.select(["doc_id", "text", "label"]).filter(pa.array(new, pa.bool_()))

    signed = map_rows(train.select("doc_id", "text", "label"), rows, "doc_id long, text string, label int, sig string")
    ordered = signed.repartition("sig", "label").sortWithinPartitions("sig", "label", "doc_id", "text")
    return ordered.mapInArrow(compared, "doc_id long, text string, label int")


def _near(a: set[str], b: set[str]) -> bool:
    if min(len(a), len(b)) < COPY * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= COPY * (len(a) + len(b) - both)


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_entries: int = 3000, exceptions: tuple[str, ...] = (), lengths: tuple[int, ...] = (4, 5, 6)) -> Lexicon:
    """Learn a lexicon from labels.toxic of documents outside fold 0.

    ``max_train`` bounds the documents used, ``max_entries`` the lexicon; ``exceptions`` are added to the
    learned phrases.  With one class or none in the labels, the lexicon is empty and scores are the base rate.
    """
    train = written(_without_copies(training_rows(docs, labels, "toxic", max_train)))
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    base = float(np.log(rate / (1 - rate)))
    if not n_toxic or not n_clean:
        return Lexicon(curve=(base, 0.0, 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = (
        _word_counts(train, lengths).where("toxic >= 3").withColumn("weight", odds).withColumn("least", odds - error).where("least >= 1.5")
        .orderBy(F.desc(F.col("least") * F.sqrt("toxic")), "term", "kind").limit(max_entries).collect()
    )
    words = {r["term"]: r for r in telling if r["kind"] == 0}
    begins = {r["term"]: r for r in telling if r["kind"] > 0}
    stems: dict[str, float] = {}
    for term in sorted(begins, key=lambda t: (len(t), t)):
        r = begins[term]
        forms = [w for w in words if w.startswith(term)]
        precise = r["clean"] <= 0.02 * r["toxic"] and r["toxic"] >= 6
        # a beginning stands for its words if there are several and none makes up most of it
        if precise and len(forms) >= 3 and max(words[w]["toxic"] for w in forms) < 0.6 * r["toxic"] and not any(term.startswith(s) for s in stems):
            # as long as it stands for (nearly) the same documents, the longer beginning is the safer one
            longer = [t for t in begins if t.startswith(term) and begins[t]["toxic"] >= 0.98 * r["toxic"]]
            term = max(longer, key=lambda t: (len(t), t))
            stems[term] = float(begins[term]["weight"])
    lexicon = Lexicon({w: float(r["weight"]) for w, r in words.items()}, stems)

    # phrases that hold a match in clean documents and in no toxic one are exceptions
    def phrases(batch: pa.RecordBatch) -> Iterator[dict]:
        matcher, count = Matcher(lexicon), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            joined, found = matcher.matches(fold(text))
            seen = set()
            for start in found:
                left = joined.rfind(" ", 0, start) + 1
                end = joined.index(" ", start + 1)
                right = joined.find(" ", end + 1)
                if left < start:
                    seen.add(joined[left:end])
                if right > 0:
                    seen.add(joined[start + 1 : right])
            count.update((p, label) for p in seen)
        yield {"phrase": [k[0] for k in count], "label": [k[1] for k in count], "n": list(count.values())}

    found = map_rows(train.select("text", "label"), phrases, "phrase string, label int, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic")
    )
    learned = [r["phrase"] for r in found.where("clean >= 3 AND toxic = 0").orderBy(F.desc("clean"), "phrase").limit(max_entries).collect()]
    folded = [" ".join(fold(p)) for p in exceptions]
    lexicon = Lexicon(lexicon.words, lexicon.stems, tuple(dict.fromkeys([*folded, *learned])))

    def measured(batch: pa.RecordBatch) -> Iterator[dict]:
        matcher = Matcher(lexicon)
        got = [matcher.features(t) for t in batch.column(0).to_pylist()]
        yield {"label": batch.column(1), **{f"f{k}": [g[k] for g in got] for k in range(3)}}

    sample = map_rows(train.select("text", "label"), measured, "label int, f0 double, f1 double, f2 double").toPandas()  # max_train rows of four numbers
    return Lexicon(lexicon.words, lexicon.stems, lexicon.exceptions, _logistic(sample[["f0", "f1", "f2"]].to_numpy(), sample["label"].to_numpy()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method, weights kept at 0 or above: more matches never lower a score."""
    order = np.lexsort((*x.T, y))
    x, y = np.column_stack([np.ones(len(x)), x])[order], y[order].astype(float)
    free = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, free] @ w[free], -30, 30)))
            penalty = np.where(np.arange(free.sum()) == 0, 1e-3, ridge)
            step = np.linalg.solve((x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + np.diag(penalty), x[:, free].T @ (y - p) - penalty * w[free])
            w[free] += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            return tuple(float(v) for v in w)
        free[1:] &= w[1:] >= 0


def score_column(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text column; the other columns of a table pass it by.  Null and empty texts have no match."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        matcher = state.get("matcher") or state.setdefault("matcher", Matcher(lexicon))
        return pd.Series([matcher.score(t or "") for t in texts], dtype="float64")

    state: dict = {}
    return scored(text)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row, over its whole text.

    Null and empty texts have no match and score as such; repeated rows score alike; an empty table gives none.
    No shuffle.  The lexicon travels with the function; ``learn`` bounds its size.
    """
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), score_column(lexicon, F.col(f"`{text_col}`")).alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **learning) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; see ``classify`` for odd rows."""
    lexicon = learn(docs, labels, **learning)
    return docs.withColumn("__score", score_column(lexicon, F.col(f"`{text_col}`"))).where(F.col("__score") < threshold).drop("__score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **learning) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts have no match and get the score of a text without one; rows with a null id are held out;
    repeated rows score alike; without labels of both classes all rows get the base rate; an empty table gives none.
    """
    scored = score(docs, learn(docs, labels, **learning))
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
