"""Language-model scores by subword lattice likelihood.

The vocabulary is that of an existing tokenizer file; it isn't changed.  Piece scores are log probabilities
estimated on the training fold: all its words, counted over the whole corpus, are segmented once by the
tokenizer, and the pieces counted with their words.  A text is the pieces of its words (each word begins
with the space mark) and one end; its probability sums over all segmentations, by a forward recursion in log
space.  Pieces hold the space mark at their beginning only, so the lattice of a text falls apart into those of
its words: every distinct word of the corpus is scored once, in a table of words with their counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, most_frequent, written
from .labelled import fold_of

SPACE = "▁"
#: Words whose counts and scores are sent to executors, at most; those of others meet their tokens in a join.
HEAD = 200_000
#: Different words that a task counts at a time.
HELD = 400_000


def words_of(text: str | None) -> list[bytes]:
    """Tokens but for the end: A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode().lower().split()


@dataclass(frozen=True)
class Pieces:
    """Log probabilities of pieces, of single bytes (for characters that no piece has), and of the end."""

    logp: dict[str, float]
    bytes_: tuple[float, ...]
    end: float

    def __post_init__(self):
        # what a walk along the lattice looks up: the beginnings of pieces, with their score where one ends
        steps: dict[str, float | None] = {}
        for piece in self.logp:
            for k in range(1, len(piece)):
                steps.setdefault(piece[:k], None)
        object.__setattr__(self, "steps", steps | self.logp)

    def word(self, word: str) -> float:
        """Natural log of the probability of a word, over all its segmentations."""
        text = SPACE + word
        n = len(text)
        steps, single, exp, log = self.steps, self.logp, math.exp, math.log
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        forward = 0.0
        for i in range(n):
            if i:
                into = terms[i]
                top = max(into)
                forward = top if len(into) == 1 else top + log(sum([exp(t - top) for t in into]))
            for j in range(i + 1, n + 1):
                p = steps.get(text[i:j], 0.0)
                if p is None:
                    continue
                if p == 0.0:  # no piece begins like this
                    break
                terms[j].append(forward + p)
            if text[i] not in single:
                terms[i + 1].append(forward + sum(self.bytes_[b] for b in text[i].encode("utf-8", "surrogatepass")))
        top = max(terms[n])
        return top + log(sum([exp(t - top) for t in terms[n]]))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; n counts rows that aren't held out.  Columns: text, held_out.

    Each task adds up its own words first, HELD different ones at a time.  Null and empty texts have no words;
    repeated rows count each; a word of held-out rows only has n = 0; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        known: Counter = Counter()

        def out() -> pa.RecordBatch:
            for word in seen:
                known.setdefault(word, 0)
            batch = pa.RecordBatch.from_arrays([pa.array(list(known), pa.binary()).cast(pa.string()), pa.array(list(known.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            known.clear()
            return batch

        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (seen if held else known).update(words_of(text.as_py()))
                if len(known) + len(seen) > HELD:
                    yield out()
        if known or seen:
            yield out()

    return docs.select("text", "held_out").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def estimate_pieces(counts: DataFrame, n_ends: int, model: bytes, smoothing: float = 0.1) -> Pieces:
    """Piece probabilities from a table of word counts; what reaches the driver is one row for each piece."""
    import sentencepiece

    def segment(batch: pa.RecordBatch) -> Iterator[dict]:
        codec = sentencepiece.SentencePieceProcessor(model_proto=model)
        total: Counter = Counter()
        for ids, n in zip(codec.encode(batch.column(0).to_pylist(), num_threads=1), batch.column(1).to_pylist(), strict=True):
            for x in ids:
                total[x] += n
        yield {"piece": list(total), "n": list(total.values())}

    codec = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = {r["piece"]: r["n"] for r in map_rows(counts.select("word", "n"), segment, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    usable = [i for i in range(codec.get_piece_size()) if not codec.is_control(i) and not codec.is_unknown(i) and not codec.is_unused(i)]
    n = {i: found.get(i, 0) for i in usable}
    whole = math.log(sum(n.values()) + n_ends + smoothing * (len(usable) + 1))
    logp = {codec.id_to_piece(i): math.log(n[i] + smoothing) - whole for i in usable}
    in_bytes = tuple(logp.get(f"<0x{b:02X}>", math.log(smoothing) - whole) for b in range(256))
    return Pieces({codec.id_to_piece(i): logp[codec.id_to_piece(i)] for i in usable if not codec.is_byte(i)}, in_bytes, math.log(n_ends + smoothing) - whole)


def score(docs: DataFrame, model_path: str, held_fold: int = 1, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Learns from rows outside ``held_fold``.  Null text counts as empty: the end is its one token.  Null ids are in
    fold 0, thus training rows unless that is held out.  Repeated rows count and score as rows of their own.  With
    no training rows nothing is known and piece scores are uniform.  An empty table gives no rows.
    """
    if folds <= held_fold:
        raise ValueError("held_fold must be one of the folds")
    with open(model_path, "rb") as file:
        model = file.read()
    if len(model) > 64 << 20:
        raise ValueError(f"{model_path} has {len(model)} bytes; a vocabulary of at most 64 MB is sent to executors")
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), (fold_of(F.col(f"`{id_col}`"), folds) == held_fold).alias("held_out"))
    counts = written(count_words(docs))
    ends = docs.where(~F.col("held_out")).count()
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    total, types = size["n"] + ends, size["v"] + (ends > 0)
    denominator = total + 0.5 * (types + 1)
    pieces = estimate_pieces(counts.where("n > 0"), ends, model)

    def weighed(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"word": batch.column(0), "n": batch.column(1), "logp": [pieces.word(w) for w in batch.column(0).to_pylist()]}

    words = written(map_rows(counts, weighed, "word string, n long, logp double"))
    known = {r["word"].encode(): (r["n"], r["logp"]) for r in most_frequent(words.where("n > 0"), "n", head).collect()}  # ``head`` rows at most
    sent = docs.sparkSession.sparkContext.broadcast(known)
    base_end = math.log10((ends + 0.5) / denominator)

    def scored(batch: pa.RecordBatch) -> Iterator[dict]:
        known = sent.value
        names = ("n_tokens", "n_known", "base_score", "score", "rest", "rest_n")
        out: dict[str, list] = {name: [] for name in names}
        for text in batch.column(1):
            counted = Counter(words_of(text.as_py()))
            base, sure, logp, rest, rest_n = base_end, int(ends > 0), pieces.end, [], []
            for word, n in counted.items():
                found = known.get(word)
                if found is None:
                    rest.append(word.decode())
                    rest_n.append(n)
                else:
                    base += n * math.log10((found[0] + 0.5) / denominator)
                    logp += n * found[1]
                    sure += n
            for name, value in zip(names, (sum(counted.values()) + 1, sure, base, logp / math.log(10), rest, rest_n), strict=True):
                out[name].append(value)
        yield {"doc_id": batch.column(0), "held_out": batch.column(2)} | out

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<string>, rest_n array<long>"
    # written, so that a row keeps its number when it is read twice
    rows = written(map_rows(docs, scored, schema).withColumn("row", F.monotonically_increasing_id()))
    sent.destroy()
    rare = rows.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("row", F.col("r.rest").alias("word"), F.col("r.rest_n").alias("k"))
    met = rare.join(words, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10((F.col("n") + 0.5) / F.lit(denominator))).alias("more_base"),
        F.sum(F.col("k") * F.col("logp")).alias("more_logp"),
    )
    return rows.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_logp", F.lit(0.0)) / F.lit(math.log(10))).alias("score"),
    )
