"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a run of texts form one small corpus.  An inverted index leads from each token pair
(named by the rank of its merge) to the positions where it stands.  Merges are replayed from the index in rank
order, over all words together, and each merge touches only its two neighbouring pairs.  Words don't interact, so
rank order is kept where it matters, within each word: a turn takes from the index every word's entries of lowest
rank.  Results are those of a word-by-word encoder.  Encoded pre-tokens are kept in a memo of bounded bytes, so a
frequent word is merged once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows

#: Bytes, about, of a worker's memo of encoded pre-tokens; it starts anew when full.
MEMO = 48 << 20
#: Bytes, about, that an entry takes besides its word and ids.
ENTRY = 200
#: Characters of the texts whose pre-tokens are in memory at a time (a longer text is alone).
RUN = 1 << 20
#: Words of more bytes are replayed one merge at a time, so that a very long one costs n log n.
SHORT = 48
#: The rank of a pair that has no merge.
NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a vocabulary file: one base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes word lists by replaying the merges of ``ranks`` over all words together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if self.single.min() < 0:
            raise ValueError("the vocabulary lacks a single byte")
        #: Rank of the merge of two bytes.
        self.first = np.array([[ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], dtype=np.int32)
        # all pairs of tokens that merge, in order of (left, right), with the rank of each
        pairs = sorted((left << 32 | right, rank) for token, rank in ranks.items() for left, right in self._halves(token))
        self.pairs = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.merges = np.array([rank for _, rank in pairs] + [NONE], np.int32)

    def _halves(self, token: bytes) -> Iterator[tuple[int, int]]:
        for k in range(1, len(token)):
            if token[:k] in self.ranks and token[k:] in self.ranks:
                yield self.ranks[token[:k]], self.ranks[token[k:]]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each two tokens, or NONE."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.merges[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as int32 bytes."""
        out = self._together([w if len(w) <= SHORT else b"" for w in words])
        for k, word in enumerate(words):
            if word and not out[k]:
                out[k] = np.array(self._alone(word), np.int32).tobytes()
        return out

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Replay over all words; nothing for a word in which a merge gives rise to one of lower rank."""
        text = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        token = self.single[text]
        rank = np.full(len(text), NONE, np.int32)  # of the pair that begins at each position
        inside = np.nonzero(word[1:] == word[:-1])[0]
        rank[inside] = self.first[text[inside], text[inside + 1]]
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            starts = np.nonzero(np.diff(word, prepend=-1))[0]
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(token))
            open_ = np.repeat(lowest < NONE, sizes)
            if not open_.all():
                ended.append((word[~open_], token[~open_]))
                word, token, rank = word[open_], token[open_], rank[open_]
                sizes, lowest = sizes[lowest < NONE], lowest[lowest < NONE]
                if not len(token):
                    break
            # the index entries of each word's lowest rank; of overlapping ones the first, third, ...
            at = np.nonzero(rank == np.repeat(lowest, sizes))[0]
            row = np.arange(len(at))
            begins = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, row, 0))
            at = at[(row - begins) % 2 == 0]
            new = rank[at]
            # what stands to the right of a merged pair before the next one merges
            then = np.minimum(at + 2, len(token) - 1)
            right = np.where((at + 2 < len(token)) & (word[then] == word[at]), self.rank_of(new, token[then]), NONE)
            token[at] = new
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            word, token, rank = word[keep], token[keep], rank[keep]
            at = at - np.arange(len(at))
            # only pairs with the new token have another rank now
            after = np.minimum(at + 1, len(token) - 1)
            rank[at] = np.where((after > at) & (word[after] == word[at]), self.rank_of(token[at], token[after]), NONE)
            ahead = np.maximum(at - 1, 0)
            left = np.where((ahead < at) & (word[ahead] == word[at]), self.rank_of(token[ahead], token[at]), NONE)
            rank[ahead[ahead < at]] = np.where(word[ahead] == word[at], left, rank[ahead])[ahead < at]
            lower = np.minimum(np.minimum(right, left), rank[at]) < new
            if lower.any():
                keep = ~np.isin(word, word[at[lower]])
                word, token, rank = word[keep], token[keep], rank[keep]
        word, token = (np.concatenate([e[k] for e in ended]) if ended else np.empty(0, np.int32) for k in (0, 1))
        bounds = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words))))) * 4
        flat = token[np.argsort(word, kind="stable")].astype(np.int32).tobytes()
        return [flat[i:j] for i, j in zip(bounds.tolist(), bounds[1:].tolist())]

    def _alone(self, word: bytes) -> list[int]:
        """One word by the same index, merge by merge; a merge of lower rank that arises goes first."""
        ranks, tokens = self.ranks, self.tokens
        token = self.single[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(token)), -1]
        before = list(range(-1, len(token) - 1))
        heap = [(int(r), k) for k, r in enumerate(self.first[list(word[:-1]), list(word[1:])]) if r < NONE]
        heap.sort()
        while heap:
            rank, at = heappop(heap)
            beyond = after[at]
            if token[at] < 0 or beyond < 0 or tokens[token[at]] + tokens[token[beyond]] != tokens[rank]:
                continue  # a neighbour has changed since
            token[at], token[beyond] = rank, -1
            after[at] = beyond = after[beyond]
            if beyond >= 0:
                before[beyond] = at
                if (new := ranks.get(tokens[rank] + tokens[token[beyond]])) is not None:
                    heappush(heap, (new, at))
            if (ahead := before[at]) >= 0 and (new := ranks.get(tokens[token[ahead]] + tokens[rank])) is not None:
                heappush(heap, (new, ahead))
        return [t for t in token if t >= 0]


def latin_pattern(pattern: str) -> str | None:
    """The pattern with its Unicode classes spelled out for characters below 256, for the faster standard engine.

    None if it has escapes other than \\p{L}, \\p{N}, \\s and \\S.
    """
    import regex

    def ranges(escape: str) -> str:
        chars = [c for c in range(256) if regex.fullmatch(escape, chr(c))]
        begins = [c for c in chars if c - 1 not in chars]
        ends = [c for c in chars if c + 1 not in chars]
        return "".join(f"\\x{a:02x}-\\x{b:02x}" for a, b in zip(begins, ends, strict=True))

    out, inside, at = [], False, 0
    while at < len(pattern):
        if pattern[at] == "\\":
            m = re.compile(r"\\p\{[LN]\}|\\[sS]").match(pattern, at)
            if not m or inside and m.group() == r"\S":
                return None
            chars = ranges(m.group().lower() if m.group() == r"\S" else m.group())
            out.append(chars if inside else f"[^{chars}]" if m.group() == r"\S" else f"[{chars}]")
            at = m.end()
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    return "".join(out)


class Spelling:
    """Texts of token ids by gathering from one array of bytes; the ids are 0 and up, not much more than the texts."""

    def __init__(self, texts: dict[int, bytes]):
        self.lengths = np.zeros(max(texts) + 1, np.int64)
        for k, text in texts.items():
            self.lengths[k] = len(text)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(texts[k] for k in sorted(texts)), np.uint8)

    def join(self, ids: np.ndarray, at_once: int = 1 << 18) -> bytes:
        if len(ids) > at_once:
            return b"".join(self.join(ids[k : k + at_once]) for k in range(0, len(ids), at_once))
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.letters[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Codec:
    """Encodes and decodes texts with a vocabulary; one per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.replay = MergeReplay(ranks)
        self.split_any = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.split_latin = re.compile(latin).findall if latin else self.split_any
        #: Words that are tokens need no merges.
        self.whole = {token.decode(): np.int32(rank).tobytes() for token, rank in ranks.items() if _is_text(token)}
        self.memo: dict[str, bytes] = dict(self.whole)
        self.held = 0
        self.token_bytes = Spelling(self.replay.tokens)
        self.decimals = Spelling({rank: b"%d," % rank for rank in self.replay.tokens})

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text.

        Texts are taken in runs of bounded size, so that the split words of one run are in memory at a time.
        """
        run: list[list[str]] = []
        size = 0
        for text in texts:
            run.append(self.split(text))
            size += len(text)
            if size > RUN:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, split: list[list[str]]) -> Iterator[np.ndarray]:
        if self.held > MEMO:
            self.memo, self.held = dict(self.whole), 0
        memo = self.memo
        new = set()
        for words in split:
            new.update(filterfalse(memo.__contains__, words))
        data = list(map(str.encode, new))
        memo.update(zip(new, self.replay.encode(data), strict=True))
        self.held += ENTRY * len(data) + 2 * sum(map(len, data))
        for words in split:
            yield np.frombuffer(b"".join(map(memo.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes.join(ids)

    def written_out(self, ids: np.ndarray) -> bytes:
        """The ids, decimal, joined by commas."""
        return self.decimals.join(ids)[:-1]


#: The last codec of a worker, whose memo serves its later tasks.
_KEPT: dict[tuple, Codec] = {}


def _share(spark: SparkSession, ranks_path: str, pattern: str):
    """The vocabulary, read by the driver and sent to the executors; a file of fixed size, checked here."""
    ranks = read_ranks(ranks_path)
    if len(ranks) > 1_000_000:
        raise ValueError(f"{ranks_path} has {len(ranks)} tokens; a vocabulary of at most 1,000,000 is sent to executors")
    return spark.sparkContext.broadcast((ranks, pattern))


def _with_codec(df: DataFrame, ranks_path: str, pattern: str, fn, schema: str) -> DataFrame:
    sent = _share(df.sparkSession, ranks_path, pattern)
    name = (ranks_path, pattern, df.sparkSession.sparkContext.applicationId, sent._jbroadcast.id())

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = Codec(*sent.value)
        yield from fn(_KEPT[name], batch)

    return map_rows(df, rows, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>) for every row of ``df``.  Null text encodes as empty; other columns don't matter."""

    def rows(codec: Codec, batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        keys = batch.column(0)
        for k, ids in enumerate(codec.encode_batch(texts)):
            yield {"doc_id": keys.slice(k, 1), "ids": [ids.tolist()]}

    return _with_codec(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), ranks_path, pattern, rows, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, decoded binary): the exact bytes behind token ids.  Null ids decode as empty."""

    def rows(codec: Codec, batch: pa.RecordBatch) -> Iterator[dict]:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield {"doc_id": [key], "decoded": [codec.decode(np.array(ids or [], np.int64))]}

    return _with_codec(df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids"), ranks_path, pattern, rows, "doc_id long, decoded binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (no tokens, digests of nothing); a null id stays null; repeated rows give
    repeated results; an empty table gives none.  No shuffle: each task encodes the rows it reads.
    """

    def rows(codec: Codec, batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n, ids_hash, decoded_hash = [], [], []
        for ids in codec.encode_batch(texts):
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(codec.written_out(ids)).hexdigest())
            decoded_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        yield {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": decoded_hash}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _with_codec(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), ranks_path, pattern, rows, schema)
