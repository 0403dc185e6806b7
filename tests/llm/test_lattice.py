import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from seriesmill.llm import lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute(pieces, word):
    text = lattice.SPACE + word

    def paths(i):
        if i == len(text):
            return 1.0
        total = sum(math.exp(pieces.logp[text[i:j]]) * paths(j) for j in range(i + 1, len(text) + 1) if text[i:j] in pieces.logp)
        if text[i] not in pieces.logp:
            total += math.exp(sum(pieces.bytes_[b] for b in text[i].encode())) * paths(i + 1)
        return total

    return math.log(paths(0))


def test_all_segmentations_count():
    random.seed(1)
    inventory = {p: math.log(random.uniform(0.01, 0.2)) for p in ("▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bb", "aba")}
    pieces = lattice.Pieces(inventory, tuple(math.log(0.001) for _ in range(256)), -2.0)
    for word in ("a", "abab", "bbbb", "aébà", "日本"):
        assert pieces.word(word) == pytest.approx(brute(pieces, word))
    assert math.isfinite(pieces.word("ab" * 20_000))


def test_scores(docs, odd):
    random.seed(3)
    words = ["the", "The", "house", "Übung", "ñandú", "zzyzx"]
    texts = [*odd, *(" ".join(random.choice(words) + random.choice(["", "", "s", str(random.randrange(50))]) for _ in range(random.randrange(30))) for _ in range(60))]
    got = {r.doc_id: r for r in lattice.score(docs(texts), MODEL, head=5).collect()}
    split = [(t or "").encode().lower().split() for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    counts, ends = Counter(w for ws, h in zip(split, held) if not h for w in ws), held.count(False)
    total = sum(counts.values()) + ends
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (len(counts) + 2)))
    for i, ws in enumerate(split):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, 1 + sum(w in counts for w in ws), total)
        assert r.base_score == pytest.approx(sum(log(counts[w]) for w in ws) + log(ends))
        assert r.score < 0
    # a text's probability is that of its words and its end
    again = {r.doc_id: r.score for r in lattice.score(docs(texts), MODEL).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()})
    assert got[0].score == got[1].score == got[2].score > got[4].score


def test_pieces_make_a_distribution(docs):
    counts = lattice.count_words(docs(["a house", "the the"]).selectExpr("text", "doc_id = 5 AS held_out"))
    pieces = lattice.estimate_pieces(counts, 2, open(MODEL, "rb").read())
    assert sum(map(math.exp, [*pieces.logp.values(), *pieces.bytes_, pieces.end])) == pytest.approx(1)


def test_nothing(docs):
    assert lattice.score(docs([]), MODEL).count() == 0
    assert lattice.score(docs([None]), MODEL).first().n_tokens == 1
