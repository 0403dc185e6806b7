import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from seriesmill.llm import bpe
from seriesmill.llm.queries import BPE_RANKS, PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(BPE_RANKS)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    random.seed(1)
    pool = [chr(random.choice((random.randrange(32, 127), random.randrange(0x300), random.randrange(0x300, 0xD7FF), random.randrange(0x1F300, 0x1F6FF)))) for _ in range(3000)]
    return ["".join(random.choice(pool) for _ in range(random.randrange(40))) for _ in range(n)] + ["".join(random.choice("abe ith'sn\n\t12\u0085\x1c\xa0é") for _ in range(random.randrange(60))) for _ in range(n)]


def test_like_the_library(ranks, reference, odd):
    codec = bpe.Codec(ranks, PATTERN)
    texts = [*random_texts(600), *(t or "" for t in odd), "a" * 4000, "the" * 2000, " " * 500, "<|endoftext|>"]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        want = reference.encode_ordinary(text)
        assert ids.tolist() == want and codec.written_out(ids).decode() == ",".join(map(str, want)) and codec.decode(ids) == text.encode()


def test_any_ranks():
    """Vocabularies in which a later merge enables an earlier one."""
    random.seed(2)
    for _ in range(200):
        tokens = {bytes([b]) for b in range(256)}
        known = [b"a", b"b", b"c"]
        for _ in range(12):
            known.append(random.choice(known) + random.choice(known))
        multi = sorted(set(known) - tokens)
        random.shuffle(multi)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(multi)}
        encoding = tiktoken.Encoding("t", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(random.choice("abc") for _ in range(random.randrange(1, 15))) for _ in range(20)]
        replay = bpe.MergeReplay(ranks)
        want = [encoding.encode_ordinary(w) for w in words]
        assert [np.frombuffer(ids, np.int32).tolist() for ids in replay.encode([w.encode() for w in words])] == want
        assert [replay._alone(w.encode()) for w in words] == want


def test_full_memo(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 1000)
    monkeypatch.setattr(bpe, "RUN", 50)
    codec = bpe.Codec(ranks, PATTERN)
    texts = random_texts(200)
    assert [ids.tolist() for ids in codec.encode_batch(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert codec.held < 20_000


def test_table(spark, docs, odd, reference):
    texts = [*odd, "Hello world", "Hello world"]
    rows = {r.doc_id: r for r in bpe.round_trip(docs(texts), BPE_RANKS, PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == want
    encoded = bpe.encode(docs(texts), BPE_RANKS, PATTERN)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, BPE_RANKS, PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.round_trip(docs([]), BPE_RANKS, PATTERN).count() == 0


def test_files_are_checked(tmp_path):
    (tmp_path / "v").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.MergeReplay(bpe.read_ranks(str(tmp_path / "v")))
    assert public_tokenizers.PATTERN == PATTERN
