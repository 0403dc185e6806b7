"""The pipeline against its stages done in plain Python, on the smallest tables there are."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from seriesmill.llm import bpe, mixing, queries, toxicity

from .test_jaccard import brute

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't there")


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "bpe"]


def test_stage_by_stage(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "labels"))
    matcher = toxicity.Matcher(toxicity.learn(docs, labels))
    rows = {r.doc_id: r for r in docs.collect() if matcher.score(r.text or "") < 0.5}
    assert 0 < len(rows) < docs.count()
    last = {r.text or "": i for i, r in sorted(rows.items())}
    rows = {i: rows[i] for i in last.values()}
    ids = sorted(rows)
    component = [c for _, c in brute([rows[i].text for i in ids], 5, 80)]
    rows = {ids[k]: rows[ids[k]] for k in range(len(ids)) if component[k] == k}
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(list(rows.values()), docs.schema)).collect()}
    encoding = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.read_ranks(queries.BPE_RANKS), special_tokens={})
    want: Counter = Counter()
    for i, n in copies.items():
        if n:
            tokens = encoding.encode_ordinary(rows[i].text or "")
            want[i, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((rows[i].text or "").encode()).hexdigest()] = n
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(DATA)).collect())
    assert got == want


def test_stages_keep_columns_and_take_anything(spark, docs, odd):
    empty = docs([]).select("doc_id", "text", "lang", "source", "n_chars")
    some = docs([*odd, *odd]).select(*empty.columns).unionByName(docs(["a b"], ids=[None]).select(*empty.columns))
    for name, stage in corpus_pipeline.STAGES:
        for table in (empty, some):
            out = stage(spark, table, str(DATA))
            assert name == "bpe" or out.columns == table.columns
            seen = defaultdict(int)
            for r in out.collect():
                seen[r.doc_id] += 1
            assert (not seen) if table is empty else set(seen) <= {r.doc_id for r in some.collect()}
