import hashlib
import random
from collections import defaultdict

import pytest

from seriesmill.llm import exact_dedup as dedup


def test_fingerprints_compose():
    random.seed(1)
    for _ in range(50):
        a, b = random.randbytes(random.randrange(200)), random.randbytes(random.randrange(200))
        whole = int.from_bytes(a + b, "big") % dedup.PRIME
        assert dedup.fingerprint(a + b) == dedup.combine(dedup.fingerprint(a), dedup.fingerprint(b), len(b)) == whole


@pytest.mark.parametrize("settings", [{}, {"prime": 7, "compare_bytes": 3}, {"huge": 4}, {"huge": 3, "prime": 5, "compare_bytes": 2}])
def test_against_a_dictionary(docs, odd, settings):
    random.seed(7)
    texts = [*odd, *odd, *("".join(random.choice("ab\n é") for _ in range(random.randrange(7))) for _ in range(120))]
    table = docs(texts)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup.exact_duplicates(table, **settings).collect()}
    assert got == {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)}


def test_kept_rows(docs):
    table = docs(["a", "b", "a", None, ""], ids=[1, 2, 3, 4, None]).unionByName(docs(["b"], ids=[2]))
    kept = dedup.drop_duplicates(table)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "b"), (3, "a"), (4, None)] and kept.columns == table.columns
    assert dedup.exact_duplicates(docs([])).count() == 0 and dedup.drop_duplicates(docs([])).count() == 0
    assert [r.group_size for r in dedup.exact_duplicates(table).where("doc_id = 2").collect()] == [2, 2]
