"""N-gram Jaccard join: links between documents whose sets of word shingles are similar, and their components.

The product of the sparse document-by-shingle matrix with its transpose holds the overlap of every pair.  It is
never formed whole.  (1) Equal sets are one row.  (2) Of each row only a prefix is indexed: with its shingles in
a fixed order, rare ones first, two rows whose overlap reaches the bound that follows from their sizes share k
of the first n - ceil(t * n) + k.  (3) Columns with one entry go.  (4) In columns of few entries the pairs that
pass the size bound are listed and their overlaps added up; pairs with k or more of them are counted against the
whole rows.  (5) Columns of many entries
(clusters of near copies) are cut into blocks; a block pair is multiplied within one task, row by row, which
keeps links only where they join two components, so that a cluster of m rows sends back fewer than m links
and most of its rows need no product at all.  Components are exact: every linked pair is linked in the result,
directly or through others.

The order is (count, hash), where count is known for the frequent shingles only: those that repeat within
a task's documents, summed over the corpus, up to ``hot_entries`` of the most frequent.  That table has a fixed
size bound and is broadcast.  Any order gives the same links; a good one makes few candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, written
from .exact_dedup import one_row_per_id
from .graph import components

#: Shingles with a known count, at most: 8 MB to each executor.
HOT_ENTRIES = 500_000
#: Columns of up to so many entries list their pairs.
LISTED = 128
#: Rows of a block of a longer column.
BLOCK = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_PLACE = _mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(_BASE)
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and begin of every word (between ASCII white space, A-Z lower-cased) of a few MB."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    begins, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(begins):
        return np.empty(0, np.uint64), begins
    lengths = ends - begins
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    values = _BYTE[_LOWER[raw[inside]]] * _powers(int(lengths.max()))[place]
    return _mixed(np.add.reduceat(values, starts) + lengths.astype(np.uint64)), begins


def _runs(texts: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about ``most`` bytes."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, k
            start, size = k, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def _words_of(text: bytes, window: int = 1 << 22) -> np.ndarray:
    """Word hashes of one long text, by windows that end at white space."""
    out, at = [], 0
    while at < len(text):
        end = at + window
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text; with fewer words one for the whole; none without words."""
    data = [(t or "").encode() for t in texts]
    for i, j in _runs(data):
        if j - i == 1:
            hashes = _words_of(data[i])
            cuts = [0, len(hashes)]
        else:
            hashes, begins = word_hashes(b" ".join(data[i:j]))
            offsets = np.cumsum([0] + [len(d) + 1 for d in data[i:j]])
            cuts = np.searchsorted(begins, offsets).tolist()
        if len(hashes) >= words:
            n = len(hashes) - words + 1
            sums = np.zeros(n, np.uint64)
            for k in range(words):
                sums += hashes[k : k + n] * _PLACE[k]
            all_shingles = _mixed(sums).view(np.int64)
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= words:
                yield np.unique(all_shingles[a : b - words + 1])
            elif b > a:
                whole = np.add.reduce(hashes[a:b] * _PLACE[: b - a], dtype=np.uint64) + np.uint64(b - a)
                yield _mixed(np.array([whole], np.uint64)).view(np.int64)
            else:
                yield np.empty(0, np.int64)


#: Shared shingles of their prefixes that a pair must have to be looked at (fewer for rows that can't share so many).
SHARED = 4


def prefix_length(n: int, percent: int, shared: int = SHARED) -> int:
    """Of two rows that link, the first so many shingles have min(shared, least overlap) in common."""
    overlap = -(-n * percent // 100)
    return n - overlap + min(shared, overlap)


def _digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def frequent_shingles(docs: DataFrame, words: int, most: int = HOT_ENTRIES, repeats: int = 3, held: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in different texts of a task, with the sum of those counts: sorted hashes, counts.

    ``held``: shingles that a task holds before it counts them.  If more than ``most`` repeat, the count from
    which they fit is found from a histogram of counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[n >= repeats]), pa.array(n[n >= repeats].astype(np.int64))], names=["token", "n"])

        sets, seen, size = [], set(), 0
        for batch in (part for whole in batches for part in slices(whole)):
            for s in shingle_sets(batch.column(0).to_pylist(), words):
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    sets.append(s)
                    size += len(s)
                if size >= held:
                    yield counted(sets)
                    sets, seen, size = [], set(), 0
        if sets:
            yield counted(sets)

    tokens = written(docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    levels = sorted(((r["level"], r["count"]) for r in tokens.groupBy(F.floor(F.log2("n") * 4).alias("level")).count().collect()), reverse=True)
    least, total = None, 0
    for level, k in levels:
        if (total := total + k) > most:
            break
        least = level
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    table = tokens.where(F.floor(F.log2("n") * 4) >= least).toPandas().sort_values("token")
    return table["token"].to_numpy(np.int64), table["n"].to_numpy(np.int64)


def _first_rare(shingles: np.ndarray, length: int, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``length`` shingles by (known count or 0, hash)."""
    if not len(hot):
        return shingles[:length]
    at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
    known = hot[at] == shingles
    rare = shingles[~known]
    if len(rare) >= length:
        return rare[:length]
    often, n = shingles[known], counts[at[known]]
    return np.concatenate([rare, often[np.lexsort((often, n))][: length - len(rare)]])


def block_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all components of the rows of one block, by the sparse product of those rows.

    A row is multiplied only while it stands outside the largest component: of any two rows that end in
    different components, one at least was then compared with the other.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(column, kind="stable")
    rows_of = row[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(column, minlength=len(values)))))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    label = np.arange(m)
    done = np.zeros(m, bool)
    links = []
    while True:
        largest = np.bincount(label, minlength=m).argmax()
        todo = np.nonzero(~done & (label != largest))[0]
        if not len(todo):
            return links
        i = todo[0]
        done[i] = True
        columns = column[starts[i] : starts[i + 1]]
        columns = columns[bounds[columns + 1] - bounds[columns] > 1]
        if not len(columns):
            continue
        overlap = np.bincount(np.concatenate([rows_of[bounds[c] : bounds[c + 1]] for c in columns]), minlength=m)
        near = np.nonzero(100 * overlap >= percent * (sizes[i] + sizes - overlap))[0]
        for j in near:
            if label[j] != label[i]:
                links.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]


def classes(docs: DataFrame, words: int, percent: int, hot_entries: int = HOT_ENTRIES, listed: int = LISTED, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, copies of its set.

    Two documents link when 100 * |A & B| >= percent * |A | B|; component_id is the least doc_id reachable.  A text
    without words (null, empty, white space) has no shingles and links with nothing.  Rows with a null id are
    counted with their class, but a class of null ids only stays alone, with a null component.  Repeated rows
    are one class.  An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words, hot_entries))

    def indexed(batch: pa.RecordBatch) -> Iterator[dict]:
        sizes, prints, prefixes = [], [], []
        for s in shingle_sets(batch.column(1).to_pylist(), words):
            sizes.append(len(s))
            prints.append(_digest(s))
            prefixes.append(_first_rare(s, prefix_length(len(s), percent), *hot.value) if len(s) else s)
        yield {"doc_id": batch.column(0), "n": sizes, "fp": prints, "prefix": prefixes}

    base = written(map_rows(docs, indexed, "doc_id long, n long, fp binary, prefix array<long>"))
    hot.destroy()
    rows = written(
        base.where("n > 0").groupBy("fp").agg(F.min_by(F.struct("n", "prefix"), "doc_id").alias("r"), F.min("doc_id").alias("node"), F.count("*").alias("copies"))
        .select("fp", "node", "copies", "r.n", "r.prefix")
    )
    entries = rows.where("node IS NOT NULL").select("node", "n", F.explode("prefix").alias("token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("entries")).where("entries > 1")
    entries = written(entries.join(shared, "token"))

    few = entries.where(F.col("entries") <= listed)
    a, b = few.select("token", F.col("node").alias("a"), F.col("n").alias("na")), few.select("token", F.col("node").alias("b"), F.col("n").alias("nb"))
    smaller, larger = F.least("na", "nb"), F.greatest("na", "nb")
    met = a.join(b, "token").where((F.col("a") < F.col("b")) & (smaller * 100 >= larger * percent))
    bound = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))
    pairs = written(met.groupBy("a", "b").agg(F.count("*").alias("both"), F.first(smaller).alias("n")).where(F.col("both") >= bound).select("a", "b"))
    many = entries.where(F.col("entries") > listed)

    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(many.select("node")).distinct()
    needed = rows.select("node", "fp").join(needed, "node")

    def whole(batch: pa.RecordBatch) -> Iterator[dict]:
        nodes, sets = [], []
        wanted = batch.column(2).to_pylist()
        for node, fp, s in zip(batch.column(0).to_pylist(), wanted, shingle_sets(batch.column(1).to_pylist(), words), strict=True):
            if _digest(s) == fp:
                nodes.append(node)
                sets.append(s.tobytes())
        yield {"node": nodes, "shingles": sets}

    texts = docs.join(needed, docs["doc_id"] == needed["node"]).select("node", "text", "fp")
    sets = written(map_rows(texts, whole, "node long, shingles binary"))  # a repeated row gives a repeated set, which links alike

    def counted(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out["a"].append(a)
                out["b"].append(b)
        yield out

    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    links = map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), counted, "a long, b long")

    blocks = F.ceil(F.col("entries") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks)
    cells = many.select("token", "node", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = cells.select("token", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def multiplied(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("node")
        return pd.DataFrame(block_links(cell["node"].to_numpy(), [np.frombuffer(s, np.int64) for s in cell["shingles"]], percent), columns=["a", "b"]).astype("int64")

    dense = cells.join(sets, "node").groupBy("token", "i", "j").applyInPandas(multiplied, "a long, b long")
    found = components(links.unionByName(dense))
    named = written(rows.select("fp", "node", "copies").join(found, "node", "left").select("fp", "copies", F.coalesce("component", "node").alias("component")))
    alone = F.col("n") == 0
    return base.join(named, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("copies")).alias("copies"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the least id.

    Rows with a null id stay; texts without words stay, as they link with nothing; of repeated rows one stays.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = written(classes(rows, words, percent, **settings))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    left = docs.join(gone, F.col(f"`{id_col}`") == F.col("__id"), "left_anti")
    twice = found.where("doc_id = component_id AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return one_row_per_id(left, twice, id_col, text_col)


#: classes(documents, 3, 90) by joining all shingles.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS x FROM w
), e AS (
  SELECT doc_id, len(x) AS n, unnest(x) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p WHERE 100 * shared >= 90 * (na + nb - shared)
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM s
  UNION
  SELECT node, CASE WHEN reached = a THEN b ELSE a END FROM r JOIN l ON reached = a OR reached = b
), c AS (
  SELECT node, min(reached) AS component_id FROM r GROUP BY node
)
SELECT doc_id, len(x)::BIGINT AS n_shingles, component_id FROM s JOIN c ON doc_id = node
"""
