"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are the digits of a number in base 256; its fingerprint is that number modulo a prime of
120 bits, with the length beside it.  Fingerprints of neighbouring chunks combine by length-shifted arithmetic,
H(AB) = H(A) * 256**len(B) + H(B), so the chunks of a huge text are hashed by different tasks and put together.
Rows of equal fingerprint and length are then compared chunk by chunk, and only rows whose bytes agree
count as equal: a fingerprint collision costs time, never a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty, written

#: The largest prime below 2**120.
PRIME = 2**120 - 119
#: Bytes hashed at a time.
CHUNK = 1 << 16
#: Texts of more bytes than this are cut into pieces of this size, which are hashed as rows of their own.
HUGE = 1 << 24


def fingerprint(data: bytes, prime: int = PRIME) -> int:
    """H(data), chunk by chunk."""
    value = 0
    for at in range(0, len(data), CHUNK):
        chunk = data[at : at + CHUNK]
        value = combine(value, int.from_bytes(chunk, "big") % prime, len(chunk), prime)
    return value


def combine(left: int, right: int, right_length: int, prime: int = PRIME) -> int:
    """H(AB) from H(A), H(B) and the length of B."""
    return (left * pow(256, right_length, prime) + right) % prime


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prime: int = PRIME, huge: int = HUGE) -> DataFrame:
    """doc_id, fp (hex), n_bytes, text_sha256 of every row; null text counts as empty."""
    data = F.encode(text_or_empty(F.col(f"`{text_col}`")), "utf-8")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), data.alias("data"))

    def whole(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(1).to_pylist()
        yield {
            "doc_id": batch.column(0),
            "fp": [f"{fingerprint(t, prime):030x}" for t in texts],
            "n_bytes": [len(t) for t in texts],
            "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
        }

    small = map_rows(rows.where(F.octet_length("data") <= huge), whole, "doc_id long, fp string, n_bytes long, text_sha256 string")

    def piece(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(3).to_pylist()
        yield {
            **{name: batch.column(k) for k, name in enumerate(("doc_id", "row", "part"))},
            "fp": [f"{fingerprint(t, prime):030x}" for t in texts],
            "n_bytes": [len(t) for t in texts],
        }

    def joined(batch: pa.RecordBatch) -> Iterator[dict]:
        fps, sizes = [], []
        for parts in batch.column(1).to_pylist():
            value = 0
            for p in parts:
                value = combine(value, int(p["fp"], 16), p["n_bytes"], prime)
            fps.append(f"{value:030x}")
            sizes.append(sum(p["n_bytes"] for p in parts))
        yield {"doc_id": batch.column(0), "fp": fps, "n_bytes": sizes, "text_sha256": batch.column(2)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one piece at a time: a text is never held more than once, nor copied for each of its pieces
        for batch in batches:
            for k in range(batch.num_rows):
                data = memoryview(batch.column(2)[k].as_buffer())
                for part, at in enumerate(range(0, len(data), huge)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([part], pa.int32()), pa.array([bytes(data[at : at + huge])], pa.binary())], names=["doc_id", "row", "part", "data"])

    long = rows.where(F.octet_length("data") > huge).select("doc_id", F.sha2("data", 256).alias("row"), "data")
    parts = long.mapInArrow(cut, "doc_id long, row string, part int, data binary")
    hashed = map_rows(parts.repartition(F.col("row"), F.col("part")), piece, "doc_id long, row string, part int, fp string, n_bytes long")
    # one list per huge text, as long as its pieces are many; equal rows of one id share a list
    lists = hashed.dropDuplicates(["doc_id", "row", "part"]).groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("part", "fp", "n_bytes"))).alias("parts"))
    again = long.groupBy("doc_id", "row").count()
    lists = lists.join(again, (lists["doc_id"].eqNullSafe(again["doc_id"])) & (lists["row"] == again["row"])).select(
        lists["doc_id"], "parts", lists["row"], F.explode(F.expr("sequence(1L, count)")).alias("__n")
    )
    return small.unionByName(map_rows(lists.select("doc_id", "parts", "row"), joined, "doc_id long, fp string, n_bytes long, text_sha256 string"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prime: int = PRIME, huge: int = HUGE, compare_bytes: int = 1 << 16) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id (largest id among equal texts), group_size (rows), kept, text_sha256.

    Null text equals empty text; texts differ by any byte.  Rows that repeat an id with the same text are
    all part of the group and all marked kept if that id is kept; a null id never wins over another and an
    all-null group keeps its rows with a null keep_id.  An empty table gives no rows.
    """
    prints = written(fingerprints(df, id_col, text_col, prime, huge))
    # written, so that joins read it through a plain exchange and can split the rows of a large group
    groups = written(prints.groupBy("fp", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    shared = groups.where("group_size > 1 AND n_bytes > 0").select("fp", "n_bytes")
    # dealt by id before the distinct, which else would keep the rows of a large group together
    suspects = prints.join(shared, ["fp", "n_bytes"]).select("doc_id", "fp", "n_bytes").repartition("doc_id").distinct()
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    texts = texts.join(suspects, texts["doc_id"].eqNullSafe(suspects["doc_id"]) & (F.octet_length("text") == suspects["n_bytes"])).select(texts["doc_id"], "text", "fp", "n_bytes")
    # streaming comparison: for each place in a group's texts, one pass keeps the least and the greatest chunk
    # bytes, as a piece of them is found at once, and one of characters by counting from the beginning
    pieces = f"transform(sequence(0, cast((octet_length(d) - 1) / {compare_bytes} as int)), k -> substring(d, k * {compare_bytes} + 1, {compare_bytes}))"
    chunks = texts.select("fp", "n_bytes", F.encode("text", "utf-8").alias("d")).select("fp", "n_bytes", F.posexplode(F.expr(pieces)).alias("part", "chunk"))
    unequal = chunks.groupBy("fp", "n_bytes", "part").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("fp", "n_bytes").distinct()
    unequal = written(unequal)
    if not unequal.isEmpty():
        # texts that collide are told apart by their bytes; what differs gets a fingerprint of its own
        wrong = texts.join(unequal, ["fp", "n_bytes"], "left_semi")
        groups = groups.join(unequal, ["fp", "n_bytes"], "left_anti").withColumn("sha", F.lit(None).cast("string")).unionByName(
            wrong.groupBy("fp", "n_bytes", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("sha", F.sha2("text", 256)).drop("text")
        )
        same = (prints["fp"] == groups["fp"]) & (prints["n_bytes"] == groups["n_bytes"]) & (groups["sha"].isNull() | (groups["sha"] == prints["text_sha256"]))
        out = prints.join(groups, same).select(prints["doc_id"], "keep_id", "group_size", "text_sha256")
    else:
        out = prints.join(groups, ["fp", "n_bytes"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def one_row_per_id(df: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with a single row left of equal (id, text) rows whose id is in ``ids`` (doc_id), if there is any."""
    ids = written(ids.distinct())
    if ids.isEmpty():
        return df
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))
    ids = ids.select(F.col("doc_id").alias("__id"))
    return df.join(ids, same, "left_anti").unionByName(df.join(ids, same, "left_semi").dropDuplicates([id_col, text_col]))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of equal texts the one with the largest id."""
    found = written(exact_duplicates(df, id_col, text_col))
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    digest = F.sha2(F.encode(text_or_empty(F.col(f"`{text_col}`")), "utf-8"), 256)
    left = df.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (digest == F.col("__sha")), "left_anti")
    twice = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id")
    return one_row_per_id(left, twice, id_col, text_col)
