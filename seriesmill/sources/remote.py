"""Remote write and read: protocol buffers in raw Snappy blocks, decoded and encoded without generated code.

WriteRequest: 1 = TimeSeries.  TimeSeries: 1 = Label (1 name, 2 value), 2 = Sample (1 double value, 2 int64 ms).
ReadRequest: 1 = Query (1 from ms, 2 to ms, 3 LabelMatcher (1 type, 2 name, 3 value)).  ReadResponse: 1 =
QueryResult (1 = TimeSeries).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import samples, series_id
from ..operators.select import Matcher, select

OPERATORS = ("=", "!=", "=~", "!~")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number is too long")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
            if len(value) != n:
                raise ValueError("a field is cut off")
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def decompressed(block: bytes) -> bytes:
    size, _ = varint(block, 0)
    return pa.decompress(block, decompressed_size=size, codec="snappy", asbytes=True)


def compressed(data: bytes) -> bytes:
    return pa.compress(data, codec="snappy", asbytes=True)


def time_series(data: bytes) -> tuple[dict[str, str], list[tuple[int, float]]]:
    labels, points = {}, []
    for number, value in fields(data):
        if number == 1:
            pair = {k: v.decode() for k, v in fields(value)}
            labels[pair.get(1, "")] = pair.get(2, "")
        elif number == 2:
            ts, v = 0, 0.0
            for k, x in fields(value):
                if k == 1:
                    (v,) = struct.unpack("<d", x)
                elif k == 2:
                    ts = _signed(x)
            points.append((ts, v))
    return labels, points


def read_write_request(block: bytes) -> Iterator[tuple[dict[str, str], list[tuple[int, float]]]]:
    for number, value in fields(decompressed(block)):
        if number == 1:
            yield time_series(value)


def _number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(data)) + data


def encode_series(labels: dict[str, str], points: list[tuple[int, float]]) -> bytes:
    out = b"".join(_field(1, _field(1, k.encode()) + _field(2, v.encode())) for k, v in sorted(labels.items()))
    return out + b"".join(_field(2, b"\x09" + struct.pack("<d", v) + b"\x10" + _number(t)) for t, v in points)


def encode_write_request(series: list[tuple[dict[str, str], list[tuple[int, float]]]]) -> bytes:
    return compressed(b"".join(_field(1, encode_series(*s)) for s in series))


def encode_writes(df: DataFrame) -> DataFrame:
    """Request bodies (body) that write the samples: one for each series and day."""
    from ..operators.metadata import matrix_result

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for metric, labels, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(encode_write_request([({**dict(labels), "__name__": metric}, [(p["ts"], p["value"]) for p in points])]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["body"])

    return matrix_result(df).select("metric", "labels", "samples").mapInArrow(rows, "body binary")


def parse_writes(bodies: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """Samples of a table of request bodies, and the bodies that can't be read with their error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"metric": [], "labels": [], "ts": [], "value": [], "body": [], "error": []}

            def add(*values) -> None:
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)

            for body in batch.column(0).to_pylist():
                try:
                    for labels, points in list(read_write_request(body)):
                        metric = labels.pop("__name__", "")
                        for t, v in points:
                            add(metric, list(labels.items()), t, v, None, None)
                except (ValueError, IndexError, OSError, struct.error, pa.ArrowException, AttributeError) as e:
                    add(None, None, None, None, body, str(e)[:200])
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in _TYPES.items()], names=list(_TYPES))

    parsed = bodies.select(F.col(column)).mapInArrow(rows, "metric string, labels map<string,string>, ts long, value double, body binary, error string")
    good = parsed.where(F.col("error").isNull())
    return samples(good, F.col("metric"), F.col("labels"), F.col("ts"), F.col("value")), parsed.where(F.col("error").isNotNull()).select("body", "error")


_TYPES = {"metric": pa.string(), "labels": pa.map_(pa.string(), pa.string()), "ts": pa.int64(), "value": pa.float64(), "body": pa.binary(), "error": pa.string()}


def read_query(data: bytes) -> tuple[int, int, list[Matcher]]:
    """Bounds and matchers, of all four kinds, of a query."""
    start = end = 0
    matchers = []
    for number, value in fields(data):
        if number == 1:
            start = _signed(value)
        elif number == 2:
            end = _signed(value)
        elif number == 3:
            m = dict(fields(value))
            matchers.append(Matcher(m.get(2, b"").decode(), OPERATORS[m.get(1, 0)], m.get(3, b"").decode()))
    return start, end, matchers


def answer(df: DataFrame, block: bytes) -> list[DataFrame]:
    """The samples that each query of a read request asks for."""
    queries = [read_query(value) for number, value in fields(decompressed(block)) if number == 1]
    return [select(df, None, tuple(m), a, b) for a, b, m in queries]


def encode_read_request(queries: list[tuple[int, int, list[Matcher]]]) -> bytes:
    def one(start: int, end: int, matchers: list[Matcher]) -> bytes:
        parts = b"".join(_field(3, b"\x08" + _number(OPERATORS.index(m.op)) + _field(2, m.label.encode()) + _field(3, m.value.encode())) for m in matchers)
        return b"\x08" + _number(start) + b"\x10" + _number(end) + parts

    return compressed(b"".join(_field(1, one(*q)) for q in queries))


def encode_results(df: DataFrame) -> DataFrame:
    """An encoded TimeSeries for each series and chunk of time of a result; a response concatenates those of each query."""
    from ..operators.metadata import matrix_result

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for metric, labels, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = {"__name__": metric} if metric else {}
                out.append(_field(1, encode_series({**dict(labels), **name}, [(p["ts"], p["value"]) for p in points])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["series"])

    return matrix_result(df).select("metric", "labels", "samples").mapInArrow(rows, "series binary")


def encode_response(results: list[list[bytes]]) -> bytes:
    """A response with one result for each query, of encoded series."""
    return compressed(b"".join(_field(1, b"".join(series)) for series in results))


def read_response(block: bytes) -> list[list[tuple[dict[str, str], list[tuple[int, float]]]]]:
    """For each query of a response its series: labels, points."""
    return [[time_series(s) for k, s in fields(result) if k == 1] for number, result in fields(decompressed(block)) if number == 1]


def parse_responses(bodies: DataFrame, column: str = "body") -> DataFrame:
    """(query, samples' columns) of a table of response bodies; ``query`` counts the results within a body.  What can't be read fails."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"query": pa.int32(), "metric": pa.string(), "labels": pa.map_(pa.string(), pa.string()), "ts": pa.int64(), "value": pa.float64()}
        for batch in batches:
            out = {name: [] for name in types}
            for body in batch.column(0).to_pylist():
                for k, found in enumerate(read_response(body)):
                    for labels, points in found:
                        metric = labels.pop("__name__", "")
                        for t, v in points:
                            for name, x in zip(out, (k, metric, list(labels.items()), t, v), strict=True):
                                out[name].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in types.items()], names=list(types))

    parsed = bodies.select(F.col(column)).mapInArrow(rows, "query int, metric string, labels map<string,string>, ts long, value double")
    return parsed.select("query", series_id().alias("series_id"), "metric", "labels", "ts", "value", F.lit(0).cast("long").alias("seq"))


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of request bodies."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("body"))
