"""Text formats: exposition, Graphite and line protocol, as tables of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import entries, samples
from ..operators.aggregate import value_text

LINE = r'^\s*([A-Za-z_:][A-Za-z0-9_:]*)?\s*(?:\{(.*)\})?\s*([^\s{}"]+)(?:\s+(-?[0-9]+))?\s*$'
LABEL = r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
LABELS = rf'^\s*(?:{LABEL}\s*(?:,\s*{LABEL}\s*)*,?\s*)?$'


def number(text: Column) -> Column:
    """A double, with NaN and signed Inf; null if it is none."""
    low = F.lower(text)
    return (
        F.when(low == "nan", F.lit(float("nan"))).when(low.isin("+inf", "inf", "+infinity", "infinity"), F.lit(float("inf")))
        .when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))).otherwise(text.try_cast("double"))
    )


def _unescaped(text: Column) -> Column:
    # a doubled backslash is set aside while the others are read
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0000")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\u0000"), F.lit("\\"))


def parse_exposition(lines: DataFrame, now: int, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Samples of lines ``name{l="v", ...} value [ms]``, and the lines that are neither that nor comment nor blank.

    A missing time is ``now``.  A name may be given as label __name__.
    """
    rows = lines.select(F.col(column).alias("line")).where(~F.col("line").rlike(r"^\s*(#|$)"))
    part = lambda k: F.regexp_extract("line", LINE, k)
    rows = rows.select("line", part(1).alias("name"), part(2).alias("text"), number(part(3)).alias("number"), part(4).try_cast("long").alias("time"), F.col("line").rlike(LINE).alias("ok"))
    keys, values = F.regexp_extract_all("text", F.lit(LABEL), F.lit(1)), F.regexp_extract_all("text", F.lit(LABEL), F.lit(2))
    rows = rows.withColumn("keys", keys).withColumn("values", F.transform(values, _unescaped))
    rows = rows.withColumn("all", F.when(F.size("keys") == F.size(F.array_distinct("keys")), F.map_from_arrays("keys", "values")))
    metric = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("all").getItem("__name__"))
    rows = rows.withColumn("metric", metric).withColumn("good", F.col("ok") & F.col("number").isNotNull() & F.col("metric").isNotNull() & F.col("all").isNotNull() & F.col("text").rlike(LABELS))
    good, bad = rows.where("good"), rows.where("NOT coalesce(good, false)").select("line")
    labels = F.map_filter("all", lambda k, _: k != "__name__")
    return samples(good, F.col("metric"), labels, F.coalesce("time", F.lit(now)), F.col("number")), bad


def read_exposition(spark: SparkSession, path: str, now: int) -> tuple[DataFrame, DataFrame]:
    return parse_exposition(spark.read.text(path), now)


def write_exposition(df: DataFrame) -> DataFrame:
    """Lines of exposition text: the inverse of reading."""
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.array_join(F.transform(entries(), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), ",")
    braces = F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise("")
    return df.select(F.concat_ws(" ", F.concat("metric", braces), value_text(), F.col("ts").cast("string")).alias("value"))


def parse_graphite(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Samples of lines ``path[;tag=value...] value seconds``; dots of the path become underscores."""
    pattern = r"^(\S+)\s+(\S+)\s+(-?[0-9.]+)$"
    col = F.trim(F.col(column))
    rows = lines.where(col != "").select(col.alias("line"), F.split(F.regexp_extract(col, pattern, 1), ";").alias("path"), number(F.regexp_extract(col, pattern, 2)).alias("number"), F.regexp_extract(col, pattern, 3).try_cast("double").alias("time"))
    tags = F.filter("path", lambda t: t.contains("="))
    rows = rows.withColumn("labels", F.map_from_entries(F.transform(tags, lambda t: F.struct(F.substring_index(t, "=", 1), F.regexp_replace(t, "^[^=]*=", "")))))
    good = (F.col("path")[0] != "") & F.col("number").isNotNull() & F.col("time").isNotNull()
    name = F.regexp_replace(F.col("path")[0], "[^A-Za-z0-9_:]", "_")
    return samples(rows.where(good), name, F.col("labels"), F.floor(F.col("time") * 1000), F.col("number")), rows.where(~F.coalesce(good, F.lit(False))).select("line")


def parse_line_protocol(lines: DataFrame, column: str = "value", now: int = 0) -> tuple[DataFrame, DataFrame]:
    """Samples of lines ``measurement[,tag=value...] field=value[,...] [ns]``, one for each numeric field, as measurement_field."""
    pattern = r"^((?:[^\s\\]|\\.)+)\s+(\S+)(?:\s+(-?[0-9]+))?$"
    col = F.trim(F.col(column))
    rows = lines.where((col != "") & ~col.startswith("#")).select(col.alias("line"), F.split(F.regexp_extract(col, pattern, 1), r"(?<!\\),").alias("head"), F.split(F.regexp_extract(col, pattern, 2), ",").alias("fields"), F.regexp_extract(col, pattern, 3).try_cast("long").alias("ns"))
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    tags = F.filter("head", lambda t: t.contains("="))
    rows = rows.withColumn("labels", F.map_from_entries(F.transform(tags, lambda t: F.struct(plain(F.substring_index(t, "=", 1)), plain(F.regexp_replace(t, "^[^=]*=", ""))))))
    each = rows.select("line", "head", "labels", "ns", F.explode("fields").alias("field"))
    value = number(F.regexp_replace(F.regexp_extract("field", "=(.*)$", 1), "(?<=[0-9])[iu]$", ""))
    each = each.withColumn("number", value).withColumn("name", F.concat(plain(F.col("head")[0]), F.lit("_"), F.substring_index("field", "=", 1)))
    good = F.col("number").isNotNull() & (F.col("head")[0] != "")
    ts = F.coalesce(F.expr("(ns - pmod(ns, 1000000L)) div 1000000L"), F.lit(now))
    return samples(each.where(good), F.col("name"), F.col("labels"), ts, F.col("number")), each.where(~F.coalesce(good, F.lit(False))).select("line")


def is_text_column(body: str) -> Column:
    """``is_text`` for a column of bodies."""
    head = F.decode(F.substring(body, 1, 512), "iso-8859-1")
    plain = F.regexp_replace(head, r"[^\t\n\r -~]", "")
    return (F.length(head) == 0) | (F.length(plain) > F.length(head) * 0.9)


def is_text(data: bytes) -> bool:
    """Whether more than nine tenths of the first 512 bytes are printable."""
    head = data[:512]
    return not head or sum(b in b"\t\n\r" or 32 <= b < 127 for b in head) > 0.9 * len(head)
