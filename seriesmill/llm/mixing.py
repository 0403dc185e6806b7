"""Mixing sources to target weights by capped water-filling.

Sources share the words of the mix by weight.  A source whose share is above ``max_epochs`` times its own size
is clamped there and the excess goes to the others by weight, until nothing is above.  Within a source, whole
repetitions take every document; the fractional one takes documents in a seeded random order until the target
is met to within half a document.  Where that order is cut is found from sums over buckets of its hash, then over
buckets within the one of the cut, then from the rows of the last: no source is sorted, and rows with their
texts are neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, global_index, text_or_empty, written

#: Buckets of the seeded order: so many hex digits of its hash, and as many again within a bucket.
DIGITS = 3
#: Sources that are sent to all executors, at most; more meet their rows in a join by source and bucket.
SENT = 50_000


def weights_by_rank(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight`` to a table of sources: the cycle over their code point order, null last."""
    ranked = global_index(sources, F.col("source").asc_nulls_last(), name="rank")
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int")).cast("double")).drop("rank")


def water_level(sources: DataFrame, max_epochs: int, total: int | None = None) -> float:
    """The level L at which min(max_epochs * source_size, L * weight) sums to ``total`` (default: all words).

    Each turn clamps what is above its cap and redistributes the rest: one distributed sum over the sources,
    of which one row reaches the driver.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = None
    while True:
        clamped = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if not row["weight"]:
            return level or 0.0
        new = (float(row["all"] or 0 if total is None else total) - row["full"]) / row["weight"]
        if level is not None and new <= level:
            return level
        level = new


def _keyed(df: DataFrame, id_col: str, source_col: str, seed: str) -> DataFrame:
    """``df`` with its place in the seeded order (__turn) and a key of its source without nulls (__key)."""
    return df.withColumns({
        "__key": F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")),
        "__turn": F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))),
    })


def _size(text_col: str):
    return F.regexp_count(text_or_empty(F.col(f"`{text_col}`")), F.lit(WORD)).cast("long")


def _cut(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, source_size, target, whole, cut_turn, cut_size): the fractional repetition takes rows up to that turn and size.

    ``sizes``: key, turn, size.  The words before a row only grow along the order, so what is taken is its beginning.
    Rows of equal turn and size are taken alike.
    """
    part = lambda k: F.substring("turn", 1 + DIGITS * k, DIGITS)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most 16 ** DIGITS rows a source; the last bucket that begins within the target holds the cut
    buckets = sizes.groupBy("key", part(0).alias("bucket")).agg(F.sum("size").alias("words")).withColumn("before", before)
    room = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    first = buckets.join(sources, "key").where(F.col("before") <= room).groupBy("key", "source_size", "target", "whole").agg(F.max("bucket").alias("bucket"), F.max("before").alias("begun"))
    inside = sizes.withColumn("bucket", part(0)).join(first, ["key", "bucket"])
    buckets = inside.groupBy("key", "source_size", "target", "whole", "begun", F.col("bucket").alias("outer"), part(1).alias("bucket")).agg(F.sum("size").alias("words"))
    buckets = buckets.withColumn("before", F.col("begun") + before).where(F.col("before") <= room)
    second = buckets.groupBy("key", "source_size", "target", "whole", "outer").agg(F.max("bucket").alias("inner"), F.max("before").alias("begun"))
    inside = sizes.withColumn("outer", part(0)).withColumn("inner", part(1)).join(second, ["key", "outer", "inner"])
    rows = inside.groupBy("key", "source_size", "target", "whole", "begun", "outer", "inner", "turn", "size").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("key").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, -1)
    half_way = F.col("begun") + F.coalesce(F.sum("words").over(order), F.lit(0)) + F.col("size") / 2
    taken = F.when(half_way <= room, F.struct("turn", "size"))
    cut = rows.withColumn("taken", taken).groupBy("key", "source_size", "target", "whole", F.concat("outer", "inner").alias("bucket")).agg(F.max("taken").alias("cut"))
    # none of the last bucket: its name comes before its rows and after all others
    return cut.select("key", "source_size", "target", "whole", F.coalesce("cut.turn", "bucket").alias("cut_turn"), F.coalesce("cut.size", F.lit(-1)).alias("cut_size"))


def _plan(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: DataFrame | None, max_epochs: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Every row's id, source, key, turn and size (one pass over the texts), and the cut of each source; both written."""
    keyed = _keyed(df, id_col, source_col, seed)
    sizes = written(keyed.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col("__key").alias("key"), F.col("__turn").alias("turn"), _size(text_col).alias("size")))
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = written(weights_by_rank(sources))
    else:
        given = weights.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), F.col("weight").cast("double"))
        sources = written(sources.join(given, "key", "left").fillna(0.0, ["weight"]))
    level = water_level(sources, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    sources = sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return sizes, written(_cut(sizes, sources.select("key", "source_size", "target", whole.alias("whole"))))


def _with_plan(rows: DataFrame, plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows that have __key and __turn with their source's plan: sent to them, or if sources are many, met in shuffled buckets."""
    plan = plan.withColumnRenamed("key", "__key")
    if plan.count() <= SENT:
        return rows.join(F.broadcast(plan), "__key")
    buckets = sizes.select(F.col("key").alias("__key"), F.substring("turn", 1, DIGITS).alias("__bucket")).distinct().join(plan, "__key")
    return rows.withColumn("__bucket", F.substring("__turn", 1, DIGITS)).join(buckets, ["__key", "__bucket"]).drop("__bucket")


def _copies(size, max_epochs: int):
    """How often a row is taken, by the columns of its source's plan; ``size`` is looked at only at the cut."""
    extra = (F.col("__turn") < F.col("cut_turn")) | ((F.col("__turn") == F.col("cut_turn")) & (size <= F.col("cut_size")))
    return F.least(F.col("whole") + F.when(extra, 1).otherwise(0), F.lit(max_epochs)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, copies, taken.

    ``weights``: (source, weight); by default 1, 2, 3, ... over sources by code point.  size counts words, 0 for
    null and empty text.  A null source is a source of its own.  Empty documents take nothing; equal rows are
    taken alike.  An empty table gives no rows.
    """
    sizes, plan = _plan(df, id_col, text_col, source_col, weights, max_epochs, seed)
    rows = _with_plan(sizes.withColumnsRenamed({"key": "__key", "turn": "__turn"}), plan, sizes)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, _copies(F.col("size"), max_epochs)).otherwise(0).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """The mix itself: every row of ``df`` as many times as ``mix`` says, with the columns of ``df``.  Texts aren't shuffled."""
    sizes, plan = _plan(df, id_col, text_col, source_col, weights, max_epochs, seed)
    columns = ("source_size", "target", "whole", "cut_turn", "cut_size")
    plan = plan.select("key", F.struct(*columns).alias("__plan"))
    # the table's own columns are set aside, so that none of theirs clashes
    own = _keyed(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")).select("__row", F.col(f"__row.`{id_col}`").alias("__id"), F.col(f"__row.`{source_col}`").alias("__source"), F.col(f"__row.`{text_col}`").alias("__text")), "__id", "__source", seed)
    rows = _with_plan(own, plan, sizes).select("__row", "__text", "__turn", "__plan.*")
    copies = F.when(text_or_empty("__text").rlike(WORD), _copies(_size("__text"), max_epochs)).otherwise(0)
    copied = rows.withColumn("__copies", copies.cast("long")).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return copied.select("__row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         sum(source_size) OVER ()::DOUBLE AS words,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS turn
  FROM s
), l AS (
  SELECT coalesce(arg_min(level, turn) FILTER (level < cap / weight), max(cap / weight)) AS level
  FROM (SELECT *, (words - full_before) / weight_left AS level FROM c)
), t AS (
  SELECT source, source_size, least(cap, level * weight) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, level * weight) / source_size)::BIGINT ELSE 0 END AS whole FROM c, l
), d AS (
  SELECT doc_id, size, source_size, target, whole,
         sum(size) OVER (PARTITION BY sized.source ORDER BY md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS half_way
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN least(whole + CASE WHEN half_way <= target - whole * source_size THEN 1 ELSE 0 END, 3) * size ELSE 0 END::BIGINT AS taken
FROM d
"""
