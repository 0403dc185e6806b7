"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that are turned into Python objects at a time.
SLICE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, the checkpoint folder set by the program; without either, a temporary folder if driver and
    executors are one process (master local), and else an error: executors don't see each other's own folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not context.isLocal():
            raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seriesmill-"))
    return context.getCheckpointDir().get()


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/seriesmill-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe when executors go."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes the tables that operators of this application wrote; results that read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``most`` bytes, or of one row."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over column batches: ``fn`` takes a batch and yields dictionaries of columns.

    Spark bounds each incoming batch (rows and bytes); ``fn`` gets it in slices of about SLICE bytes, as Python
    objects made of a slice take several times its size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in (c for part in slices(batch) for c in fn(part)):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def global_index(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Number rows 0, 1, ... in a total order without bringing them to one task.

    Rows are range-partitioned and sorted; only one count per partition reaches the driver.
    Rows that compare equal get adjacent numbers.  The sorted rows are written once, so that the
    numbers don't depend on a second, possibly different, range partitioning.
    """
    numbered = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("p")).count().collect()
    start, starts = 0, []
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        starts += [F.lit(p), F.lit(start).cast("long")]
        start += n
    if not starts:
        return numbered.withColumn(name, F.lit(0).cast("long")).drop("__at")
    return numbered.withColumn(name, F.create_map(*starts)[part] + row).drop("__at")


def most_frequent(counts: DataFrame, n_col: str, most: int) -> DataFrame:
    """The rows of a table of counts from that count on at which at most ``most`` rows are left.

    The bound comes from a histogram of counts (a few hundred rows at the driver), not from a global sort.
    """
    level = F.floor(F.log2(n_col) * 8)
    levels = counts.groupBy(level.alias("level")).count().collect()
    least, total = None, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.where(level >= least if least is not None else F.lit(False))
