import os

from pyspark.sql import functions as F

from seriesmill.llm import common


def test_tables_lie_in_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    df = common.written(spark.range(5))
    assert all(root in f for f in df.inputFiles()) and df.count() == 5 and common.shared_dir(spark) == root
    common.discard(spark)
    assert not os.path.exists(f"{root}/seriesmill-{spark.sparkContext.applicationId}")


def test_global_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("clash").alias("position_"))
    got = common.global_index(df.repartition(7), F.col("x").desc()).collect()
    assert {r.x: r.position for r in got} == {x: 999 - x for x in range(1000)}
    assert common.global_index(df.where("x < 0"), F.col("x")).count() == 0


def test_most_frequent(spark):
    counts = spark.createDataFrame([(k, 1 + k // 10) for k in range(100)], "w long, n long")
    for most in (0, 5, 35, 100):
        kept = common.most_frequent(counts, "n", most).collect()
        assert len(kept) <= most and (most < 100 or len(kept) == 100)
        rest = {r.w for r in counts.collect()} - {r.w for r in kept}
        assert not kept or not rest or min(r.n for r in kept) >= max(1 + w // 10 for w in rest)
