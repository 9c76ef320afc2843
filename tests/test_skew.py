"""Joins keep every row of a hot key, read the big side once and may be split at run time."""

import pytest
from pyspark.sql import functions as F

from assetflow.operators import companions, skew


def rows(spark, n=6000):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string")))
    return spark.range(n).select("id", key.alias("key"))


def counted(spark):
    return rows(spark).filter("key = 'hot' OR id % 2 = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_plain_join(spark, how):
    got = skew.lookup_join(rows(spark), counted(spark), "key", how)
    want = rows(spark).join(counted(spark), ["key"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_hot_key_is_split(spark, how):
    """A third of all rows has one key; the plan that ran has a skewed join."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = skew.lookup_join(rows(spark, 60_000).repartition(16), counted(spark), "key", how)
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan


def test_collisions_of_a_hot_key(spark):
    mapping = rows(spark).filter("key IS NOT NULL").select(F.concat(F.lit("f"), "id").alias("source"), "key")
    got = companions.collisions(mapping)
    counts = {r.key: r.n for r in mapping.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got.count() == sum(n for n in counts.values() if n > 1)
    assert {(r.key, r.sources) for r in got.select("key", "sources").distinct().collect()} == {(k, n) for k, n in counts.items() if n > 1}
