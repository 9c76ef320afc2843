"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Join rows to a table that is unique on the keys (inner, left, left_semi, left_anti).

    Spark splits a skewed partition at run time only where both inputs of the join are plain
    shuffles.  A table that comes out of an aggregate would be joined where it lies, so a
    derived key that is always 0 makes Spark shuffle both; rows are read once, and no job runs
    before the plan is complete.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)

    def shuffled(df: DataFrame) -> DataFrame:
        return df.withColumn("_zero", F.pmod(F.xxhash64(*keys), F.lit(1)))

    return shuffled(rows).join(shuffled(table), [*keys, "_zero"], how).drop("_zero")
