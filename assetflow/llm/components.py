"""Connected components of links between integer ids, by distributed contraction.

In each round every node takes its smallest neighbour as parent (or itself, if it is smaller), parents are
followed until they stop changing, and the links are carried over to the trees' roots. The smallest id of a
component is always its own parent, so it is the one that remains. Rounds are written to the shared folder; no
links or labels reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.session import shared_dir


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (node, parent) until every parent is a root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = _kept(
            parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved")),
            "parents",
        )
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest id reachable, for every id that has a link to another."""
    edges = _kept(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a"))
        parents = ends.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("parent"))
        rounds.append(_roots(_kept(parents, "parents")))
        for end in ("a", "b"):
            edges = edges.join(rounds[-1].select(F.col("node").alias(end), F.col("parent").alias(f"root_{end}")), end)
        edges = _kept(
            edges.where("root_a != root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links"
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[-1].select("node", F.col("parent").alias("component"))
    for parents in reversed(rounds[:-1]):
        up = found.select(F.col("node").alias("parent"), "component")
        found = parents.join(up, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    return found
