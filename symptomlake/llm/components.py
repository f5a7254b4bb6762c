"""Connected components by alternating large and small stars, as shuffles over the links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .order import stored


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star step over directed links (a > b): neighbours move to the least node they share."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    found = both.join(least, "a")
    if small:
        moved = found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    else:
        moved = found.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``links`` (a, b).

    Each round is written to the shared folder, which cuts off its lineage. It ends
    when every node points at its root, after a number of rounds that grows with the
    logarithm of the longest path. Only counts come to the driver.

    A node with very many links: least nodes and open ends are reduced on the map
    side; what is left of it is one side of the inner join of a star step, which
    the engine may cut where it is large (no order or grouping hangs on that join).
    """
    tree = stored(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    while True:
        # In a finished forest of stars, no root points on and no node has two links.
        ends = tree.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            tree.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
        if degrees.where("out > 1 OR (out > 0 AND into > 0)").isEmpty():
            break
        tree = stored(_star(_star(tree, small=False), small=True), "star")
    return (tree.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(tree.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
