"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbours and itself."""
    both = _neighbours(edges)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these. edges: u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of an edge, for edges (a, b): root is the smallest node of its component.

    Edges stay on the executors; each round is written to the shared folder, and stops once nothing moves. Rounds grow
    with the logarithm of the longest path. A node with very many edges is pre-aggregated to its minimum; its edges meet
    that one row in a join which Spark may split. Null ends and loops are dropped.
    """
    spark = edges.sparkSession
    now = edges.where("a is not null and b is not null and a <> b")
    now = written(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = sign(now)
    for _ in range(most):
        if not before[0]:
            break
        new = written(_small(_large(now).where("u > v").distinct()).where("u > v").distinct(), "edges")
        discard(spark, now)
        now, after = new, sign(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
