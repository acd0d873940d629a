"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.storage import Scratch


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Rows (node, root): every node of ``edges`` (a long, b long) with the smallest node of its component.

    Self-loops, repeated and reversed edges are harmless, an empty table gives no rows. A round is two joins of the
    edges with each node's smallest neighbour, which is pre-aggregated, so a star of any size is dealt out by Spark's
    skew handling. Each round is written to the shared folder. The number of rounds grows with the logarithm of the
    longest chain; ``max_rounds`` is a safety stop that raises, it never returns a partial answer.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = smallest(both).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = smallest(down)
        return down.join(m, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u != v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    scratch = Scratch(edges.sparkSession)
    e = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges0")
    before = mark(e)
    for n in range(max_rounds):
        if not before[0]:
            break
        e = scratch.table(small_star(large_star(e)), f"edges{n + 1}")
        scratch.drop(f"edges{n}")
        if (now := mark(e)) == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
