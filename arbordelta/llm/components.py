"""Connected components by alternating stars.

Each round hangs every node's neighbours on its least neighbour, first the
greater ones (large star), then the smaller ones (small star), until each node
hangs on the least of its component.  A round is two aggregations by partial
minimum and two joins; its result is a written table, so lineage stays short and
a lost executor costs one round at most.  Only a fingerprint of the edges comes
to the driver.  A hub with a third of all edges is one row in the aggregations;
in the joins its edges are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordelta.sources.scratch import written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component) of every node with an edge to another; component is its least node.

    Null ends and loops are no edges.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a) != F.col(b)).alias("_real")).where("_real").drop("_real")
    hung = written(pairs.distinct(), "edges")  # a hangs on b < a
    seen = _fingerprint(hung)
    for _ in range(rounds):
        both = hung.unionByName(hung.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("_m", "a").alias("_m"))
        large = both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), "_m")
        small = large.join(below, F.col("a") == F.col("_a")).select(F.explode(F.array(F.struct(F.col("a"), F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("e"))
        hung = written(small.select("e.a", "e.b").where("a > b").distinct(), "edges")
        if (now := _fingerprint(hung)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    roots = hung.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return hung.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
