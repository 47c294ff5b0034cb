"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import write_table

#: Edges of a written file, about.
FILE = 500_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the least node reachable) of every node with an edge to another.

    Large and small stars in turn (Kiveris and others, 2014) until the edges no longer change: each round hangs a
    node's greater neighbours, then its lesser ones, on the least it knows. Rounds grow with the logarithm
    of a component's diameter; each ends in a written table, so a lost executor repeats one round. A node's
    neighbours are only ever folded to their minimum, never gathered. Loops and nulls are dropped.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    # u is the greater end
    current = write_table(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    def digest(t: DataFrame) -> tuple:
        row = t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = digest(current)
    while before[0]:
        both = current.union(current.select("v", "u"))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        least = least.select("_u", F.least("_u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = write_table(_packed(large.distinct(), before[0]), "large-star")
        lowest = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        hung = large.join(lowest, F.col("u") == F.col("_u"))
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        small = small.union(hung.select("u", F.col("m").alias("v")))
        current = write_table(_packed(small.distinct(), before[0]), "small-star")
        after = digest(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v"), F.col("v")).distinct())


def _packed(edges: DataFrame, about: int) -> DataFrame:
    """In as many files as ``about`` so many edges are worth: a round shouldn't write hundreds of small ones."""
    return edges.coalesce(max(1, -(-about // FILE)))
