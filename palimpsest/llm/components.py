"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, forget


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for each node of ``edges`` (``hi``, ``lo``, two longs): root is the least node reachable.

    Alternating large and small stars (Kiveris et al. 2014): every round links neighbours to the least one
    and ends in a written table, so a lost executor costs one round at most. Least neighbours are combined
    before the shuffle, which keeps nodes of huge degree cheap. Empty edges give no rows.
    """
    tree = edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()
    tree = cut(tree, "edges")
    seen = _state(tree)
    while seen[0]:
        both = tree.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(tree.select("lo", "hi"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        before, tree = tree, cut(small.select("x.hi", "x.lo").where("hi <> lo").distinct(), "edges")
        forget(before)
        now = _state(tree)
        if now == seen:
            break
        seen = now
    roots = tree.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(tree.select("lo", "lo").distinct())
