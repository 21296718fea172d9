"""Connected components of a link table, by alternating stars.

Each round rewires the links of every vertex to the smallest vertex among its
neighbours: first from the larger neighbours (large star), then from the
smaller ones (small star).  The links become one star per component after
about log(n) rounds.  Every half round is written to the shared folder, which
cuts the lineage and leaves the join of links with minima two plain exchanges
(AQE splits the partition of a vertex with very many links)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import spill_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(pairs: DataFrame, keep) -> DataFrame:
    """``pairs`` (u, n): link every n that ``keep`` admits, and u itself, to the
    smallest of u and its n."""
    least = spill_table(pairs.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m")), "star-min")
    wired = pairs.join(least, "u").where(keep).select(F.col("n").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return spill_table(wired.unionByName(own).where("u > v").distinct(), "star")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, root)`` of every vertex in ``links``; root is the smallest
    vertex of its component.  Null ends and self links are ignored."""
    edges = spill_table(links.where(F.col(a) != F.col(b))
                        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _state(edges)
    while True:
        both = edges.select("u", F.col("v").alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("n")))
        edges = _star(both, F.col("n") > F.col("u"))
        edges = _star(edges.select("u", F.col("v").alias("n")), F.lit(True))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
