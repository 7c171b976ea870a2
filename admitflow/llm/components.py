"""Connected components of a link table, by alternating star operations.

Each round points nodes at smaller neighbours; a handful of rounds suffice for
the clusters that near-copies form. Links are only ever joined and aggregated by
node, and every round is a written table, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.session import cut_lineage


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b) the smallest node it is connected with.

    Nodes without a link to another node are left out. Null ends, self-links and
    repeated links change nothing.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut_lineage(links, "links")
    before = _state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours larger than a node point at its smallest neighbour.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct(), "large-star")
        # Small star: smaller neighbours of a node, and the node, point at the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).where("a != b")
        links = cut_lineage(small.distinct(), "links")
        after = _state(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
