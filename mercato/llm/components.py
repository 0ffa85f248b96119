"""Connected components of an edge table, as a chain of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b: long).

    Alternates two steps until nothing changes: point each node's larger
    neighbours at its smallest neighbour, then point its smaller neighbours and
    itself there. Every round is joins and partial aggregates on node ids,
    written to the shared folder; a node with very many edges is only ever
    aggregated map-side or joined, never gathered. Only a count and a checksum
    reach the driver.
    """
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "edges")
    before = _state(cur)
    while before[0]:
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large["a"] == low["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        cur = written(small.where("a <> b").distinct(), "small-star")
        after = _state(cur)
        if after == before:
            break
        before = after
    # stars now: every edge points from a node to its component's smallest
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
