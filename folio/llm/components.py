"""Connected components by alternating large-star and small-star rounds; every round is a pair of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u <> v. Each u joins its neighbours to the least of itself and them."""
    e = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = e.join(m, "u")
    if large:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
    # A large star gives each edge once or twice; the small star after it makes them distinct, with one shuffle less.
    return out.where("u <> v") if large else out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) between ids -> (id, component): the least id that is reachable, for every id in a link to another."""
    edges = written(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "cc", narrow=True)
    seen = None
    while True:
        after = written(_star(_star(edges, True), False), "cc", narrow=True)
        remove(edges.sparkSession, edges)
        edges = after
        now = tuple(edges.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    # All edges lead to the least of their component by now.
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return written(leaves.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "cc", narrow=True)
