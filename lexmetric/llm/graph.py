"""Connected components of a graph whose links are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmetric.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node of its
    component.  Alternating star contraction: each round hangs every neighbour
    on the smallest node it sees, until all links point at roots.  Rounds grow
    with the logarithm of the longest chain; every round is written to the
    shared checkpoint folder.  Minima are aggregated before the shuffle, so a
    node with very many links is no single row."""
    def best(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def mark(e: DataFrame):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = best(both).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = best(down)
        small = (down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))).where("a <> b").distinct()
        e = cut(small)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
