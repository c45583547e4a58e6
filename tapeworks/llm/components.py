"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tapeworks.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a > b). Each node's least neighbour (itself included) is found by a grouped minimum, which
    is combined before the exchange, and joined back, which splits hot nodes; no neighbour list is ever gathered."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = sides.join(least, "u")
    if large:  # every larger neighbour is hung on the least one
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:  # every smaller neighbour, and the node, are hung on the least one
        out = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component for every node of edges (a, b): the least node that can be reached. Nulls and loops are left out. Rounds go on until one changes nothing,
    which takes some log(nodes) squared of them, and one where edges are components found before. The table of a call goes with the next one over the same scratch."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    scratch = scratch or Scratch(edges.sparkSession)
    stars = scratch.put("stars", edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(a.alias("a"), b.alias("b")).distinct())
    before, after = None, _digest(stars)
    while after != before:
        stars = scratch.put("stars", _star(_star(stars, large=True), large=False))
        before, after = after, _digest(stars)
    roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> Row:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
