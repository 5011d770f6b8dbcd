"""Connected components by alternating large-star and small-star rounds, staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilune.llm.common import staged


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node links to one smaller node only, which links to none: then nothing is left to do."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("outs"), F.lit(0).alias("ins")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("outs"), F.lit(1).alias("ins")))
    mixed = ends.groupBy("x").agg(F.sum("outs").alias("outs"), F.max("ins").alias("ins")).where("outs > 1 or outs = 1 and ins = 1")
    return not mixed.limit(1).count()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (u, v), u > v. Large: each node links its larger neighbours to its least one; small: its smaller ones and itself."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """doc, comp: the smallest id that each linked id other than that reaches. edges: (lo, hi) in any order, repeats allowed."""
    pairs = edges.where("lo <> hi").select(F.greatest("lo", "hi").alias("u"), F.least("lo", "hi").alias("v")).distinct()
    now = staged(_star(pairs, large=False))
    while not _are_stars(now):
        now = staged(_star(_star(now, large=True), large=False))
    return now.select(F.col("u").alias("doc"), F.col("v").alias("comp"))
