"""Connected components of an edge table, wholly in DataFrames: alternating large-star and small-star
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Every round is a grouped
minimum with partial aggregation and a join on the grouped key, so a hub's edges are never gathered
in one task, and each round is written to the shared folder."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import join_grouped, release, staged


def _star(e: DataFrame, large: bool) -> DataFrame:
    if large:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = join_grouped(both, least, ["u"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (u long, v long). Returns (node long, component long), component the smallest node
    reachable; nodes without an edge are absent. Null ends and loops are ignored; an empty table
    gives an empty result."""
    e = staged(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), f"{name}-0")
    mark = None
    for k in count(1):  # to the fixed point: every round that is not the last lowers a node's centre
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or (now["n"], now["s"]) == mark:
            break
        mark = (now["n"], now["s"])
        before, e = e, staged(_star(_star(e, True), False), f"{name}-{k}")
        release(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
