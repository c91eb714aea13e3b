"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Scratch


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``edges`` (columns ``u``, ``v``; longs).

    Alternating large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, to its
    least neighbour. Each step is a minimum per node, combined before the shuffle, and a join back, so a hub of any
    degree is never gathered. Each round is written to the shared folder and the one before it deleted. Rounds grow with the logarithm of the
    longest path; if ``rounds`` are not enough, an error says so. Null ends and loops are ignored.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    scratch = Scratch(edges.sparkSession, "components")
    state, before = scratch.put("0", pairs), None
    for i in range(1, rounds + 1):
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = scratch.put(str(i), small.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
        scratch.drop(str(i - 1))
        now = state.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before and now[0] == now[1]:  # every node points at one smaller node and nothing moves: stars
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component")))
