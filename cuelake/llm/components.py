"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "components", most_rounds: int = 50) -> DataFrame:
    """(node, label) of every node of the links (u, v): label is the smallest node that it is linked with, itself included.

    Each round is written, so lineage stays short. A large-star step joins edges with the least neighbour of one end; a node
    with very many edges is a skewed key there, which adaptive execution splits. No edges give no rows.
    """
    now = scratch.save(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), f"{name}-0")
    before = None
    for k in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = scratch.save(small.where(F.col("u") != F.col("v")).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
