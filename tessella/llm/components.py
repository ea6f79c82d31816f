"""Connected components of a link table, by alternating stars, with a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """links: a, b (long, no nulls). Returns node, root: the smallest node of its component, for every linked node.

    Each round hangs every node's larger neighbours below its smallest one (large star), then
    every node's smaller ones (small star), until nothing changes; a path of length n takes
    about log n rounds. Stars of hot nodes are aggregated map-side and never gathered.
    """
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]

    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-0")
    before = state(edges)
    for k in range(1, max_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = scratch.table(small, f"cc-{k}")
        now = state(new)  # rows are distinct, so equal tables have equal counts and hash sums
        scratch.drop_table(f"cc-{k - 1}")
        edges = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
