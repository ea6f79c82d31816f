"""Vectors of short texts, their nearest by cosine, and clusters."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import graph


def embed(texts: DataFrame, dims: int = 384) -> DataFrame:
    """id, vector: hashed counts of lower-case words, of length 1 (a text without words: zeros). texts: id, text."""
    words = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"[^\w]+", minTokenLength=1).transform(texts.select("id", F.coalesce("text", F.lit("")).alias("text")))
    counts = HashingTF(numFeatures=dims, inputCol="w", outputCol="tf").transform(words)
    return Normalizer(p=2.0, inputCol="tf", outputCol="v").transform(counts).select("id", vector_to_array("v").alias("vector"))


def similar(left: DataFrame, right: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """id, other, cosine, rank: the k most alike of `right` for each of `left`, itself left out; at least `least` and over 0.

    Vectors of length 1 are joined on the dimensions that both have, so pairs without a word in common are never made.
    """
    parts = lambda df, n: df.select(F.col("id").alias(n), F.posexplode("vector").alias("dim", n + "_w")).where(F.col(n + "_w") != 0)
    dots = parts(left, "id").join(parts(right, "other"), "dim").where("id <> other").groupBy("id", "other").agg(F.sum(F.col("id_w") * F.col("other_w")).alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return dots.where((F.col("cosine") >= least) & (F.col("cosine") > 0)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prune(pairs: DataFrame, found: DataFrame, least: float = 0.18) -> DataFrame:
    """Pairs (id, other) with cosine, keep and reason; a pair whose vectors are missing is kept with 0. found: id, other, cosine."""
    out = pairs.join(found.select("id", "other", "cosine"), ["id", "other"], "left")
    return out.select("id", "other", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), (F.col("cosine").isNull() | (F.col("cosine") >= least)).alias("keep"), F.when(F.col("cosine").isNull(), "no_embedding").when(F.col("cosine") >= least, "similar").otherwise("below_threshold").alias("reason"))


def clusters(vectors: DataFrame, eps: float = 0.5) -> DataFrame:
    """id, cluster (its smallest id; null: noise). Density clusters for two points or more: each point that has a neighbour within eps is a core point, so clusters are the components of the neighbour graph."""
    near = similar(vectors, vectors, 1 << 30, 1 - eps).select(F.col("id").cast("string").alias("fk_table"), F.col("other").cast("string").alias("pk_table"))
    found = graph.components(near)
    return vectors.select("id").join(found, F.col("id").cast("string") == found["node"], "left").select("id", F.col("component").alias("cluster"))
