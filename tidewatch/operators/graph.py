"""Neighbour operators over an edge table (src, dst).

Node rows are (by..., t, node, metric, x). A message goes from src to dst.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import spread


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node row once per outgoing edge, with ``dst``."""
    return spread.lookup_join(nodes.withColumnRenamed("node", "src"), edges, ["src"])


def neighbour_mean(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, mean of the incoming neighbours' x); ``keys`` are the columns beside node and x."""
    sent = neighbours(nodes, edges)
    return sent.groupBy(*keys, F.col("dst").alias("node")).agg(F.avg("x").alias("neighbour_mean"))


def smoothing_weights(edges: DataFrame, node_names: DataFrame, self_weight: float = 2.0) -> DataFrame:
    """(src, dst, weight): symmetrically normalised adjacency with weighted self loops."""
    loops = node_names.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(self_weight).alias("w"))
    weighted = edges.select("src", "dst", F.lit(1.0).alias("w")).unionByName(loops)
    degree = weighted.groupBy("dst").agg(F.sum("w").alias("_d"))
    out = weighted.join(degree.withColumnRenamed("_d", "_d_dst"), "dst")
    out = out.join(degree.select(F.col("dst").alias("src"), F.col("_d").alias("_d_src")), "src")
    return out.select("src", "dst", (F.col("w") / F.sqrt(F.col("_d_src") * F.col("_d_dst"))).alias("weight"))


def smooth(nodes: DataFrame, edges: DataFrame, node_names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, smoothed): normalised weighted sum over neighbours and the node itself."""
    sent = neighbours(nodes, smoothing_weights(edges, node_names))
    return sent.groupBy(*keys, F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("x")).alias("smoothed"))


def residual(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Node rows with x minus the neighbour mean (null without neighbours)."""
    means = neighbour_mean(nodes, edges, keys)
    out = nodes.join(means, [*keys, "node"], "left")
    return out.withColumn("residual", F.col("x") - F.col("neighbour_mean")).drop("neighbour_mean")
