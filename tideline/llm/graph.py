"""Connected components by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b): the smallest node that it reaches.

    Each round links all larger neighbours of a node to its smallest one, then all smaller ones; after a few rounds (the
    logarithm of the longest path) every component is a star and no row moves. Edges lead from the larger node to the
    smaller one, so that a node's least neighbour is a minimum summed up before the shuffle, and a node with very many
    larger ones is a key of a merge join, which Spark splits. Each round is written, so that none is computed twice; it has three
    exchanges and nothing is broadcast, as every stage costs memory of the driver."""
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    near = Window.partitionBy("a").orderBy("b")
    while True:
        least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        large = edges.select("a", "b").join(least.hint("merge"), F.col("b") == F.col("node"), "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        small = large.withColumn("m", F.first("b").over(near)).withColumn("last", F.lag("b").over(near)).where("last is null or last <> b")
        edges = stash(small.select(F.when(F.col("last").isNull(), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"), (F.col("moved") | F.col("last").isNotNull()).alias("moved")))
        if not edges.agg(F.max("moved")).first()[0]:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
