"""Connected components by alternating large-star and small-star rounds, on tables of edges only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) for every id of `pairs` (columns a, b): label is the smallest id reachable from it.

    No neighbourhood is gathered: each round replaces links by links to the smallest neighbour with two aggregations
    and joins, which AQE may split where one id has very many links. Rounds are written to the shared folder.
    """
    edges = scratch.write(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        after = scratch.write(_small_star(_large_star(edges)), "edges")
        # settled: every id has one link, and no target has a link itself
        n, ids = after.agg(F.count("*"), F.count_distinct("u")).first()
        done = n == ids and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        scratch.drop(edges)
        edges = after
        if done:
            break
    roots = edges.select(F.col("v").alias("id")).distinct()
    return scratch.write(edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(roots.select("id", F.col("id").alias("label"))), "labels")
