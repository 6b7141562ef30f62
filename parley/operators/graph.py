"""Concept graphs as tables of edges: building, bounded breadth-first search, degrees, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.lineage import cut


def build(nodes: DataFrame, id: str, related: str) -> DataFrame:
    """Undirected edges (src < dst) from arrays of related ids; unknown ids and loops are left out."""
    named = nodes.select(F.col(id).alias("a"), F.explode(related).alias("b")).join(nodes.select(F.col(id).alias("b")), "b").where("a <> b")
    return named.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def distances(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, distance) of all nodes within `hops` of the seeds (column id); each hop joins only the newest nodes."""
    arcs = both_ways(edges)
    found = seeds.select("id", F.lit(0).alias("distance")).distinct()
    newest = found
    for d in range(1, hops + 1):
        step = newest.join(arcs, newest["id"] == arcs["src"]).select(F.col("dst").alias("id")).distinct()
        newest = step.join(found, "id", "left_anti").withColumn("distance", F.lit(d))
        found = found.union(newest)
    return found


def expand(edges: DataFrame, seeds: DataFrame, hops: int, most: int, allowed: DataFrame | None = None) -> DataFrame:
    """The `most` nearest nodes that are no seeds, by distance, then degree, then id; only allowed ones."""
    near = distances(edges, seeds, hops).where("distance > 0")
    if allowed is not None:
        near = near.join(allowed.select("id"), "id", "left_semi")
    return near.join(degrees(edges), "id", "left").orderBy("distance", F.desc("degree"), "id").limit(most)


def group_distances(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(group, id, distance) of all nodes within `hops` of the seeds (group, id) of each group, for all groups in one run.

    The frontier is keyed by group and node; each hop joins only what the hop before found and is written, so that no hop is
    worked out twice.
    """
    arcs = both_ways(edges)
    found = newest = cut(seeds.select("group", "id", F.lit(0).alias("distance")).distinct())
    for d in range(1, hops + 1):
        step = newest.join(arcs, newest["id"] == arcs["src"]).select("group", F.col("dst").alias("id")).distinct()
        newest = cut(step.join(found, ["group", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if newest.isEmpty():
            break
        found = found.union(newest)
    return found


def bridge_lengths(edges: DataFrame, seeds: DataFrame, bridges: DataFrame, hops: int) -> DataFrame:
    """(distance, n): how many bridges (group, id) lie how far from the seeds of their group, null beyond `hops`."""
    near = group_distances(edges, seeds, hops)
    return bridges.select("group", "id").join(near, ["group", "id"], "left").groupBy("distance").agg(F.count("*").alias("n"))


def expand_groups(edges: DataFrame, seeds: DataFrame, hops: int, most: int) -> DataFrame:
    """(group, id, rank): the seeds (group, id, rank) and after them the `most` nearest other nodes, by distance, degree, id."""
    near = group_distances(edges, seeds, hops).where("distance > 0").join(degrees(edges), "id", "left")
    after = F.row_number().over(W.partitionBy("group").orderBy("distance", F.desc("degree"), "id"))
    more = near.withColumn("rank", after).where(F.col("rank") <= most)
    last = seeds.groupBy("group").agg(F.max("rank").alias("last"))
    return seeds.select("group", "id", "rank").unionByName(more.join(last, "group").select("group", "id", (F.col("rank") + F.col("last")).alias("rank")))


def arm_recall(arms: dict[str, DataFrame], gold: DataFrame, budget: int) -> DataFrame:
    """(arm, recall): the mean over the groups of gold (group, id) of the share that an arm (group, id, rank) has in its first `budget`."""
    first = None
    for name, rows in arms.items():
        rows = rows.where(F.col("rank") <= budget).select(F.lit(name).alias("arm"), "group", "id")
        first = rows if first is None else first.union(rows)
    wanted = gold.select("group", "id").distinct()
    hits = first.join(wanted, ["group", "id"]).groupBy("arm", "group").agg(F.count_distinct("id").alias("hits"))
    every = wanted.groupBy("group").agg(F.count("*").alias("n")).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    return every.join(hits, ["arm", "group"], "left").groupBy("arm").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def components(nodes: DataFrame, id: str, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. Labels move to the least neighbour's and jump to the label's label."""
    labels = cut(nodes.select(F.col(id).alias("id"), F.col(id).alias("label")))
    arcs = cut(both_ways(edges))
    while True:
        least = arcs.join(labels, arcs["dst"] == labels["id"]).groupBy(F.col("src").alias("id")).agg(F.min("label").alias("m"))
        moved = labels.join(least, "id", "left").select("id", F.least("label", "m").alias("label"))
        over = moved.select(F.col("id").alias("l"), F.col("label").alias("ll"))
        after = cut(moved.join(over, moved["label"] == over["l"], "left").select("id", F.least("label", "ll").alias("label")))
        if after.exceptAll(labels).isEmpty():
            return after.select("id", F.col("label").alias("component"))
        labels = after


def cross_edges(edges: DataFrame, nodes: DataFrame, id: str, domain: str) -> DataFrame:
    """Edges between nodes of different domains."""
    a, b = nodes.select(F.col(id).alias("src"), F.col(domain).alias("src_domain")), nodes.select(F.col(id).alias("dst"), F.col(domain).alias("dst_domain"))
    return edges.join(a, "src").join(b, "dst").where("src_domain <> dst_domain")
