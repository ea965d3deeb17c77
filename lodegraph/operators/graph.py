"""Degrees, hubs, traversal, trees and the shape of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace


def ends(edges: DataFrame) -> DataFrame:
    """(id, other): every edge from both of its ends; a link to itself counts twice."""
    return edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionAll(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other")))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, neighbours): edge ends counted with multiplicity, and distinct neighbours."""
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"), F.count_distinct("other").alias("neighbours"))


def hub_cap(edges: DataFrame, factor: float = 2.0, least: int = 5) -> DataFrame:
    """One row: mean degree and the degree from which a node is a hub."""
    return degrees(edges).agg(F.avg("degree").alias("mean_degree")).select("mean_degree", F.greatest(F.lit(least), F.rint(F.col("mean_degree") * factor).cast("int")).alias("hub_cap"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, hub: int = 0, least_weight: float = 0.0) -> DataFrame:
    """(id, depth): undirected breadth-first search from the seeds.

    Nodes that don't exist, are archived or lighter than `least_weight` are neither returned nor expanded.  Other nodes than
    seeds with more than `hub` distinct neighbours are returned but not expanded; 0 switches that off.
    One join per level, each stored, so the lineage stays short.
    """
    ws = Workspace(nodes.sparkSession, "bfs")
    ok = nodes.where((F.col("archived") == 0) & (F.col("weight") >= least_weight)).select("id")
    both = ends(edges).where("id <> other").distinct()
    wide = degrees(edges).where(F.col("neighbours") > hub).select("id") if hub > 0 else None
    level = seeds.select("id").distinct().join(ok, "id", "left_semi")
    seen = ws.save(level.withColumn("depth", F.lit(0)))
    frontier = seen.select("id")
    for d in range(1, depth + 1):
        grown = frontier if wide is None or d == 1 else frontier.join(wide, "id", "left_anti")
        nxt = grown.join(both, "id").select(F.col("other").alias("id")).distinct().join(ok, "id", "left_semi").join(seen, "id", "left_anti")
        nxt = ws.save(nxt.withColumn("depth", F.lit(d)))
        seen = seen.unionByName(nxt)
        frontier = nxt.select("id")
    return seen


def children(edges: DataFrame) -> DataFrame:
    """(parent, child) of distinct part_of links."""
    return edges.where("relation = 'part_of'").select(F.col("target_id").alias("parent"), F.col("source_id").alias("child")).distinct()


def first_parent(edges: DataFrame) -> DataFrame:
    """(child, parent): of several part_of links the oldest, then the smallest id, counts."""
    e = edges.where("relation = 'part_of'")
    return e.groupBy(F.col("source_id").alias("child")).agg(F.min_by("target_id", F.struct("created_at", "id")).alias("parent"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges).select("id").distinct(), "id", "left_anti")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): every node takes the label most of its neighbours have, the smallest of several, for a number of rounds.

    A different algorithm from modularity optimisation, offered for colouring.  Labels are counted by key before they are ranked,
    so a hub's neighbours are never gathered.
    """
    ws = Workspace(edges.sparkSession, "labels")
    both = ws.save(ends(edges).where("id <> other").distinct())
    label = ws.save(both.select("id").distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id", "label").count()
        new = ws.save(votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label")))
        ws.drop(label)
        label = new
    return label.withColumnRenamed("label", "community")


def tree_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, depth, sort_path): pre-order of the part_of forest by importance, then name, then id, of nodes with one chain of parents."""
    from .hierarchy import closure

    one = first_parent(edges).select("child", "parent")
    c = closure(one)
    named = nodes.select(F.col("id").alias("_id"), F.concat(F.lpad(F.floor((1 - F.coalesce("importance", F.lit(0.0))) * 1e6).cast("string"), 7, "0"), F.coalesce("name", F.lit("")), F.col("id")).alias("_k"))
    steps = c.unionByName(c.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).cast("long").alias("steps")).distinct())
    keyed = steps.join(named, F.col("ancestor_id") == F.col("_id"))
    return keyed.groupBy("node_id").agg(F.max("steps").alias("depth"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("o"), F.col("_k").alias("k")))), lambda x: x["k"]), "/").alias("sort_path")).withColumnRenamed("node_id", "id")


def subtree_sizes(links_closure: DataFrame) -> DataFrame:
    """(id, descendants) from (node_id, ancestor_id, steps)."""
    return links_closure.groupBy(F.col("ancestor_id").alias("id")).agg(F.count_distinct("node_id").alias("descendants"))


def display(nodes: DataFrame) -> DataFrame:
    """Size and colour group of every node in a drawing."""
    return nodes.select("id", F.coalesce("name", F.lit("")).alias("label"), "type", F.round(8 + 22 * F.coalesce("weight", F.lit(0.0)), 3).alias("size"), F.col("archived").cast("boolean").alias("faded"))


def drawing_edges(edges: DataFrame) -> DataFrame:
    """Edges of a drawing with a stable id, one per triple, the heaviest."""
    e = edges.withColumn("edge_id", F.concat_ws("|", "source_id", "target_id", "relation"))
    return e.groupBy("edge_id", "source_id", "target_id", "relation").agg(F.max("weight").alias("weight"))


def ranked_per_type(nodes: DataFrame, k: int = 3) -> DataFrame:
    w = W.partitionBy("type").orderBy(F.desc("importance"), F.desc("weight"), "id")
    return nodes.where("archived = 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("type", "rank", "id")
