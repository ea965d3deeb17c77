"""The shape of a graph: its report, labels of categories, loose nodes, and plans of another order applied to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, hierarchy, mutate
from .integrity import CROWDED, active


def report(nodes: DataFrame, edges: DataFrame, owner: str, hubs: int = 8) -> DataFrame:
    """(section, name, n): counts, depth of the tree below the owner and on average, nodes by type, direct children of categories, and the widest hubs."""
    links = edges.where("relation = 'part_of'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")).distinct()
    row = lambda s, n, v: F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.cast("double").alias("n"))
    count = nodes.agg(F.explode(F.array(row("total", "nodes", F.count("*")), row("total", "categories", F.count_if(F.col("type") == "category")))).alias("r")).select("r.*")
    ends = edges.agg(F.explode(F.array(row("total", "edges", F.count("*")))).alias("r")).select("r.*")
    below = hierarchy.closure(links).where(F.col("ancestor_id") == owner).groupBy("node_id").agg(F.min("steps").alias("d"))
    depth = below.agg(F.explode(F.array(row("depth", "max", F.coalesce(F.max("d"), F.lit(0))), row("depth", "mean", F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 6)))).alias("r")).select("r.*")
    kinds = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), F.col("type").alias("name"), F.col("n").cast("double").alias("n"))
    cats = nodes.where("type = 'category'").select("id")
    size = cats.join(links.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n")), "id", "left").select(F.lit("category").alias("section"), F.col("id").alias("name"), F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    wide = graph.degrees(edges).join(nodes.select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(hubs).select(F.lit("hub").alias("section"), F.col("id").alias("name"), F.col("degree").cast("double").alias("n"))
    return count.unionByName(ends).unionByName(depth).unionByName(kinds).unionByName(size).unionByName(wide)


def category_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, label) of active categories: a name, or `area > name` (level 1) below another category; of several parents the oldest counts."""
    c = active(nodes).where("type = 'category'").select("id", "name")
    up = graph.first_parent(edges).join(c.select(F.col("id").alias("parent"), F.col("name").alias("above")), "parent")
    x = c.join(up.select(F.col("child").alias("id"), "above"), "id", "left")
    return x.select(F.when(F.col("above").isNull(), 0).otherwise(1).alias("level"), F.when(F.col("above").isNull(), F.col("name")).otherwise(F.concat("above", F.lit(" > "), "name")).alias("label"))


def connected(nodes: DataFrame, edges: DataFrame, suggest: Callable[[DataFrame], DataFrame], as_of: float, most: int = 5, least_weight: float = 0.3) -> DataFrame:
    """Edges to add for nodes without any: `suggest` (a model's boundary) takes (id, name, content) of at most `most` and gives (id, target, relation) with names; unknown names and the node itself are left out."""
    lone = graph.isolated(active(nodes).where(F.col("weight") >= least_weight), edges).orderBy("created_at", "id").limit(most).select("id", "name", "content")
    by_name = nodes.groupBy(F.lower("name").alias("_k")).agg(F.min_by("id", F.struct("created_at", "id")).alias("target_id"))
    s = suggest(lone).select("id", F.lower("target").alias("_k"), F.coalesce(F.nullif("relation", F.lit("")), F.lit("relates_to")).alias("relation")).join(by_name, "_k")
    batch = s.where("id <> target_id").select(F.col("id").alias("source_id"), "target_id", "relation")
    return mutate.upsert_edges(nodes, edges, batch, as_of)


def subgrouped(nodes: DataFrame, edges: DataFrame, plan: DataFrame, threshold: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """New categories (id, name) and moved members (child, old, new) of a plan (category_id, group, member) for categories with more than `threshold` children that are no categories.

    Groups without a name, under their category's own name or with fewer than two known members are skipped; a group whose name a
    category already has uses that one.  Names are compared whatever their case.
    """
    kids = graph.children(edges).join(active(nodes).where("type <> 'category'").select(F.col("id").alias("child"), F.lower(F.trim("name")).alias("k")), "child").join(nodes.where("type = 'category'").select(F.col("id").alias("parent"), F.lower(F.trim("name")).alias("cat")), "parent")
    big = kids.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > threshold).select("parent")
    p = plan.select(F.col("category_id").alias("parent"), F.trim("group").alias("group"), F.lower(F.trim("member")).alias("k")).where("`group` <> ''").distinct()
    m = kids.join(big, "parent", "left_semi").join(p, ["parent", "k"]).where("lower(`group`) <> cat")
    m = m.withColumn("_r", F.row_number().over(W.partitionBy("parent", "child").orderBy("group"))).where("_r = 1")  # a member goes to one group
    ok = m.groupBy("parent", "group").agg(F.count("*").alias("n")).where("n >= 2").select("parent", "group")
    m = m.join(ok, ["parent", "group"], "left_semi")
    have = nodes.where("type = 'category'").groupBy(F.lower(F.trim("name")).alias("g")).agg(F.min("id").alias("known"))
    m = m.withColumn("g", F.lower("group")).join(have, "g", "left").withColumn("new", F.coalesce("known", F.concat(F.lit("category:"), F.col("g"))))
    new = m.where("known is null").groupBy(F.col("new").alias("id")).agg(F.min("group").alias("name"))
    return new, m.select("child", F.col("parent").alias("old"), "new")
