"""Decay of a whole graph, touches and their spread to ancestors.  Each transform returns new tables and an audit; nothing is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decay as D


def effective_life(as_of: float) -> Column:
    return D.half_life(F.col("half_life_days"), F.col("type"), F.col("importance"), F.col("content"), as_of)


def decayed_nodes(nodes: DataFrame, as_of: float) -> DataFrame:
    """Nodes with `fate`: deleted (archived and untouched for more than 7 days), kept (archived), archived or updated, and their new weight.

    Null clocks count as the other clock, and as `as_of` if both are null, so a second run at the same time changes nothing.
    """
    since = F.coalesce(F.greatest("last_decayed", "last_accessed"), F.lit(as_of))
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), D.weight_at(F.col("weight"), since, effective_life(as_of), F.col("importance"), as_of)))
    idle = F.coalesce((F.lit(as_of) - F.col("last_accessed")) / D.DAY > D.DELETE_AFTER_DAYS, F.lit(False))
    out = nodes.withColumn("new_weight", F.when(F.col("archived") == 1, F.col("weight")).otherwise(w))
    return out.withColumn("fate", F.when((F.col("archived") == 1) & idle, "deleted").when(F.col("archived") == 1, "kept").when(F.col("new_weight") < D.ARCHIVE_BELOW, "archived").otherwise("updated"))


def decayed_edges(edges: DataFrame, as_of: float) -> DataFrame:
    """Edges with their new weight and `fate`: pruned or updated; structural ones are clamped, never pruned."""
    since = F.coalesce(F.greatest("last_decayed", "last_reinforced"), F.lit(as_of))
    days = F.greatest(F.lit(0.0), (F.lit(as_of) - since) / D.DAY)
    w = F.col("weight") * F.pow(F.lit(0.5), days / D.edge_half_life(F.col("reinforcement_count")))
    spine = F.col("relation") == "part_of"
    out = edges.withColumn("_w", w)
    out = out.withColumn("fate", F.when((F.col("_w") < D.EDGE_LEAST) & ~F.coalesce(spine, F.lit(False)), "pruned").otherwise("updated"))
    return out.withColumn("new_weight", F.when(spine, F.greatest("_w", F.lit(D.EDGE_LEAST))).otherwise(F.col("_w"))).drop("_w")


def run(nodes: DataFrame, edges: DataFrame, as_of: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges after decay at `as_of`, and one row of counts."""
    n = decayed_nodes(nodes, as_of)
    gone = n.where("fate = 'deleted'").select(F.col("id").alias("_gone"))
    alive = edges.join(gone, F.col("source_id") == F.col("_gone"), "left_anti").join(gone, F.col("target_id") == F.col("_gone"), "left_anti")
    e = decayed_edges(alive, as_of)
    touched = F.col("fate").isin("updated", "archived")
    new_nodes = n.where("fate <> 'deleted'").withColumn("weight", F.col("new_weight")).withColumn("archived", F.when(F.col("fate") == "archived", 1).otherwise(F.col("archived"))).withColumn("last_decayed", F.when(touched, F.lit(as_of)).otherwise(F.col("last_decayed"))).drop("new_weight", "fate")
    new_edges = e.where("fate = 'updated'").withColumn("weight", F.col("new_weight")).withColumn("last_decayed", F.lit(as_of)).drop("new_weight", "fate")
    c = n.agg(F.count_if(F.col("fate") == "updated").alias("updated"), F.count_if(F.col("fate") == "archived").alias("archived"), F.count_if(F.col("fate") == "deleted").alias("deleted"))
    p = e.agg(F.count_if(F.col("fate") == "pruned").alias("edges_pruned"))
    audit = c.withColumn("_one", F.lit(1)).join(p.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return new_nodes, new_edges, audit


def at_risk(nodes: DataFrame, as_of: float, limit: int = 5) -> DataFrame:
    """Active nodes nearest to their archiving, soonest first."""
    life = effective_life(as_of)
    left = D.days_left(F.col("weight"), life, F.col("importance"))
    return nodes.where(f"archived = 0 and weight >= {D.ARCHIVE_BELOW}").select("id", "name", "type", "weight", left.alias("days_left")).where(F.col("days_left") < D.INF).orderBy("days_left", "id").limit(limit)


def ancestors(edges: DataFrame, seeds: DataFrame, most: int = 3) -> DataFrame:
    """(id, depth): nodes at most `most` part_of steps above the seeds, with the least number of steps; seeds have depth 0."""
    up = edges.where("relation = 'part_of'").select(F.col("source_id").alias("id"), F.col("target_id").alias("parent")).distinct()
    level = seeds.select("id").distinct()
    every = level.withColumn("depth", F.lit(0))
    for d in range(1, most + 1):
        level = level.join(up, "id").select(F.col("parent").alias("id")).distinct()
        every = every.unionByName(level.withColumn("depth", F.lit(d)))
    return every.groupBy("id").agg(F.min("depth").alias("depth"))


def touched(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, as_of: float) -> DataFrame:
    """Nodes after a touch of the seeds: weight 1, one access more and the clock now; ancestors up to three levels get the clock and at least 0.6 ** depth."""
    a = ancestors(edges, seeds).withColumnRenamed("id", "_id")
    j = nodes.join(a, F.col("id") == F.col("_id"), "left")
    hit = F.col("depth").isNotNull()
    w = F.when(F.col("depth") == 0, 1.0).when(hit, F.greatest("weight", F.pow(F.lit(0.6), F.col("depth")))).otherwise(F.col("weight"))
    return j.withColumn("weight", w).withColumn("access_count", F.when(F.col("depth") == 0, F.col("access_count") + 1).otherwise(F.col("access_count"))).withColumn("last_accessed", F.when(hit, F.lit(as_of)).otherwise(F.col("last_accessed"))).drop("_id", "depth")
