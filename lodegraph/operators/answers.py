"""Retrieval composites: evidence, context, digest, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph


def neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int = 12) -> DataFrame:
    """(id, weight): active nodes one step from the seeds, without the seeds, heaviest first."""
    near = graph.ends(edges).join(seeds.select("id").distinct(), "id").select(F.col("other").alias("id")).distinct().join(seeds.select("id"), "id", "left_anti")
    return nodes.where("archived = 0").select("id", "weight").join(near, "id").orderBy(F.desc("weight"), "id").limit(limit)


def evidence(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, files: DataFrame) -> DataFrame:
    """(rank, kind, ref, text) for an answer: seed nodes (id, rank), their neighbours, then files (path, title, score)."""
    s = seeds.select("id", "rank")
    a = s.join(nodes.select("id", "name", "type", "content"), "id").select((F.col("rank")).alias("rank"), F.lit("node").alias("kind"), F.col("id").alias("ref"), F.concat(F.lit("["), "type", F.lit("] "), "name", F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, 140)).alias("text"))
    n = neighbours(nodes, edges, s).join(nodes.select("id", "name", "type"), "id")
    b = n.select((1000 + F.row_number().over(W.orderBy(F.desc("weight"), "id"))).alias("rank"), F.lit("neighbour").alias("kind"), F.col("id").alias("ref"), F.concat(F.lit("["), "type", F.lit("] "), "name").alias("text"))  # at most 12 rows
    c = files.select((2000 + F.row_number().over(W.orderBy(F.desc("score"), "path"))).alias("rank"), F.lit("file").alias("kind"), F.col("path").alias("ref"), F.coalesce("title", F.lit("")).alias("text"))  # at most k rows
    return a.unionByName(b).unionByName(c)


def context(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(type, n, names): a set of nodes by type, names by importance; the material of a summary."""
    x = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    return x.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("importance", F.lit(0.0))).alias("o"), "name"))), lambda s: s["name"]), "; ").alias("names"))


def top_of_mind(nodes: DataFrame, owner: str | None, limit: int = 6) -> DataFrame:
    x = nodes.where("archived = 0 and type not in ('category', 'task')")
    if owner:
        x = x.where(F.col("id") != owner)
    score = F.round(F.coalesce("importance", F.lit(0.0)) * F.col("weight"), 6)
    return x.select("id", "name", score.alias("score"), "importance").orderBy(F.desc("score"), F.desc("importance"), "name", "id").limit(limit)


def breakdown(nodes: DataFrame, edges: DataFrame, owner: str) -> DataFrame:
    """(id, descendants) of the categories right below the owner; archived descendants count, ids that are no nodes don't."""
    from .hierarchy import closure

    links = edges.where("relation = 'part_of'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")).distinct()
    known = nodes.select(F.col("id").alias("_id"))
    links = links.join(known, F.col("child") == F.col("_id"), "left_semi").join(known, F.col("parent") == F.col("_id"), "left_semi")
    top = links.where(F.col("parent") == owner).join(nodes.where("type = 'category'").select(F.col("id").alias("child")), "child", "left_semi").select(F.col("child").alias("id"))
    size = graph.subtree_sizes(closure(links))
    return top.join(size, "id", "left").select("id", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def cited(answer: Column, ref: Column) -> Column:
    """A ledger id counts if it stands alone, any other source if it occurs in the answer."""
    ledger = ref.rlike(r"^[LD]-\d{3}$")
    alone = F.regexp_like(answer, F.concat(F.lit(r"(?<![\w-])"), ref, F.lit(r"(?![\w-])")))
    return F.when(ledger, alone).otherwise(F.contains(F.lower(answer), F.lower(ref)))


def display_line() -> Column:
    """`[type] name (weight w.ww): content -> path`."""
    return F.concat(F.lit("["), F.col("type"), F.lit("] "), F.coalesce("name", F.lit("")), F.lit(" (weight "), F.format_string("%.2f", F.col("weight")), F.lit(")"), F.when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit(": "), F.col("content"))).otherwise(""), F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit(" -> "), F.col("path"))).otherwise(""))
