"""Incremental file index and the links between files and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocab import FILE_KINDS, OTHER_KIND, lookup

CONTAIN_KINDS = ["person", "org", "project", "course", "application", "profile", "topic", "app", "area", "doc"]


def changes(current: DataFrame, previous: DataFrame, key: str = "path", sha: str = "sha") -> DataFrame:
    """(key, status): added, updated, unchanged or removed, by content hash."""
    c = current.select(F.col(key), F.col(sha).alias("_new")).dropDuplicates([key])
    p = previous.select(F.col(key), F.col(sha).alias("_old")).dropDuplicates([key])
    j = c.join(p, key, "full_outer")
    return j.select(key, F.when(F.col("_old").isNull() & F.col("_new").isNotNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("updated").alias("status"))


def upserted(current: DataFrame, previous: DataFrame, key: str = "path") -> DataFrame:
    """The new index: unchanged rows keep their vector but take the current kind, updated ones lose it, removed ones go."""
    old = previous.select(key, F.col("sha").alias("_sha"), F.col("embedding").alias("_emb"))
    return current.join(old, key, "left").withColumn("embedding", F.when(F.col("sha") == F.col("_sha"), F.col("_emb"))).drop("_sha", "_emb")


def file_keys(files: DataFrame) -> DataFrame:
    """(path, kind, key, how): normalised titles and aliases."""
    prio = lookup(FILE_KINDS, F.col("kind"), OTHER_KIND)
    t = files.select("path", "kind", prio.alias("prio"), X.norm_name(F.col("title")).alias("key"), F.lit("name").alias("how"))
    a = files.select("path", "kind", prio.alias("prio"), F.explode("aliases").alias("a")).select("path", "kind", "prio", X.norm_name(F.col("a")).alias("key"), F.lit("alias").alias("how"))
    return t.unionByName(a).where("key <> ''").groupBy("path", "kind", "prio", "key").agg(F.max("how").alias("how"))


def node_keys(nodes: DataFrame, schools: list[str] = ()) -> DataFrame:
    """(node_id, key): normalised names, without a leading school and without a closing bracket and years too."""
    n = nodes.where("archived = 0 and type <> 'category'").select(F.col("id").alias("node_id"), X.norm_name(F.col("name")).alias("k"), X.bare_name(F.col("name")).alias("b"))
    keys = [F.col("k"), F.col("b")]
    if schools:
        keys.append(F.regexp_replace("k", rf"^(?:{'|'.join(schools)})\s+", ""))
    return n.select("node_id", F.explode(F.array_distinct(F.array(*keys))).alias("key")).where("key <> ''")


def exact_links(files: DataFrame, nodes: DataFrame, schools: list[str] = ()) -> DataFrame:
    """(path, node_id, how): files whose title or alias is a node's name."""
    return file_keys(files).join(node_keys(nodes, schools), "key").groupBy("path", "node_id").agg(F.max("how").alias("how"))


def contains_links(files: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(path, node_id): for nodes without an exact link the file with the longest phrase of several words inside the node's name, then the best kind, then path.

    Names are cut into their word runs, so the phrase join is an equality.
    """
    n = nodes.where("archived = 0 and type <> 'category'").select(F.col("id").alias("node_id"), X.ascii_words(F.col("name")).alias("w")).join(linked.select("node_id").distinct(), "node_id", "left_anti").where(F.size("w") >= 2)
    runs = n.select("node_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i")).select("node_id", F.explode(F.transform(F.sequence(F.lit(2), F.size("w") - F.col("i") + 1), lambda k: F.array_join(F.slice("w", F.col("i"), k), " "))).alias("key")).distinct()
    f = file_keys(files).where(F.col("kind").isin(CONTAIN_KINDS) & F.contains("key", F.lit(" ")))
    return f.join(runs, "key").groupBy("node_id").agg(F.min_by("path", F.struct((-F.length("key")).alias("l"), "prio", "path")).alias("path")).select("path", "node_id")


def inherited_links(nodes: DataFrame, edges: DataFrame, linked: DataFrame, owner: str | None = None, hops: int = 8) -> DataFrame:
    """(path, node_id): nodes without a link take the file of their nearest linked ancestor within `hops`; the way up stops at categories and the owner."""
    from .graph import first_parent

    from ..workspace import Workspace

    ws = Workspace(nodes.sparkSession, "inherited")
    best = linked.groupBy("node_id").agg(F.min_by("path", F.struct("prio", "path")).alias("path"))
    best = ws.save(best)
    stop = nodes.where(F.col("type") == "category").select("id")
    up = first_parent(edges).join(stop.select(F.col("id").alias("parent")), "parent", "left_anti")
    if owner:
        up = up.where(F.col("parent") != owner)
    up = ws.save(up)
    start = nodes.where("archived = 0 and type <> 'category'").select(F.col("id").alias("node_id")).join(best.select("node_id"), "node_id", "left_anti")
    level, out = start.select("node_id", F.col("node_id").alias("at")), None
    for _ in range(hops):
        level = ws.save(level.join(up, F.col("at") == F.col("child")).select("node_id", F.col("parent").alias("at")))
        hit = level.join(best.select(F.col("node_id").alias("at"), "path"), "at").select("path", "node_id")
        out = hit if out is None else out.unionByName(hit)
        level = level.join(best.select(F.col("node_id").alias("at")), "at", "left_anti")
    return out


def linked_files(files: DataFrame, nodes: DataFrame, edges: DataFrame, owner: str | None = None) -> DataFrame:
    """(path, node_id, how) of all three passes, each for nodes still without a link."""
    prio = files.select("path", lookup(FILE_KINDS, F.col("kind"), OTHER_KIND).alias("prio"))
    a = exact_links(files, nodes)
    b = contains_links(files, nodes, a).withColumn("how", F.lit("contains"))
    both = a.unionByName(b)
    c = inherited_links(nodes, edges, both.join(prio, "path"), owner).withColumn("how", F.lit("inherited"))
    return both.unionByName(c)


def best_path(file_nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, path): of a node's files the one of the best kind, then the smallest path."""
    p = files.select("path", lookup(FILE_KINDS, F.col("kind"), OTHER_KIND).alias("prio"))
    return file_nodes.join(p, "path").groupBy("node_id").agg(F.min_by("path", F.struct("prio", "path")).alias("path"))
