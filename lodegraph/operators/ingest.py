"""From extracted records to graph changes.  The model is a boundary: any function from batches of texts to batches of records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.vocab import node_type, relation

RECORD = "nodes array<struct<name:string,type:string,content:string,confidence:double,importance:double,parent:string>>, edges array<struct<source:string,target:string,relation:string>>, tasks array<string>"


def capitalised_extractor(texts: pd.Series) -> list[dict]:
    """A deterministic stand-in for a model: capitalised words of a text become concepts, neighbours are related, lines that open with TODO become tasks."""
    import re

    out = []
    for t in texts:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", t or "")))
        out.append({"nodes": [{"name": n, "type": "concept", "content": (t or "")[:120], "confidence": 0.8, "importance": 0.5, "parent": None} for n in names], "edges": [{"source": a, "target": b, "relation": "relates to"} for a, b in zip(names, names[1:])], "tasks": re.findall(r"(?m)^TODO:? (.+)$", t or "")})
    return out


def extracted(texts: DataFrame, key: str, text: str, extractor: Callable[[pd.Series], list[dict]] = capitalised_extractor, size: int = 4000) -> DataFrame:
    """(key, chunk, nodes, edges, tasks): secrets are masked and texts chunked before the extractor sees them."""
    pieces = texts.select(F.col(key).cast("string").alias("key"), F.posexplode(X.chunks(X.redact_secrets(F.col(text)), size)).alias("chunk", "piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = extractor(b["piece"])
            yield pd.DataFrame({"key": b["key"], "chunk": b["chunk"], "nodes": [x["nodes"] for x in r], "edges": [x["edges"] for x in r], "tasks": [x["tasks"] for x in r]})

    return pieces.mapInPandas(run, f"key string, chunk int, {RECORD}")


def candidate_nodes(records: DataFrame) -> DataFrame:
    """One row per text and name (whatever case): vague names go, course codes are concepts, the first chunk's record stays."""
    x = records.select("key", "chunk", F.posexplode("nodes").alias("pos", "n")).select("key", "chunk", "pos", "n.*")
    x = x.where(~X.is_vague(F.col("name")) & (F.trim("name") != "")).withColumn("type", X.course_type(F.col("name"), node_type(F.col("type"))))
    cols = ["name", "type", "content", "confidence", "importance", "parent"]
    return x.groupBy("key", F.lower("name").alias("name_key")).agg(F.min_by(F.struct(*cols), F.struct("chunk", "pos")).alias("n")).select("key", "name_key", "n.*")


def candidate_edges(records: DataFrame) -> DataFrame:
    x = records.select("key", F.explode("edges").alias("e")).select("key", F.lower("e.source").alias("source_key"), F.lower("e.target").alias("target_key"), relation(F.col("e.relation")).alias("relation"))
    return x.where("source_key <> target_key").distinct()


def tasks(records: DataFrame) -> DataFrame:
    """(key, text): tasks of a text, each once whatever its case, the first spelling."""
    x = records.select("key", "chunk", F.posexplode("tasks").alias("pos", "text")).where("trim(text) <> ''")
    return x.groupBy("key", F.lower("text").alias("low")).agg(F.min_by("text", F.struct("chunk", "pos")).alias("text")).select("key", "text")


def diverted(records: DataFrame) -> DataFrame:
    """Records whose nodes of type task became tasks and lost the edges that touch them; tasks are distinct whatever their case."""
    is_task = lambda n: F.lower(n["type"]) == "task"
    names = F.transform(F.filter("nodes", is_task), lambda n: F.lower(n["name"]))
    every = F.concat(F.coalesce("tasks", F.array().cast("array<string>")), F.transform(F.filter("nodes", is_task), lambda n: n["name"]))
    once = F.filter(every, lambda t, i: ~F.exists(F.slice(every, F.lit(1), i), lambda u: F.lower(u) == F.lower(t)))
    return records.select("key", "chunk", F.filter("nodes", lambda n: ~F.coalesce(is_task(n), F.lit(False))).alias("nodes"), F.filter("edges", lambda e: ~F.array_contains(names, F.lower(e["source"])) & ~F.array_contains(names, F.lower(e["target"]))).alias("edges"), once.alias("tasks"))


def without_source_nodes(records: DataFrame, names: list[str]) -> DataFrame:
    """Records without nodes that only name where the text came from, and without their edges."""
    low = F.array(*[F.lit(n.lower()) for n in names]) if names else F.array().cast("array<string>")
    return records.withColumn("nodes", F.filter("nodes", lambda n: ~F.array_contains(low, F.lower(n["name"])))).withColumn("edges", F.filter("edges", lambda e: ~F.array_contains(low, F.lower(e["source"])) & ~F.array_contains(low, F.lower(e["target"]))))


def resolved(cands: DataFrame, nodes: DataFrame, vectors: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """(name_key, id, how): existing node of every candidate name: the same name whatever case, else the nearest vector (name_key, type, v) of its type from `least` on; null is new.

    Of several nodes of a name the oldest counts.  The vector join is an equality on type.
    """
    have = nodes.where("archived = 0").groupBy(F.lower("name").alias("name_key")).agg(F.min_by("id", F.struct("created_at", "id")).alias("by_name"))
    x = cands.select("name_key", "type").distinct().join(have, "name_key", "left")
    if vectors is None:
        return x.groupBy("name_key").agg(F.min("by_name").alias("id")).select("name_key", "id", F.when(F.col("id").isNotNull(), "name").otherwise("new").alias("how"))
    todo = x.where("by_name is null").select("name_key", "type").join(vectors.select("name_key", "v"), "name_key")
    v = nodes.where("archived = 0 and embedding is not null").select("id", "type", "embedding")
    near = todo.join(v, "type").select("name_key", "id", F.round(V.cosine(F.col("v"), F.col("embedding")), 9).alias("c")).where(F.col("c") >= least).groupBy("name_key").agg(F.min_by("id", F.struct((-F.col("c")).alias("o"), "id")).alias("by_vector"))
    return x.groupBy("name_key").agg(F.min("by_name").alias("by_name")).join(near, "name_key", "left").select("name_key", F.coalesce("by_name", "by_vector").alias("id"), F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_vector").isNotNull(), "vector").otherwise("new").alias("how"))


# The category that a parentless node of each type goes to.
HOME = {"person": "Relationships", "organization": "Organizations", "skill": "Skills", "project": "Projects", "event": "Events", "artifact": "Artifacts", "fact": "Knowledge", "insight": "Insights", "concept": "Knowledge"}
LEAVES = ["fact", "event", "artifact", "insight", "task"]


def attached(cands: DataFrame, edges: DataFrame) -> DataFrame:
    """(name_key, parent, how): parent of every candidate that is no category: the last segment of an explicit parent unless vague, else for leaves the only
    neighbour by an edge, else the category of its type."""
    from ..functions.vocab import lookup

    explicit = F.trim(F.element_at(F.split(F.coalesce("parent", F.lit("")), ">"), -1))
    explicit = F.when((explicit != "") & ~X.is_vague(explicit), explicit)
    both = edges.select(F.col("source_key").alias("name_key"), F.col("target_key").alias("o")).unionByName(edges.select(F.col("target_key").alias("name_key"), F.col("source_key").alias("o")))
    one = both.groupBy("name_key").agg(F.count_distinct("o").alias("n"), F.min("o").alias("o")).where("n = 1").select("name_key", "o")
    x = cands.where("type <> 'category'").groupBy("name_key").agg(F.min("type").alias("type"), F.min(explicit).alias("explicit")).join(one, "name_key", "left")
    edge_parent = F.when(F.col("type").isin(LEAVES), F.col("o"))
    return x.select("name_key", F.coalesce("explicit", edge_parent, lookup(HOME, F.col("type"), "Knowledge")).alias("parent"), F.when(F.col("explicit").isNotNull(), "explicit").when(edge_parent.isNotNull(), "neighbour").otherwise("type").alias("how"))


def embedded(nodes: DataFrame, embedder: Callable[[pd.Series], list[list[float]]]) -> DataFrame:
    """(id, embedding) of nodes without a vector: the embedder sees `name. content`."""
    todo = nodes.where("embedding is null").select("id", F.concat_ws(". ", "name", F.coalesce("content", F.lit(""))).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "embedding": embedder(b["text"])})

    return todo.mapInPandas(run, "id string, embedding array<float>")


def log_row(texts: DataFrame, key: str, text: str, source: str, as_of: float, added: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows of the ingestion log: the opening 2 000 characters and the names and edges added (key, name) and (key, edge) as JSON lists."""
    n = added.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list("name"))).alias("nodes_added"))
    e = linked.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list("edge"))).alias("edges_added"))
    x = texts.select(F.col(key).cast("string").alias("key"), F.substring(F.col(text), 1, 2000).alias("raw_text"), F.col(source).alias("source"), F.lit(as_of).alias("ingested_at"))
    return x.join(n, "key", "left").join(e, "key", "left").select(F.col("key").alias("id"), "raw_text", "source", "ingested_at", F.coalesce("nodes_added", F.lit("[]")).alias("nodes_added"), F.coalesce("edges_added", F.lit("[]")).alias("edges_added"))


def hints(nodes: DataFrame, found: DataFrame, near: DataFrame, each: int = 40, limit: int = 80) -> DataFrame:
    """(id, rank): keyword hits, then near vectors, then the most important nodes, each node once, at most `limit`."""
    from pyspark.sql import Window as W

    a = found.select("id", F.lit(1).alias("src"), F.col("rank").cast("double").alias("o")).where(F.col("rank") <= each)
    b = near.select("id", F.lit(2).alias("src"), (-F.col("cosine")).alias("o")).orderBy("o", "id").limit(each)
    c = nodes.where("archived = 0").orderBy(F.desc("importance"), F.desc("weight"), "id").limit(limit).select("id", F.lit(3).alias("src"), (-F.col("importance")).alias("o"))
    every = a.unionByName(b).unionByName(c).groupBy("id").agg(F.min(F.struct("src", "o")).alias("k"))
    top = every.orderBy("k", "id").limit(limit)
    return top.select("id", F.row_number().over(W.orderBy("k", "id")).alias("rank"))  # over `limit` rows
