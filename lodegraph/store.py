"""One object for a store's tables: the operators as the calls that a user makes.  Everything returned is a DataFrame; nothing is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answers, decaying, graph, integrity, ledger_index, search, views
from .sources.tables import table


@dataclass(frozen=True)
class Store:
    """Tables of a store; loops (as the reader gives them) and decisions are optional.  `as_of` is the time of every evaluation."""

    nodes: DataFrame
    edges: DataFrame
    log: DataFrame
    files: DataFrame
    file_nodes: DataFrame
    owner: str
    as_of: float
    loops: DataFrame | None = None
    decisions: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str, owner: str, as_of: float) -> Store:
        """A store of Parquet tables below a folder."""
        t = {n: table(spark, folder, n) for n in ("nodes", "edges", "ingestion_log", "vault_files", "vault_file_nodes")}
        return cls(t["nodes"], t["edges"], t["ingestion_log"], t["vault_files"], t["vault_file_nodes"], owner, as_of)

    def query(self, text: str, limit: int = 12) -> DataFrame:
        """(rank, id, name, type, content): the best nodes by keywords, contents to 140 characters."""
        top = search.in_order(search.search_nodes(self.nodes, text), limit)
        return top.select("rank", "id").join(self.nodes.select("id", "name", "type", F.substring(F.coalesce("content", F.lit("")), 1, 140).alias("content")), "id").select("rank", "id", "name", "type", "content")

    def touched(self, text: str) -> DataFrame:
        """Nodes after a query touched all it found."""
        return decaying.touched(self.nodes, self.edges, search.search_nodes(self.nodes, text).select("id"), self.as_of)

    def search(self, text: str, vector: list[float] | None = None, limit: int = 8, least: float = 0.4) -> DataFrame:
        """(id, score): by meaning if there is a vector and something is close to it, else by keywords."""
        if vector is not None:
            near = search.semantic(self.nodes.where("archived = 0 and type <> 'category'"), "id", "embedding", vector, limit, least).select("id", F.col("cosine").alias("score"))
            if not near.isEmpty():
                return near
        return search.in_order(search.search_nodes(self.nodes, text), limit).select("id", F.col("hits").cast("double").alias("score"))

    def ask(self, text: str, near: DataFrame | None = None) -> DataFrame:
        """(rank, kind, ref, text): what an answer is given: decisions and loops first, then nodes, their neighbours and files."""
        seeds = search.in_order(search.search_nodes(self.nodes, text), 6)
        linked = self.file_nodes.join(seeds.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        out = answers.evidence(self.nodes, self.edges, seeds, search.best_files(search.file_scores(self.files, text, linked)))
        if self.loops is not None and self.decisions is not None:
            c = ledger_index.context(self.loops, self.decisions, text, near)
            out = c.select((F.when(F.col("kind") == "decision", -2000).otherwise(-1000) + F.col("pos")).cast("long").alias("rank"), "kind", F.col("id").alias("ref"), F.col("line").alias("text")).unionByName(out)
        return out

    def context(self, text: str = "", depth: int = 2) -> DataFrame:
        """(type, n, names) of the neighbourhood of what a text is about; of the whole store for an empty text."""
        if not text.strip():
            return answers.context(self.nodes, integrity.active(self.nodes).select("id"))
        seeds = search.in_order(search.search_nodes(self.nodes, text), 6).select("id")
        cap = graph.hub_cap(self.edges).first()["hub_cap"] or 0  # one row
        return answers.context(self.nodes, graph.neighbourhood(self.nodes, self.edges, seeds, depth, cap).select("id"))

    def node(self, node_id: str) -> DataFrame:
        """(side, relation, other, name): a node's links from both sides."""
        e = self.edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
        x = e.select(F.when(F.col("source_id") == node_id, "out").otherwise("in").alias("side"), "relation", F.when(F.col("source_id") == node_id, F.col("target_id")).otherwise(F.col("source_id")).alias("other"))
        return x.join(self.nodes.select(F.col("id").alias("other"), "name"), "other", "left").select("side", "relation", "other", "name").distinct()

    def tree(self) -> DataFrame:
        return graph.tree_rows(self.edges, self.nodes)

    def status(self) -> DataFrame:
        """One row: nodes, active and archived ones, edges, mean weight, last ingest and last indexing."""
        n = self.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("archived") == 0).alias("active"), F.count_if(F.col("archived") == 1).alias("archived"), F.round(F.avg("weight"), 3).alias("mean_weight")).withColumn("_k", F.lit(1))
        e = self.edges.agg(F.count("*").alias("edges")).withColumn("_k", F.lit(1))
        i = self.log.agg(F.max("ingested_at").alias("last_ingested")).withColumn("_k", F.lit(1))
        f = self.files.agg(F.max("indexed_at").alias("last_indexed")).withColumn("_k", F.lit(1))
        return n.join(e, "_k").join(i, "_k").join(f, "_k").drop("_k")

    def digest(self) -> DataFrame:
        """(section, ref, value): top of mind, open loops, fading nodes, areas."""
        a = answers.top_of_mind(self.nodes, self.owner).select(F.lit("top").alias("section"), F.col("id").alias("ref"), F.col("score").alias("value"))
        b = decaying.at_risk(self.nodes, self.as_of).select(F.lit("fading").alias("section"), F.col("id").alias("ref"), F.round("days_left", 6).alias("value"))
        e = answers.breakdown(self.nodes, self.edges, self.owner).select(F.lit("area").alias("section"), F.col("id").alias("ref"), F.col("descendants").cast("double").alias("value"))
        out = a.unionByName(b).unionByName(e)
        if self.loops is not None:
            out = out.unionByName(views.open_loops(self.loops).select(F.lit("loop").alias("section"), F.col("line").alias("ref"), F.col("pos").cast("double").alias("value")))
        return out
