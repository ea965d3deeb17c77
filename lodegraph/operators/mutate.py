"""Changes as pure transforms: tables in, tables and an audit out.  Plain Spark has no MERGE on Parquet, so snapshots are copied on write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocab import base_half_life, node_type, relation
from .integrity import oriented

GAIN = 0.15


def add_nodes(new: DataFrame, as_of: float) -> DataFrame:
    """Complete node rows from (id, name, type, content, source, confidence, importance): types and half-lives normalised, weight 1, clocks at `as_of`."""
    kind = node_type(F.col("type"))
    return new.select(
        "id", "name", kind.alias("type"), "content", "source", F.lit(as_of).alias("created_at"), F.lit(as_of).alias("last_accessed"), F.lit(0).alias("access_count"), F.lit(1.0).alias("weight"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.8)).alias("confidence"), F.coalesce(F.col("importance").cast("double"), F.lit(0.5)).alias("importance"), base_half_life(kind).alias("half_life_days"),
        F.lit(0).alias("archived"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("path"), F.lit(as_of).alias("last_decayed"),
    )


def upsert_edges(nodes: DataFrame, edges: DataFrame, batch: DataFrame, as_of: float) -> DataFrame:
    """(source_id, target_id, relation, weight, reinforcement_count, last_reinforced, how): the logical edges that a batch of (source_id, target_id, relation) touches.

    Labels are normalised and passive edges turned.  A relates_to beside a part_of of the same pair, stored or in the batch, goes to that
    edge's count and clock, not its weight; a known triple gains 0.15 a repeat up to 1; a new triple starts at 1.  part_of is
    taken before relates_to within a batch.  Stored repeats of a triple count as one edge, the heaviest.
    """
    norm = batch.select("source_id", "target_id", relation(F.col("relation")).alias("relation")).where("source_id is not null and target_id is not null and source_id <> target_id")
    norm = oriented(nodes, norm)
    k = norm.groupBy("source_id", "target_id", "relation").agg(F.count("*").alias("k"))
    have = edges.groupBy("source_id", "target_id", "relation").agg(F.max("weight").alias("weight"), F.max("reinforcement_count").alias("count"), F.max("last_reinforced").alias("clock"))
    pair = lambda df: df.withColumn("lo", F.least("source_id", "target_id")).withColumn("hi", F.greatest("source_id", "target_id"))
    spine = pair(have.where("relation = 'part_of'").select("source_id", "target_id")).unionByName(pair(k.where("relation = 'part_of'").select("source_id", "target_id"))).groupBy("lo", "hi").agg(F.min_by(F.struct("source_id", "target_id"), F.struct("source_id", "target_id")).alias("to"))
    moved = pair(k).join(spine, ["lo", "hi"], "left").withColumn("redirect", (F.col("relation") == "relates_to") & F.col("to").isNotNull())
    goal = moved.select(F.when(F.col("redirect"), F.col("to.source_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(F.col("redirect"), F.col("to.target_id")).otherwise(F.col("target_id")).alias("target_id"), F.when(F.col("redirect"), F.lit("part_of")).otherwise(F.col("relation")).alias("relation"), F.when(F.col("redirect"), 0).otherwise(F.col("k")).alias("own"), F.when(F.col("redirect"), F.col("k")).otherwise(0).alias("beside"))
    goal = goal.groupBy("source_id", "target_id", "relation").agg(F.sum("own").alias("own"), F.sum("beside").alias("beside"))
    j = goal.join(have, ["source_id", "target_id", "relation"], "left")
    known = F.col("weight").isNotNull()
    w = F.when(known, F.when(F.col("own") > 0, F.least(F.lit(1.0), F.col("weight") + GAIN * F.col("own"))).otherwise(F.col("weight"))).otherwise(F.lit(1.0))
    n = F.when(known, F.col("count") + F.col("own") + F.col("beside")).otherwise(F.col("own") + F.col("beside"))
    return j.select("source_id", "target_id", "relation", F.round(w, 6).alias("weight"), n.cast("long").alias("reinforcement_count"), F.lit(as_of).alias("last_reinforced"), F.when(known, "reinforced").otherwise("inserted").alias("how"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes and their edges."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return nodes.join(gone, F.col("id") == F.col("_gone"), "left_anti"), edges.join(gone, F.col("source_id") == F.col("_gone"), "left_anti").join(gone, F.col("target_id") == F.col("_gone"), "left_anti")


def set_archived(nodes: DataFrame, ids: DataFrame, archived: bool, as_of: float) -> DataFrame:
    """Archive or revive nodes; reviving sets weight 1 and both clocks."""
    j = nodes.join(ids.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct(), F.col("id") == F.col("_id"), "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = j.withColumn("archived", F.when(hit, int(archived)).otherwise(F.col("archived")))
    if not archived:
        out = out.withColumn("weight", F.when(hit, 1.0).otherwise(F.col("weight")))
        for c in ("last_accessed", "last_decayed"):
            out = out.withColumn(c, F.when(hit, F.lit(as_of)).otherwise(F.col(c)))
    return out.drop("_id", "_hit")


def merge_nodes(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, as_of: float) -> tuple[DataFrame, DataFrame]:
    """Merge (keep, drop) pairs; a node may be dropped once and isn't kept elsewhere.

    Ends at the dropped node move to the kept one, links between the two go, equal triples become one (the heaviest), a second
    parent becomes relates_to unless it is a category, which is left out; if the dropped node was the kept one's parent, its parent is inherited.
    Importance is the larger, content the kept one's unless empty, and the kept node is touched.
    """
    p = pairs.select("keep", "drop").where("keep <> drop").dropDuplicates(["drop"])
    m1, m2 = p.select(F.col("drop").alias("_d1"), F.col("keep").alias("_k1")), p.select(F.col("drop").alias("_d2"), F.col("keep").alias("_k2"))
    e = edges.join(m1, F.col("source_id") == F.col("_d1"), "left").join(m2, F.col("target_id") == F.col("_d2"), "left")
    moved = e.withColumn("was", F.col("_d1").isNotNull()).withColumn("source_id", F.coalesce("_k1", "source_id")).withColumn("target_id", F.coalesce("_k2", "target_id")).where("source_id <> target_id")
    cats = nodes.where("type = 'category'").select(F.col("id").alias("target_id"), F.lit(True).alias("cat"))
    own = moved.where("relation = 'part_of' and not was").select("source_id").distinct().withColumn("has", F.lit(True))
    moved = moved.join(cats, "target_id", "left").join(own, "source_id", "left")
    second = (F.col("relation") == "part_of") & F.col("was") & F.coalesce("has", F.lit(False))
    moved = moved.where(~(second & F.coalesce("cat", F.lit(False)))).withColumn("relation", F.when(second, "relates_to").otherwise(F.col("relation")))
    new_edges = moved.groupBy("source_id", "target_id", "relation").agg(*[F.max_by(c, F.struct("weight", "id")).alias(c) for c in edges.columns if c not in ("source_id", "target_id", "relation")]).select(*edges.columns)
    d = nodes.join(p, F.col("id") == F.col("drop")).groupBy("keep").agg(F.max("importance").alias("_imp"), F.max_by("content", F.struct("weight", "id")).alias("_content"))
    kept = nodes.join(p.select(F.col("drop").alias("id")), "id", "left_anti").join(d, F.col("id") == F.col("keep"), "left")
    hit = F.col("keep").isNotNull()
    kept = kept.withColumn("importance", F.when(hit, F.greatest("importance", "_imp")).otherwise(F.col("importance"))).withColumn("content", F.when(hit, F.coalesce(F.nullif("content", F.lit("")), "_content")).otherwise(F.col("content")))
    kept = kept.withColumn("weight", F.when(hit, 1.0).otherwise(F.col("weight"))).withColumn("access_count", F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count"))).withColumn("last_accessed", F.when(hit, F.lit(as_of)).otherwise(F.col("last_accessed")))
    return kept.select(*nodes.columns), new_edges


def move_refusals(nodes: DataFrame, edges: DataFrame, moves: DataFrame, owner: str) -> DataFrame:
    """(id, parent, refusal): why each move (id, parent) is refused, null if it isn't: missing, self, cycle, category."""
    from .hierarchy import closure

    known = nodes.select("id", "type")
    tree = edges.where("relation = 'part_of'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")).distinct()
    inside = closure(tree).select(F.col("node_id").alias("parent"), F.col("ancestor_id").alias("id"), F.lit(True).alias("cyc")).distinct()
    m = moves.join(known.select("id", F.col("type").alias("t")), "id", "left").join(known.select(F.col("id").alias("parent"), F.col("type").alias("pt")), "parent", "left").join(inside, ["id", "parent"], "left")
    why = F.when(F.col("t").isNull() | F.col("pt").isNull(), "missing").when(F.col("id") == F.col("parent"), "self").when(F.col("cyc"), "cycle").when((F.col("t") == "category") & (F.col("pt") != "category") & (F.col("parent") != owner), "category")
    return m.select("id", "parent", why.alias("refusal"))


def move_nodes(nodes: DataFrame, edges: DataFrame, moves: DataFrame, owner: str) -> DataFrame:
    """Edges after the moves that aren't refused: each moved node has the single new parent."""
    ok = move_refusals(nodes, edges, moves, owner).where("refusal is null").groupBy("id").agg(F.max("parent").alias("parent"))
    rest = edges.join(ok.select(F.col("id").alias("source_id"), F.lit("part_of").alias("relation")), ["source_id", "relation"], "left_anti").select(*edges.columns)
    row = ok.select(F.concat(F.lit("move:"), F.col("id")).alias("id"), F.col("id").alias("source_id"), F.col("parent").alias("target_id"), F.lit("part_of").alias("relation"), F.lit(1.0).alias("weight"))
    return rest.unionByName(row.select(*[F.col(c) if c in row.columns else F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in edges.columns]))


def edit_nodes(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits (id, name?, type?, importance?, content?): a new name clears the path, a new type resets the half-life, new content clears the vector.  Null means unchanged; importance outside 0 to 1 and empty names are refused and change nothing."""
    e = edits.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") if c in edits.columns else F.lit(None).alias(f"_{c}") for c in ("name", "type", "importance", "content")]).dropDuplicates(["_id"])
    j = nodes.join(e, F.col("id") == F.col("_id"), "left")
    name_ok, imp_ok = F.trim(F.coalesce(F.col("_name").cast("string"), F.lit(""))) != "", F.coalesce(F.col("_importance").cast("double").between(0, 1), F.lit(False))
    t = node_type(F.col("_type").cast("string"))
    has_t, has_c = F.col("_type").isNotNull(), F.col("_content").isNotNull()
    return j.select(*[
        F.when(name_ok, F.col("_name").cast("string")).otherwise(F.col("name")).alias("name") if c == "name"
        else F.when(name_ok, F.lit(None).cast("string")).otherwise(F.col("path")).alias("path") if c == "path"
        else F.when(has_t, t).otherwise(F.col("type")).alias("type") if c == "type"
        else F.when(has_t, base_half_life(t)).otherwise(F.col(c)).alias(c) if c == "half_life_days"
        else F.when(imp_ok, F.col("_importance").cast("double")).otherwise(F.col(c)).alias(c) if c == "importance"
        else F.when(has_c, F.col("_content").cast("string")).otherwise(F.col(c)).alias(c) if c == "content"
        else F.when(has_c, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "embedding"
        else F.col(c) for c in nodes.columns
    ])


def import_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes to add, new edges to add) of an import: known ids and names (whatever case) are skipped and their edges moved to the known node, known triples and edges with unknown ends are left out.  A second import adds nothing."""
    have = nodes.groupBy(F.lower("name").alias("_n")).agg(F.min("id").alias("_have"))
    ids = nodes.select(F.col("id").alias("_known"))
    n = new_nodes.join(ids, F.col("id") == F.col("_known"), "left").join(have, F.lower("name") == F.col("_n"), "left")
    mapped = n.select("id", F.when(F.col("_known").isNotNull(), F.col("id")).otherwise(F.coalesce("_have", "id")).alias("to"), (F.col("_known").isNull() & F.col("_have").isNull()).alias("fresh")).groupBy("id").agg(F.min("to").alias("to"), F.min("fresh").alias("fresh"))
    add = new_nodes.join(mapped.where("fresh").select("id"), "id", "left_semi")
    to = mapped.select("id", "to").unionByName(nodes.select("id", F.col("id").alias("to"))).groupBy("id").agg(F.min("to").alias("to"))
    e = new_edges.join(to.select(F.col("id").alias("source_id"), F.col("to").alias("_s")), "source_id").join(to.select(F.col("id").alias("target_id"), F.col("to").alias("_t")), "target_id").withColumn("source_id", F.col("_s")).withColumn("target_id", F.col("_t")).select(*new_edges.columns)
    triple = ["source_id", "target_id", "relation"]
    return add, e.join(edges.select(*triple).distinct(), triple, "left_anti")


def forget_refusals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, refusal): people, categories and nodes with active children can't be forgotten; null where nothing is against it."""
    kids = edges.where("relation = 'part_of'").join(nodes.where("archived = 0").select(F.col("id").alias("source_id")), "source_id").select(F.col("target_id").alias("id")).distinct().withColumn("kids", F.lit(True))
    return nodes.join(kids, "id", "left").select("id", F.when(F.col("type").isin("person", "category"), F.col("type")).when(F.col("kids"), "children").alias("refusal"))


def unlink(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges without the cross-links between the pairs (a, b), in either direction; the spine stays."""
    p = pairs.select(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).distinct()
    e = edges.withColumn("_lo", F.least("source_id", "target_id")).withColumn("_hi", F.greatest("source_id", "target_id"))
    cross = e.where("relation <> 'part_of'").join(p, ["_lo", "_hi"], "left_anti")
    return cross.select(*edges.columns).unionByName(e.where("relation = 'part_of' or relation is null").select(*edges.columns))


def migrate(df: DataFrame, target: DataFrame, defaults: dict) -> DataFrame:
    """Rows of an older schema with the newer columns, filled from `defaults` (a value or an expression)."""
    out = df
    for c in target.columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(target.schema[c].dataType))
        if c in defaults:
            v = defaults[c]
            out = out.withColumn(c, F.coalesce(F.col(c), v if hasattr(v, "alias") else F.lit(v)).cast(target.schema[c].dataType))
    return out.select(*target.columns)


def anchor(nodes: DataFrame, owner_id: str, owner: str, as_of: float) -> DataFrame:
    """The owner's node if no node has that name, whatever case; else nothing."""
    one = nodes.sparkSession.createDataFrame([(owner_id, owner, "person", "The owner of this store.", "anchor", 1.0, 0.5)], "id string, name string, type string, content string, source string, confidence double, importance double")
    return add_nodes(one.join(nodes.select(F.lower("name").alias("_n")), F.lower("name") == F.col("_n"), "left_anti"), as_of)


def pruned(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without archived nodes and their edges."""
    return delete_nodes(nodes, edges, nodes.where("archived = 1").select("id"))


def cleared(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without rows; schemas stay."""
    return tuple(t.where("false") for t in tables)


def with_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes with the vectors (id, embedding) set; of several for a node the smallest in array order, nodes without one keep theirs."""
    v = vectors.where("id is not null").groupBy(F.col("id").alias("_id")).agg(F.min("embedding").alias("_e"))
    return nodes.join(v, F.col("id") == F.col("_id"), "left").withColumn("embedding", F.coalesce("_e", "embedding")).select(*nodes.columns)


def absorb(nodes: DataFrame, news: DataFrame) -> DataFrame:
    """(id, content, changed): contents after novel new ones (id, content) are appended."""
    j = nodes.select("id", F.col("content").alias("old")).join(news.select("id", F.col("content").alias("new")), "id")
    merged = X.absorbed(F.col("old"), F.col("new"))
    return j.select("id", merged.alias("content"), (merged != F.coalesce("old", F.lit(""))).alias("changed"))
