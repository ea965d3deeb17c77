"""Queries over the graph: scans, joins, changes, aggregates, rankings, traversal, integrity, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decay as D
from ..functions import text as X
from ..functions import vectors as V
from ..functions.vocab import AGENTS, relation, sql_relation
from ..operators import answers, decaying, graph, hierarchy, index, ingest, mutate, search
from ..operators import integrity as I
from ..sources import portable
from ..sources.tables import AS_OF, table
from .hierarchy_queries import UP_SQL
from .registry import Registry
from .scalar_queries import DAY, HALF, LEFT, MONTH_NO, WEIGHT, sql_list

R = Registry()
c = F.col

EDGE_COLS = ["id", "source_id", "target_id", "relation", "weight", "created_at", "last_reinforced", "reinforcement_count", "last_decayed"]


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes")


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    """Edges with controlled labels; rows that were delivered twice count once."""
    return table(spark, d, "edges").withColumn("relation", relation(c("relation"))).select(*EDGE_COLS).distinct()


def owner_of(spark: SparkSession, d: str) -> str | None:
    r = nodes_of(spark, d).where("name = 'Owner' and type = 'person'").agg(F.min("id")).first()
    return r[0] or ""


OWNER = "(SELECT coalesce(min(id), '') FROM nodes WHERE name = 'Owner' AND type = 'person')"
E_ = f"e AS (SELECT DISTINCT id, source_id, target_id, {sql_relation('relation')} AS relation, weight, created_at, last_reinforced, reinforcement_count, last_decayed FROM edges)"
A_ = "a AS (SELECT * FROM nodes WHERE archived = 0)"
P_ = "p AS (SELECT DISTINCT source_id AS child, target_id AS parent FROM e WHERE relation = 'part_of' AND source_id IN (SELECT id FROM a) AND target_id IN (SELECT id FROM a))"
ENDS = "n AS (SELECT source_id AS id, target_id AS other FROM e UNION ALL SELECT target_id, source_id FROM e)"

#: Files under the name of one of their nodes: the tables' own titles are nobody's names.
VF_ = "vf AS (SELECT f.path, f.kind, coalesce(t.name, f.title) AS title, f.aliases FROM vault_files f LEFT JOIN (SELECT v.path, min(n.name) AS name FROM vault_file_nodes v JOIN nodes n ON n.id = v.node_id WHERE n.archived = 0 AND n.type <> 'category' GROUP BY v.path) t USING (path))"
#: Nodes half of which have a longer name.
NN_ = "nn AS (SELECT id, type, archived, created_at, CASE WHEN abs(access_count) % 2 = 1 THEN name || ' second draft' ELSE name END AS name FROM nodes)"


def titled_files(spark: SparkSession, d: str) -> DataFrame:
    n = nodes_of(spark, d).where("archived = 0 and type <> 'category'").select(c("id").alias("node_id"), "name")
    t = table(spark, d, "vault_file_nodes").join(n, "node_id").groupBy("path").agg(F.min("name").alias("_name"))
    return table(spark, d, "vault_files").join(t, "path", "left").withColumn("title", F.coalesce("_name", "title")).drop("_name")


def longer_names(spark: SparkSession, d: str) -> DataFrame:
    return nodes_of(spark, d).withColumn("name", F.when(F.abs("access_count") % 2 == 1, F.concat("name", F.lit(" second draft"))).otherwise(c("name")))


# ---- scans ----


@R.query(f"SELECT id, name, coalesce(path, '') AS path, coalesce(last_decayed, {AS_OF}) AS last_decayed FROM nodes")
def a1_migrated(spark, d):
    """Rows of an older schema without path and last_decayed, brought to the present one, beside the present rows."""
    n = nodes_of(spark, d)
    old = n.where("path is null and last_decayed is null").drop("path", "last_decayed")
    new = n.where("path is not null or last_decayed is not null")
    both = mutate.migrate(old, n, {"path": "", "last_decayed": AS_OF}).unionByName(mutate.migrate(new, n, {"path": "", "last_decayed": AS_OF}))
    return both.select("id", "name", "path", "last_decayed")


@R.query("SELECT id, name, type, weight FROM nodes WHERE archived = 0 AND weight >= 0.2")
def a2_active_nodes(spark, d):
    return nodes_of(spark, d).where("archived = 0 and weight >= 0.2").select("id", "name", "type", "weight")


@R.query(f"WITH {E_} SELECT id, source_id, target_id, relation FROM e")
def a3_edges(spark, d):
    return edges_of(spark, d).select("id", "source_id", "target_id", "relation")


@R.query(f"WITH {VF_} SELECT DISTINCT f.path, n.id FROM vf f JOIN nodes n ON lower(n.name) = lower(f.title)")
def a4_by_name(spark, d):
    f = titled_files(spark, d).select("path", F.lower("title").alias("k"))
    return f.join(nodes_of(spark, d).select("id", F.lower("name").alias("k")), "k").select("path", "id").distinct()


@R.query(f"WITH {E_} SELECT DISTINCT n.id AS node_id, e.id AS edge_id FROM nodes n JOIN e ON e.source_id = n.id OR e.target_id = n.id")
def a5_incident_edges(spark, d):
    """Edges at either end of every node: two equi-joins, not one with an OR."""
    n = nodes_of(spark, d).select(c("id").alias("node_id"))
    e = edges_of(spark, d).select(c("id").alias("edge_id"), "source_id", "target_id")
    return n.join(e, c("node_id") == c("source_id")).select("node_id", "edge_id").unionByName(n.join(e, c("node_id") == c("target_id")).select("node_id", "edge_id")).distinct()


@R.query(f"WITH {E_} SELECT child, parent FROM (SELECT source_id AS child, target_id AS parent, row_number() OVER (PARTITION BY source_id ORDER BY created_at, id, target_id) AS r FROM e WHERE relation = 'part_of') WHERE r = 1")
def a6_first_parents(spark, d):
    return graph.first_parent(edges_of(spark, d))


@R.query(f"SELECT path FROM vault_files WHERE path LIKE '%.md' AND NOT (NOT contains(path, '/') AND list_contains({sql_list(['NOW.md', 'DIGEST.md', 'LOOPS.md', 'LOOPS-INBOX.md', 'DECISIONS.md', 'README.md'])}, path)) AND len(list_filter(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), lambda p: p IN ('.git', 'graph', '__pycache__'))) = 0")
def a7_indexable_files(spark, d):
    from ..sources.markdown import indexable

    return table(spark, d, "vault_files").where(indexable(c("path"))).select("path")


@R.query(r"""
    SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^# ') THEN trim(regexp_extract(text, '(?m)^# ([^\r\n]*)', 1)) ELSE replace(regexp_replace(list_last(string_split(path, '/')), '\.[^.]*$', ''), '-', ' ') END AS title,
      left(sha256(text), 16) AS sha, CAST(strlen(text) AS BIGINT) AS size
    FROM documents WHERE text IS NOT NULL AND path IS NOT NULL""")
def a8_file_records(spark, d):
    from ..sources.markdown import records

    t = table(spark, d, "documents").where("text is not null and path is not null")
    return records(t.select(F.col("doc_id").cast("string").alias("k"), F.concat("path", F.lit("\u0001"), F.col("doc_id")).alias("path"), "text")).select(F.element_at(F.split("path", "\u0001"), -1).cast("long").alias("doc_id"), F.when(c("title").contains("\u0001"), F.replace(F.regexp_replace(F.element_at(F.split(F.split("path", "\u0001")[0], "/"), -1), r"\.[^.]*$", ""), F.lit("-"), F.lit(" "))).otherwise(c("title")).alias("title"), "sha", c("size").cast("long").alias("size"))


@R.query()
def a8_file_tokens(spark, d):
    """Kind, aliases, links and tokens of every text as a file; checked in the tests."""
    from ..sources.markdown import records

    t = table(spark, d, "documents").where("text is not null and path is not null")
    return records(t.select("path", "text")).select("path", "kind", "title", F.size("tokens").alias("n_tokens"), F.array_join(F.array_sort("links"), " ").alias("links"), "sha").distinct()


@R.query()
def a18_exported(spark, d):
    return portable.export_rows(nodes_of(spark, d))


@R.query("SELECT id, name, weight FROM nodes")
def a19_round_trip(spark, d):
    """Export and import of all nodes."""
    n = nodes_of(spark, d)
    return portable.import_rows(portable.export_rows(n, vectors=False), "id string, name string, weight double").select("id", "name", "weight")


@R.query(r"SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS visible FROM documents")
def a21_page_texts(spark, d):
    t = table(spark, d, "documents")
    page = F.concat(F.lit("<html><head><style>p {}</style><script>var x = 1;</script></head><body><!-- c --><p>"), F.coalesce("text", F.lit("")), F.lit("</p></body></html>"))
    return t.select("doc_id", portable.html_text(page).alias("visible"))


@R.query("SELECT DISTINCT id FROM ingestion_log WHERE trim(coalesce(raw_text, '')) <> ''")
def a22_usable_inputs(spark, d):
    return table(spark, d, "ingestion_log").where("trim(coalesce(raw_text, '')) <> ''").select("id").distinct()


@R.query(f"WITH {E_} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT sum(access_count) FROM nodes) AS accesses, (SELECT max(last_accessed) FROM nodes) AS latest")
def a23_fingerprint(spark, d):
    n = nodes_of(spark, d).agg(F.count("*").alias("nodes"), F.sum("access_count").alias("accesses"), F.max("last_accessed").alias("latest")).withColumn("k", F.lit(1))
    e = edges_of(spark, d).agg(F.count("*").alias("edges")).withColumn("k", F.lit(1))
    return n.join(e, "k").select("nodes", "edges", "accesses", "latest")


@R.query(f"SELECT coalesce(source, 'unknown') AS source, count(*) AS n, count(*) FILTER (ingested_at >= {AS_OF} - 30 * 86400) AS recent, count(*) FILTER (raw_text IS NULL) AS empty FROM ingestion_log GROUP BY 1")
def a24_log_tally(spark, d):
    return table(spark, d, "ingestion_log").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.count_if(c("ingested_at") >= AS_OF - 30 * 86400).alias("recent"), F.count_if(c("raw_text").isNull()).alias("empty"))


@R.query(f"WITH {E_} SELECT concat_ws('|', source_id, target_id, relation) AS edge_id, source_id, target_id, relation, max(weight) AS weight FROM e GROUP BY 1, 2, 3, 4")
def a25_drawing_edges(spark, d):
    return graph.drawing_edges(edges_of(spark, d))


@R.query(f"""WITH {E_}, {A_}, x AS (SELECT id, name, weight, importance FROM a WHERE type = 'category')
    SELECT 'graph/' || coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(x.name, '')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed') || '.md' AS path, x.id AS category, k.id AS node_id, '- ' || coalesce(k.name, '') AS line
    FROM x JOIN (SELECT DISTINCT source_id, target_id FROM e WHERE relation = 'part_of') s ON s.target_id = x.id JOIN a k ON k.id = s.source_id""")
def a26_view_lines(spark, d):
    """Lines of one generated file per category: its direct members."""
    n = I.active(nodes_of(spark, d))
    cat = n.where("type = 'category'").select(c("id").alias("category"), F.concat(F.lit("graph/"), X.slug(c("name")), F.lit(".md")).alias("path"))
    kids = graph.children(edges_of(spark, d)).join(cat, c("parent") == c("category")).join(n.select(c("id").alias("child"), "name"), "child")
    return kids.select("path", "category", c("child").alias("node_id"), F.concat(F.lit("- "), F.coalesce("name", F.lit(""))).alias("line"))


@R.query("SELECT DISTINCT v.path, n.id, n.name FROM vault_file_nodes v JOIN nodes n ON n.id = v.node_id")
def a29_nodes_of_files(spark, d):
    return table(spark, d, "vault_file_nodes").join(nodes_of(spark, d).select("id", "name"), c("node_id") == c("id")).select("path", "id", "name").distinct()


# ---- joins ----


@R.query("SELECT path, string_agg(name, '; ' ORDER BY name) AS names FROM (SELECT DISTINCT v.path, n.name FROM vault_file_nodes v JOIN nodes n ON n.id = v.node_id) GROUP BY path")
def c2_seeded_files(spark, d):
    n = nodes_of(spark, d).select(c("id").alias("node_id"), "name")
    return table(spark, d, "vault_file_nodes").join(n, "node_id").select("path", "name").distinct().groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names"))


@R.query(f"WITH {E_} SELECT id, source_id, target_id FROM e WHERE source_id NOT IN (SELECT id FROM nodes) OR target_id NOT IN (SELECT id FROM nodes)")
def c3_dangling_edges(spark, d):
    return I.dangling(nodes_of(spark, d), edges_of(spark, d))


@R.query(f"""WITH {E_}, x AS (SELECT id, source_id, target_id, relation FROM e UNION ALL SELECT 'r:' || id, target_id, source_id, 'relates_to' FROM e WHERE relation = 'part_of' AND reinforcement_count % 2 = 1)
    SELECT DISTINCT r.id FROM x r WHERE r.relation = 'relates_to' AND EXISTS (SELECT 1 FROM x p WHERE p.relation = 'part_of' AND ((p.source_id = r.source_id AND p.target_id = r.target_id) OR (p.source_id = r.target_id AND p.target_id = r.source_id)))""")
def c4_redundant_links(spark, d):
    """With a cross-link back along every other structural link, as the tables have none."""
    e = edges_of(spark, d).select("id", "source_id", "target_id", "relation", "reinforcement_count")
    back = e.where("relation = 'part_of' and reinforcement_count % 2 = 1").select(F.concat(F.lit("r:"), "id").alias("id"), c("target_id").alias("source_id"), c("source_id").alias("target_id"), F.lit("relates_to").alias("relation"), "reinforcement_count")
    return I.redundant_links(e.unionByName(back))


@R.query(f"WITH {E_}, {A_} SELECT DISTINCT e.id FROM e JOIN a s ON s.id = e.source_id JOIN a t ON t.id = e.target_id WHERE relation <> 'part_of' AND (s.type = 'category' OR t.type = 'category')")
def c5_category_links(spark, d):
    return I.category_links(nodes_of(spark, d), edges_of(spark, d))


_MIS = " OR ".join(f"(relation = '{r}' AND s.type IN ({', '.join(repr(k) for k in ks)}) AND t.type NOT IN ({', '.join(repr(k) for k in ks)}))" for r, ks in AGENTS.items())


@R.query(f"WITH {E_}, {A_} SELECT DISTINCT e.id, e.source_id, e.relation, e.target_id FROM e JOIN a s ON s.id = e.source_id JOIN a t ON t.id = e.target_id WHERE {_MIS}")
def c6_misoriented(spark, d):
    return I.misoriented(nodes_of(spark, d), edges_of(spark, d))


@R.query(f"""WITH {E_}, {A_}, {P_}, v AS (SELECT id, type, CAST(embedding AS DOUBLE[]) AS v FROM a WHERE type <> 'category' AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0),
    k AS (SELECT least(child, parent) AS a, greatest(child, parent) AS b FROM p)
    SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM v x JOIN v y ON x.type = y.type AND len(x.v) = len(y.v) AND x.id < y.id
    WHERE list_cosine_similarity(x.v, y.v) >= 0.89 AND NOT EXISTS (SELECT 1 FROM k WHERE k.a = x.id AND k.b = y.id)""")
def c7_semantic_duplicates(spark, d):
    return I.semantic_duplicates(nodes_of(spark, d), edges_of(spark, d))


@R.query()
def c8_name_duplicates(spark, d):
    """Checked in the tests against all pairs."""
    return I.name_duplicates(nodes_of(spark, d))


_ENT = "split_part(path, '/', 1) IN ('people', 'orgs', 'projects', 'courses', 'applications', 'apps', 'topics') AND path NOT LIKE '%/README.md'"


@R.query(f"""WITH {E_}, {A_}, {P_}, x AS (SELECT id, type, path FROM a WHERE coalesce(path, '') <> '' AND contains(path, '/') AND type <> 'category' AND {_ENT} AND id NOT IN (SELECT node_id FROM vault_file_nodes WHERE how IN ('contains', 'inherited')))
    SELECT l.id AS a, r.id AS b FROM x l JOIN x r ON l.type = r.type AND l.path = r.path AND l.id < r.id WHERE NOT EXISTS (SELECT 1 FROM p WHERE (p.child = l.id AND p.parent = r.id) OR (p.child = r.id AND p.parent = l.id))""")
def c9_same_file(spark, d):
    return I.same_file(nodes_of(spark, d), edges_of(spark, d), table(spark, d, "vault_file_nodes"))


_IN = r"replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(name, '')), '\b(?:owner''?s?|my|the)\b', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' ', '')"


@R.query(f"WITH x AS (SELECT id, {_IN} AS k FROM nodes WHERE archived = 0 AND type <> 'category') SELECT * FROM (SELECT id, min(id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS n FROM x WHERE k <> '') WHERE n > 1")
def c10_same_compact_name(spark, d):
    """A class per name; pairs of a name that a third of all nodes have would be too many."""
    return I.compact_classes(nodes_of(spark, d))


@R.query(f"""WITH x AS (SELECT id, type, lower(trim(name)) AS n, {_IN} AS k FROM nodes WHERE archived = 0 AND type <> 'category'), q AS (SELECT l.id AS a, r.id AS b, l.n AS na, r.n AS nb FROM x l JOIN x r ON l.k = r.k AND l.id < r.id WHERE l.k <> ''),
    m AS (SELECT DISTINCT least(l.n, r.n) AS lo, greatest(l.n, r.n) AS hi FROM x l JOIN x r ON l.k = r.k AND l.type = 'skill' AND r.type <> 'skill')
    SELECT a, b FROM q WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.lo = least(na, nb) AND m.hi = greatest(na, nb))""")
def c11_unmarked_pairs(spark, d):
    """Pairs of equal compact names without those whose names are marked as different things: here a skill and another type."""
    n = nodes_of(spark, d)
    x = I.active(n).where("type <> 'category'").select("name", "type", X.compact_name(c("name")).alias("k"))
    marked = x.where("type = 'skill'").select(c("name").alias("x"), "k").join(x.where("type <> 'skill'").select(c("name").alias("y"), "k"), "k").select("x", "y")
    return I.without_marked(I.same_compact_name(n), n, marked)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vault_files")


_FK = "fk AS (SELECT path, kind, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS k, 'name' AS how FROM vault_files UNION ALL SELECT path, kind, array_to_string(regexp_extract_all(lower(u.al), '[a-z0-9]+'), ' '), 'alias' FROM (SELECT path, kind, unnest(aliases) AS al FROM vault_files) u)"
_NK = r"nk AS (SELECT id, unnest(list_distinct([array_to_string(regexp_extract_all(lower(coalesce(name, '')), '[a-z0-9]+'), ' '), array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce(name, ''), '\s*\([^()]*\)\s*$', ''), '(?:\s+(?:19|20)\d\d)+\s*$', '')), '[a-z0-9]+'), ' ')])) AS k FROM nodes WHERE archived = 0 AND type <> 'category')"


_FKV, _NKV = _FK.replace("vault_files", "vf"), _NK.replace("FROM nodes", "FROM nn")


@R.query(f"WITH {VF_}, {_FKV}, {_NK} SELECT fk.path, nk.id AS node_id, max(how) AS how FROM fk JOIN nk ON fk.k = nk.k WHERE fk.k <> '' GROUP BY 1, 2")
def c12_exact_links(spark, d):
    return index.exact_links(titled_files(spark, d), nodes_of(spark, d))


_KIND = "CASE kind WHEN 'person' THEN 0 WHEN 'org' THEN 1 WHEN 'project' THEN 2 WHEN 'course' THEN 3 WHEN 'application' THEN 4 WHEN 'profile' THEN 5 WHEN 'topic' THEN 6 WHEN 'app' THEN 7 WHEN 'area' THEN 8 WHEN 'hub' THEN 9 WHEN 'identity' THEN 10 WHEN 'doc' THEN 11 WHEN 'readme' THEN 12 WHEN 'log' THEN 13 ELSE 20 END"


_LINKED = f"""{VF_}, {NN_}, {_FKV}, {_NKV}, ex AS (SELECT fk.path, nk.id AS node_id, max(how) AS how FROM fk JOIN nk ON fk.k = nk.k WHERE fk.k <> '' GROUP BY 1, 2),
    f AS (SELECT path, {_KIND} AS prio, k FROM fk WHERE contains(k, ' ') AND kind IN ('person', 'org', 'project', 'course', 'application', 'profile', 'topic', 'app', 'area', 'doc')),
    x AS (SELECT id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(name, '')), '[a-z0-9]+'), ' ') || ' ' AS n FROM nn WHERE archived = 0 AND type <> 'category' AND id NOT IN (SELECT node_id FROM ex)),
    co AS (SELECT path, node_id FROM (SELECT f.path, x.id AS node_id, row_number() OVER (PARTITION BY x.id ORDER BY length(f.k) DESC, prio, f.path) AS r FROM x JOIN f ON contains(x.n, ' ' || f.k || ' ')) WHERE r = 1)"""


@R.query(f"WITH {_LINKED} SELECT path, node_id FROM co")
def c13_contains_links(spark, d):
    f, n = titled_files(spark, d), longer_names(spark, d)
    return index.contains_links(f, n, index.exact_links(f, n))


_FIRST = "fp AS (SELECT source_id AS child, min_by(target_id, (created_at, id, target_id)) AS parent FROM e WHERE relation = 'part_of' GROUP BY 1)"


@R.query(f"""WITH RECURSIVE {E_}, {_LINKED}, {_FIRST}, bo AS (SELECT path, node_id, how FROM ex UNION ALL SELECT path, node_id, 'contains' FROM co),
    be AS (SELECT node_id, min_by(path, (prio, path)) AS path FROM (SELECT bo.node_id, bo.path, {_KIND} AS prio FROM bo JOIN vf USING (path)) GROUP BY 1),
    upw AS (SELECT id AS node_id, id AS at, 0 AS d FROM nn WHERE archived = 0 AND type <> 'category' AND id NOT IN (SELECT node_id FROM be)
      UNION ALL SELECT upw.node_id, fp.parent, d + 1 FROM upw JOIN fp ON fp.child = upw.at WHERE d < 8 AND (d = 0 OR upw.at NOT IN (SELECT node_id FROM be)) AND fp.parent NOT IN (SELECT id FROM nodes WHERE type = 'category') AND fp.parent <> {OWNER})
    SELECT path, node_id, how FROM bo UNION ALL SELECT be.path, upw.node_id, 'inherited' FROM upw JOIN be ON be.node_id = upw.at WHERE d > 0""")
def c14_all_links(spark, d):
    """All three passes: by name, by a phrase inside the name, and inherited from the nearest linked ancestor."""
    return index.linked_files(titled_files(spark, d), longer_names(spark, d), edges_of(spark, d), owner_of(spark, d))


@R.query(r"SELECT DISTINCT node_id AS doc_id, path AS target FROM vault_file_nodes JOIN vault_files USING (path) WHERE regexp_full_match(path, '(?:profile|courses|applications|orgs|projects|people|apps|topics|docs|areas|log)/[\w.\-]+\.md')")
def c15_known_links(spark, d):
    """Texts that name the files of a node, and one that is unknown."""
    t = table(spark, d, "vault_file_nodes").groupBy(c("node_id").alias("doc_id")).agg(F.concat(F.lit("See topics/unknown-file.md, "), F.array_join(F.collect_set("path"), " and "), F.lit(".")).alias("text"))  # a node's own files
    t = t.select("doc_id", F.explode(X.file_links(c("text"))).alias("target"))
    return t.join(_files(spark, d).select(c("path").alias("target")), "target", "left_semi").select("doc_id", "target").distinct()


@R.query(f"""WITH {VF_}, h AS (SELECT lower(name) AS k, id, row_number() OVER (PARTITION BY lower(name) ORDER BY created_at, id) AS r FROM nodes WHERE archived = 0)
    SELECT x.k AS name_key, h.id, CASE WHEN h.id IS NULL THEN 'new' ELSE 'name' END AS how FROM (SELECT DISTINCT lower(title) AS k FROM vf) x LEFT JOIN h ON h.k = x.k AND r = 1""")
def c16_resolved_names(spark, d):
    cands = titled_files(spark, d).select(F.lower("title").alias("name_key"), F.lit("concept").alias("type"))
    return ingest.resolved(cands, nodes_of(spark, d))


@R.query(f"WITH {E_}, {ENDS}, s AS (SELECT id FROM nodes WHERE type IN ('project', 'skill', 'person')) SELECT DISTINCT n.other AS id FROM n JOIN s ON s.id = n.id JOIN nodes x ON x.id = n.other WHERE x.archived = 0 AND n.other NOT IN (SELECT id FROM s)")
def c17_neighbours(spark, d):
    s = nodes_of(spark, d).where("type in ('project', 'skill', 'person')").select("id")
    near = graph.ends(edges_of(spark, d)).join(s, "id").select(c("other").alias("id")).distinct().join(s, "id", "left_anti")
    return near.join(nodes_of(spark, d).where("archived = 0").select("id"), "id", "left_semi")


# ---- changes ----


@R.query(f"""WITH {E_}, b AS (SELECT source_id AS s, target_id AS t, {sql_relation('relation')} AS r FROM edges WHERE source_id <> target_id),
    o AS (SELECT CASE WHEN w THEN t ELSE s END AS s, CASE WHEN w THEN s ELSE t END AS t, r FROM (SELECT b.*, coalesce({_MIS.replace('relation', 'b.r').replace('s.type', 'x.type').replace('t.type', 'y.type')}, false) AS w FROM b LEFT JOIN nodes x ON x.id = b.s LEFT JOIN nodes y ON y.id = b.t)),
    k AS (SELECT s, t, r, count(*) AS k FROM o GROUP BY 1, 2, 3), h AS (SELECT source_id AS s, target_id AS t, relation AS r, max(weight) AS w, max(reinforcement_count) AS n FROM e GROUP BY 1, 2, 3),
    sp AS (SELECT least(s, t) AS lo, greatest(s, t) AS hi, min(s) AS ps, min_by(t, (s, t)) AS pt FROM (SELECT s, t FROM h WHERE r = 'part_of' UNION SELECT s, t FROM k WHERE r = 'part_of') GROUP BY 1, 2),
    m AS (SELECT k.*, sp.ps, sp.pt, r = 'relates_to' AND sp.ps IS NOT NULL AS mv FROM k LEFT JOIN sp ON sp.lo = least(s, t) AND sp.hi = greatest(s, t)),
    g AS (SELECT CASE WHEN mv THEN ps ELSE s END AS s, CASE WHEN mv THEN pt ELSE t END AS t, CASE WHEN mv THEN 'part_of' ELSE r END AS r, sum(CASE WHEN mv THEN 0 ELSE k END) AS own, sum(CASE WHEN mv THEN k ELSE 0 END) AS beside FROM m GROUP BY 1, 2, 3)
    SELECT g.s AS source_id, g.t AS target_id, g.r AS relation, round(CASE WHEN h.w IS NULL THEN 1.0 WHEN own > 0 THEN least(1.0, h.w + 0.15 * own) ELSE h.w END, 6) AS weight, CAST(coalesce(h.n, 0) + own + beside AS BIGINT) AS reinforcement_count, CASE WHEN h.w IS NULL THEN 'inserted' ELSE 'reinforced' END AS how
    FROM g LEFT JOIN h ON h.s = g.s AND h.t = g.t AND h.r = g.r""")
def d2_upserted_edges(spark, d):
    """The whole edge table once more as a batch."""
    batch = table(spark, d, "edges").select("source_id", "target_id", "relation")
    return mutate.upsert_edges(nodes_of(spark, d), edges_of(spark, d), batch, AS_OF).drop("last_reinforced")


@R.query(f"WITH {E_} SELECT DISTINCT e.id, CASE WHEN w THEN target_id ELSE source_id END AS source_id, CASE WHEN w THEN source_id ELSE target_id END AS target_id, relation FROM (SELECT e.*, coalesce({_MIS}, false) AS w FROM e LEFT JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes t ON t.id = e.target_id) e")
def d3_oriented_edges(spark, d):
    return I.oriented(nodes_of(spark, d), edges_of(spark, d)).select("id", "source_id", "target_id", "relation").distinct()


@R.query(f"""WITH {E_}, u AS (SELECT DISTINCT source_id AS id, target_id AS parent FROM e WHERE relation = 'part_of'), l0 AS (SELECT id, 0 AS d FROM nodes WHERE type = 'skill'),
    l1 AS (SELECT DISTINCT parent AS id, 1 AS d FROM u JOIN l0 USING (id)), l2 AS (SELECT DISTINCT parent AS id, 2 AS d FROM u JOIN l1 USING (id)), l3 AS (SELECT DISTINCT parent AS id, 3 AS d FROM u JOIN l2 USING (id)),
    m AS (SELECT id, min(d) AS d FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY id)
    SELECT n.id, round(CASE WHEN m.d = 0 THEN 1.0 WHEN m.d IS NULL THEN n.weight ELSE greatest(n.weight, pow(0.6, m.d)) END, 6) AS weight, CAST(n.access_count + CASE WHEN m.d = 0 THEN 1 ELSE 0 END AS BIGINT) AS access_count, CASE WHEN m.d IS NULL THEN n.last_accessed ELSE {AS_OF} END AS last_accessed FROM nodes n LEFT JOIN m USING (id)""")
def d4_touched(spark, d):
    n = nodes_of(spark, d)
    t = decaying.touched(n, edges_of(spark, d), n.where("type = 'skill'").select("id"), AS_OF)
    return t.select("id", F.round("weight", 6).alias("weight"), c("access_count").cast("long").alias("access_count"), "last_accessed")


@R.query(f"WITH {E_}, g AS (SELECT id FROM nodes WHERE type = 'task') SELECT 'node' AS kind, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'edge', count(*) FROM e WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)")
def d5_after_delete(spark, d):
    n = nodes_of(spark, d)
    a, b = mutate.delete_nodes(n, edges_of(spark, d), n.where("type = 'task'").select("id"))
    return a.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "n").unionByName(b.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "n"))


def _merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = nodes_of(spark, d).where("archived = 0 and type <> 'category'").select("id", "type", X.compact_name(c("name")).alias("k")).where("k <> ''")
    g = n.groupBy("type", "k").agg(F.min("id").alias("keep"))
    return n.join(g, ["type", "k"]).where("id <> keep").select("keep", c("id").alias("drop"))


@R.query(f"""WITH x AS (SELECT id, type, {_IN} AS k FROM nodes WHERE archived = 0 AND type <> 'category'), p AS (SELECT min(id) OVER (PARTITION BY type, k) AS keep, id AS dr FROM x WHERE k <> ''), q AS (SELECT * FROM p WHERE keep <> dr)
    SELECT n.id, CASE WHEN i.imp IS NULL AND i.keep IS NULL THEN n.importance ELSE greatest(n.importance, i.imp) END AS importance, CAST(n.access_count + CASE WHEN i.keep IS NULL THEN 0 ELSE 1 END AS BIGINT) AS access_count
    FROM nodes n LEFT JOIN (SELECT keep, max(importance) AS imp FROM q JOIN nodes ON nodes.id = q.dr GROUP BY keep) i ON i.keep = n.id WHERE n.id NOT IN (SELECT dr FROM q)""")
def d6_merged_nodes(spark, d):
    n, _ = mutate.merge_nodes(nodes_of(spark, d), edges_of(spark, d), _merge_pairs(spark, d), AS_OF)
    return n.select("id", "importance", c("access_count").cast("long").alias("access_count"))


@R.query()
def d6_merged_edges(spark, d):
    _, e = mutate.merge_nodes(nodes_of(spark, d), edges_of(spark, d), _merge_pairs(spark, d), AS_OF)
    return e.select("source_id", "target_id", "relation", "weight")


@R.query("SELECT id FROM nodes WHERE source = 'import' AND lower(name) NOT IN (SELECT lower(name) FROM nodes WHERE source IS DISTINCT FROM 'import' AND name IS NOT NULL)")
def d7_imported_nodes(spark, d):
    """Nodes of the import source brought into the rest of the store."""
    n, e = nodes_of(spark, d), edges_of(spark, d)
    add, _ = mutate.import_graph(n.where("source is null or source <> 'import'"), e.limit(0), n.where("source = 'import'"), e.limit(0))
    return add.select("id")


@R.query()
def d7_imported_edges(spark, d):
    """Edges of odd counts brought into a store of the others, with the nodes of the import source."""
    n, e = nodes_of(spark, d), edges_of(spark, d)
    old = n.where("source is null or source <> 'import'")
    _, add = mutate.import_graph(old, e.where("reinforcement_count % 2 = 0"), n.where("source = 'import'"), e.where("reinforcement_count % 2 = 1"))
    return add.select("id", "source_id", "target_id", "relation")


@R.query()
def d8_move_refusals(spark, d):
    """Every `requires` link read as a wish to move its source below its target; checked in the tests."""
    n, e = nodes_of(spark, d), edges_of(spark, d)
    moves = e.where("relation = 'requires'").select(c("source_id").alias("id"), c("target_id").alias("parent")).distinct()
    return mutate.move_refusals(n, e, moves, owner_of(spark, d))


@R.query("SELECT id, type, CASE WHEN type = 'skill' THEN coalesce(confidence, importance) ELSE importance END AS importance, CASE WHEN type = 'fact' THEN 'changed' ELSE content END AS content, embedding IS NOT NULL AND type <> 'fact' AS has_vector FROM nodes")
def d9_edited_nodes(spark, d):
    n = nodes_of(spark, d)
    edits = n.select("id", F.when(c("type") == "skill", c("confidence")).alias("importance"), F.when(c("type") == "fact", "changed").alias("content"))
    return mutate.edit_nodes(n, edits).select("id", "type", "importance", "content", c("embedding").isNotNull().alias("has_vector"))


_NW = f"least(1.0, greatest(0.0, {WEIGHT}))"
_GONE = f"(archived = 1 AND coalesce(({AS_OF} - last_accessed) / 86400 > 7, false))"


@R.query(f"SELECT id, round(CASE WHEN archived = 1 THEN weight ELSE {_NW} END, 6) AS weight, CAST(CASE WHEN archived = 1 OR {_NW} < 0.1 THEN 1 ELSE 0 END AS BIGINT) AS archived FROM nodes WHERE NOT {_GONE}")
def j1_decayed_nodes(spark, d):
    n, _, _ = decaying.run(nodes_of(spark, d), edges_of(spark, d), AS_OF)
    return n.select("id", F.round("weight", 6).alias("weight"), c("archived").cast("long").alias("archived"))


_EW = f"weight * pow(0.5, greatest(0.0, ({AS_OF} - coalesce(greatest(last_decayed, last_reinforced), {AS_OF})) / 86400.0) / (90.0 * ln(1 + reinforcement_count)))"


@R.query(f"WITH {E_}, x AS (SELECT id, relation, {_EW} AS w FROM e WHERE source_id NOT IN (SELECT id FROM nodes WHERE {_GONE}) AND target_id NOT IN (SELECT id FROM nodes WHERE {_GONE})) SELECT id, round(CASE WHEN relation = 'part_of' THEN greatest(w, 0.05) ELSE w END, 6) AS weight FROM x WHERE relation = 'part_of' OR w >= 0.05")
def j2_decayed_edges(spark, d):
    _, e, _ = decaying.run(nodes_of(spark, d), edges_of(spark, d), AS_OF)
    return e.select("id", F.round("weight", 6).alias("weight"))


@R.query(f"""WITH {E_}, x AS (SELECT id, relation, {_EW} AS w FROM e WHERE source_id NOT IN (SELECT id FROM nodes WHERE {_GONE}) AND target_id NOT IN (SELECT id FROM nodes WHERE {_GONE}))
    SELECT (SELECT count(*) FROM nodes WHERE archived = 0 AND {_NW} >= 0.1) AS updated, (SELECT count(*) FROM nodes WHERE archived = 0 AND {_NW} < 0.1) AS archived, (SELECT count(*) FROM nodes WHERE {_GONE}) AS deleted, (SELECT count(*) FROM x WHERE relation <> 'part_of' AND w < 0.05) AS edges_pruned""")
def d10_decay_audit(spark, d):
    return decaying.run(nodes_of(spark, d), edges_of(spark, d), AS_OF)[2]


@R.query()
def d11_repair_audit(spark, d):
    """Counts of every repair step; checked on a fixture, twice."""
    n, e = nodes_of(spark, d), edges_of(spark, d)
    fallback = n.where("type = 'category' and archived = 0").agg(F.min("id")).first()[0] or ""
    return I.repaired(n, e, owner_of(spark, d), fallback)[1]


def _records(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ingestion_log").where("raw_text is not null").select("id", "raw_text").distinct()
    return ingest.extracted(t, "id", "raw_text")


@R.query()
def d12_candidates(spark, d):
    """Candidate nodes of all texts with the existing node of their name; the extractor is the deterministic stand-in."""
    n = ingest.candidate_nodes(_records(spark, d))
    return n.join(ingest.resolved(n, nodes_of(spark, d)), "name_key").select("key", "name_key", "type", "id", "how")


@R.query()
def d13_attached(spark, d):
    r = ingest.diverted(_records(spark, d))
    n = ingest.candidate_nodes(r)
    return ingest.attached(n, ingest.candidate_edges(r)).distinct()


@R.query()
def d14_tasks(spark, d):
    """Tasks of all texts, each with one line of a task in two spellings."""
    t = table(spark, d, "ingestion_log").where("raw_text is not null").select("id", "raw_text", F.coalesce("source", F.lit("nobody")).alias("s")).distinct()
    t = t.select("id", F.concat("raw_text", F.lit("\n\nTODO call "), "s", F.lit("\nTODO: Call "), "s").alias("raw_text"))
    return ingest.tasks(ingest.diverted(ingest.extracted(t, "id", "raw_text")))


@R.query(f"SELECT path, min_by(x.f, (prio, x.f)) AS best FROM (SELECT v.node_id AS path, v.path AS f, {_KIND} AS prio FROM vault_file_nodes v JOIN vault_files USING (path)) x GROUP BY path")
def d16_best_files(spark, d):
    b = index.best_path(table(spark, d, "vault_file_nodes").select("path", "node_id").distinct(), _files(spark, d))
    return b.select(c("node_id").alias("path"), c("path").alias("best"))


_CUT = AS_OF - 200 * 86400


@R.query(f"SELECT path, CASE WHEN indexed_at > {_CUT} THEN CASE WHEN mtime > {_CUT} THEN 'added' ELSE 'updated' END ELSE 'unchanged' END AS status FROM vault_files")
def d17_index_changes(spark, d):
    """The index against its state 200 days before: files written since are added, those indexed again since are updated."""
    f = _files(spark, d)
    before = f.where(c("mtime") <= _CUT).select("path", F.when(c("indexed_at") > _CUT, F.lit("older")).otherwise(c("sha")).alias("sha"))
    return index.changes(f, before)


@R.query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN indexed_at > {_CUT} THEN CASE WHEN mtime > {_CUT} THEN 'added' ELSE 'updated' END ELSE 'unchanged' END AS status FROM vault_files) GROUP BY status")
def d19_index_status(spark, d):
    return d17_index_changes(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@R.query(f"WITH {E_}, {ENDS} SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM n)")
def g9_isolated(spark, d):
    return graph.isolated(nodes_of(spark, d), edges_of(spark, d)).select("id")


@R.query(f"WITH {E_}, k AS (SELECT DISTINCT target_id AS id FROM e JOIN nodes c ON c.id = e.source_id WHERE relation = 'part_of' AND c.archived = 0) SELECT id, CASE WHEN type IN ('person', 'category') THEN type WHEN id IN (SELECT id FROM k) THEN 'children' END AS refusal FROM nodes")
def d24_forget_refusals(spark, d):
    return mutate.forget_refusals(nodes_of(spark, d), edges_of(spark, d))


@R.query("SELECT id, concat_ws('. ', name, coalesce(content, '')) AS text FROM nodes WHERE embedding IS NULL")
def d30_to_embed(spark, d):
    return nodes_of(spark, d).where("embedding is null").select("id", F.concat_ws(". ", "name", F.coalesce("content", F.lit(""))).alias("text"))


# ---- aggregates ----


@R.query("SELECT type, count(*) AS n, count(*) FILTER (archived = 0) AS active, count(*) FILTER (archived = 1) AS archived, round(avg(weight), 3) AS avg_weight FROM nodes GROUP BY type")
def e1_counts(spark, d):
    return nodes_of(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if(c("archived") == 0).alias("active"), F.count_if(c("archived") == 1).alias("archived"), F.round(F.avg("weight"), 3).alias("avg_weight"))


@R.query(f"WITH {E_}, {ENDS} SELECT round(avg(k), 6) AS mean_degree, greatest(5, CAST(round_even(avg(k) * 2, 0) AS INT)) AS hub_cap FROM (SELECT id, count(*) AS k FROM n GROUP BY id)")
def e2_hub_cap(spark, d):
    return graph.hub_cap(edges_of(spark, d)).select(F.round("mean_degree", 6).alias("mean_degree"), "hub_cap")


@R.query(f"WITH {E_}, {ENDS} SELECT id, count(*) AS degree, count(DISTINCT other) AS neighbours FROM n GROUP BY id")
def e3_degrees(spark, d):
    return graph.degrees(edges_of(spark, d))


@R.query(f"WITH {E_}, {A_}, {P_} SELECT CASE WHEN t.type = 'category' THEN 'oversized' ELSE 'flat_list' END AS finding, t.id, count(*) AS n FROM p JOIN a k ON k.id = p.child JOIN a t ON t.id = p.parent WHERE k.type <> 'category' AND (t.type = 'category' OR t.id <> {OWNER}) GROUP BY 1, 2 HAVING count(*) > 12")
def e4_crowded(spark, d):
    return I.crowded(nodes_of(spark, d), edges_of(spark, d), owner_of(spark, d))


_BELOW = f"(SELECT source_id, target_id, relation FROM edges UNION ALL SELECT id, {OWNER}, 'part_of' FROM nodes WHERE type = 'category')"


def below_owner(spark: SparkSession, d: str, own: str) -> DataFrame:
    """Edges with every category hung below the owner, where the tables have none."""
    e = edges_of(spark, d).select("source_id", "target_id", "relation")
    return e.unionByName(nodes_of(spark, d).where("type = 'category'").select(c("id").alias("source_id"), F.lit(own).alias("target_id"), F.lit("part_of").alias("relation")))


@R.query(f"{UP_SQL.replace('FROM edges', 'FROM ' + _BELOW)}, t AS (SELECT l.c AS id FROM l JOIN nodes n ON n.id = l.c WHERE n.type = 'category' AND l.p = {OWNER}) SELECT t.id, count(DISTINCT ok.node) AS descendants FROM t LEFT JOIN ok ON ok.anc = t.id GROUP BY t.id")
def e5_area_sizes(spark, d):
    """Descendants of the categories below the owner."""
    own = owner_of(spark, d)
    return answers.breakdown(nodes_of(spark, d), below_owner(spark, d, own), own)


@R.query(f"""WITH {E_}, {A_}, {P_}, s AS (SELECT p.child AS id, count(*) AS n, bool_or(p.parent = {OWNER}) AS un, bool_and(t.type = 'category' OR p.parent = {OWNER}) AS good FROM p JOIN a t ON t.id = p.parent GROUP BY 1),
    x AS (SELECT a.id, a.type, a.embedding, coalesce(s.n, 0) AS n, coalesce(s.un, false) AS un, s.good FROM a LEFT JOIN s USING (id) WHERE a.id <> {OWNER})
    SELECT 'unrooted_category' AS finding, id FROM x WHERE type = 'category' AND n = 0 UNION ALL SELECT 'category_bad_parent', id FROM x WHERE type = 'category' AND n > 0 AND (n > 1 OR NOT good) UNION ALL SELECT 'orphan', id FROM x WHERE type <> 'category' AND n = 0
    UNION ALL SELECT 'multi_parent', id FROM x WHERE type <> 'category' AND n > 1 UNION ALL SELECT 'under_identity', id FROM x WHERE type <> 'category' AND un UNION ALL SELECT 'legacy_task', id FROM x WHERE type = 'task' UNION ALL SELECT 'missing_embedding', id FROM x WHERE embedding IS NULL OR len(embedding) = 0""")
def e6_parent_findings(spark, d):
    return I.parent_findings(nodes_of(spark, d), edges_of(spark, d), owner_of(spark, d))


@R.query(f"WITH {E_}, {A_}, {P_} SELECT t.id, count(*) AS n_children, min(k.name) AS first_child FROM p JOIN a k ON k.id = p.child JOIN a t ON t.id = p.parent WHERE t.type = 'fact' GROUP BY t.id")
def e7_fact_parents(spark, d):
    return I.fact_parents(nodes_of(spark, d), edges_of(spark, d))


_FINDINGS = "unrooted_category category_bad_parent orphan multi_parent under_identity legacy_task missing_embedding oversized flat_list dangling_edge redundant_link misoriented category_link fact_parent".split()


@R.query(f"""SELECT k.finding, count(x.finding) AS n FROM (SELECT unnest({_FINDINGS}) AS finding) k LEFT JOIN (SELECT finding FROM ({R.sql['e6_parent_findings']}) UNION ALL SELECT finding FROM ({R.sql['e4_crowded']}) UNION ALL SELECT 'dangling_edge' FROM ({R.sql['c3_dangling_edges']})
    UNION ALL SELECT 'redundant_link' FROM (WITH {E_} SELECT DISTINCT r.id FROM e r JOIN e p ON p.relation = 'part_of' AND least(p.source_id, p.target_id) = least(r.source_id, r.target_id) AND greatest(p.source_id, p.target_id) = greatest(r.source_id, r.target_id) WHERE r.relation = 'relates_to')
    UNION ALL SELECT 'misoriented' FROM ({R.sql['c6_misoriented']}) UNION ALL SELECT 'category_link' FROM ({R.sql['c5_category_links']}) UNION ALL SELECT 'fact_parent' FROM ({R.sql['e7_fact_parents']})) x ON x.finding = k.finding GROUP BY k.finding""")
def e9_report(spark, d):
    return I.report(nodes_of(spark, d), edges_of(spark, d), owner_of(spark, d))


@R.query("SELECT (SELECT max(ingested_at) FROM ingestion_log) AS last_ingested, (SELECT max(indexed_at) FROM vault_files) AS last_indexed")
def e13_freshness(spark, d):
    a = table(spark, d, "ingestion_log").agg(F.max("ingested_at").alias("last_ingested")).withColumn("k", F.lit(1))
    return a.join(_files(spark, d).agg(F.max("indexed_at").alias("last_indexed")).withColumn("k", F.lit(1)), "k").drop("k")


@R.query("SELECT coalesce(importance, 0) >= 0.7 AND path IS NULL AS gap, count(*) AS n, round(avg(coalesce(importance, 0)), 6) AS mean FROM nodes WHERE archived = 0 GROUP BY 1")
def e16_coverage(spark, d):
    n = nodes_of(spark, d).where("archived = 0").withColumn("i", F.coalesce("importance", F.lit(0.0)))
    return n.groupBy(((c("i") >= 0.7) & c("path").isNull()).alias("gap")).agg(F.count("*").alias("n"), F.round(F.avg("i"), 6).alias("mean"))


# ---- rankings ----

_QUERY = "harbour notes for the invoice"


@R.query()
def f1_keyword_search(spark, d):
    """Top 20 of a keyword search; scores are checked by h1_keyword_scores."""
    return search.in_order(search.search_nodes(nodes_of(spark, d), _QUERY), 20)


_ST = "(h = t OR (least(length(h), length(t)) >= 4 AND abs(length(h) - length(t)) <= 3 AND (starts_with(h, t) OR starts_with(t, h))))"


def _sql_hits(tokens: list[str], of: str) -> str:
    return " + ".join(f"(CASE WHEN len(list_filter({of}, lambda h: {_ST.replace('(t)', f'({t!r})').replace('= t', f'= {t!r}').replace(', t)', f', {t!r})').replace('(t,', f'({t!r},')})) > 0 THEN 1 ELSE 0 END)" for t in tokens)


_T = ["harbour", "notes", "invoice"]


@R.query(f"""WITH x AS (SELECT id, type, weight, lower(coalesce(name, '')) AS n, lower(coalesce(name, '')) || ' ' || lower(coalesce(content, '')) AS h FROM nodes WHERE archived = 0),
    y AS (SELECT *, regexp_extract_all(n, '[a-z0-9]+') AS nt, regexp_extract_all(h, '[a-z0-9]+') AS ht FROM x), z AS (SELECT *, {_sql_hits(_T, 'ht')} AS k FROM y)
    SELECT id, CAST(k + CASE WHEN contains(h, '{_QUERY}') THEN 3 ELSE 0 END AS BIGINT) AS hits, CAST(CASE WHEN type = 'category' THEN 0 ELSE 1 END AS BIGINT) AS entity, CAST(CASE WHEN array_to_string(nt, ' ') = 'harbour invoice notes' OR n = '{_QUERY}' THEN 1 ELSE 0 END AS BIGINT) AS exact, CAST({_sql_hits(_T, 'nt')} AS BIGINT) AS name_hits FROM z WHERE k > 0""")
def h1_keyword_scores(spark, d):
    s = search.search_nodes(nodes_of(spark, d), _QUERY)
    return s.select("id", *[c(x).cast("long").alias(x) for x in ("hits", "entity", "exact", "name_hits")])


R.sql["f1_keyword_search"] = f"SELECT id, hits, entity, exact, name_hits, weight, CAST(row_number() OVER (ORDER BY hits DESC, entity DESC, exact DESC, name_hits DESC, weight DESC, id) AS BIGINT) AS rank FROM ({R.sql['h1_keyword_scores']}) JOIN (SELECT id, weight FROM nodes) USING (id) ORDER BY rank LIMIT 20"


def _sql_file_hits(of: str) -> str:
    return _sql_hits(_T, of)


_HEAD = "lower(concat_ws(' ', coalesce(title, ''), array_to_string(coalesce(aliases, []), ' ')))"


@R.query(f"""WITH x AS (SELECT path, kind, {_HEAD} AS h, coalesce(tokens, []) AS tk FROM vault_files), y AS (SELECT path, kind, h, list_filter(regexp_extract_all(h, '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({sql_list(X.STOP)}, t)) AS ht, tk FROM x),
    z AS (SELECT path, kind, 3 * ({_sql_file_hits('ht')}) + ({_sql_file_hits('tk')}) + CASE WHEN contains(h, '{_QUERY}') THEN 6 ELSE 0 END AS s FROM y) SELECT path, round(CASE WHEN kind IN ('readme', 'hub') THEN s * 0.6 ELSE CAST(s AS DOUBLE) END, 3) AS score FROM z WHERE s > 0""")
def h2_plain_file_scores(spark, d):
    """File scores without seeds and vectors."""
    return search.file_scores(_files(spark, d), _QUERY).select("path", "score")


_Q64 = [1.0] + [0.5] * 7 + [0.0] * 56


@R.query(f"SELECT id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_Q64} AS DOUBLE[])), 6) AS cosine FROM nodes WHERE archived = 0 AND type <> 'category' AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0 ORDER BY 2 DESC, 1 LIMIT 10")
def f2_semantic_search(spark, d):
    n = nodes_of(spark, d).where("archived = 0 and type <> 'category' and size(embedding) = 64").where(V.norm(c("embedding")) > 0)
    return search.semantic(n, "id", "embedding", _Q64, 10)


@R.query()
def f3_file_search(spark, d):
    return search.best_files(search.file_scores(_files(spark, d), _QUERY)).select("path", "score", F.array_join("why", "; ").alias("why"))


@R.query(f"SELECT id, round({LEFT}, 6) AS days_left FROM nodes WHERE archived = 0 AND weight >= 0.1 AND {LEFT} IS NOT NULL ORDER BY {LEFT}, id LIMIT 5")
def f8_at_risk(spark, d):
    return decaying.at_risk(nodes_of(spark, d), AS_OF).select("id", F.round("days_left", 6).alias("days_left"))


@R.query(f"SELECT id, round(coalesce(importance, 0) * weight, 6) AS score FROM nodes WHERE archived = 0 AND type NOT IN ('category', 'task') AND id <> {OWNER} ORDER BY 2 DESC, importance DESC NULLS LAST, name, id LIMIT 6")
def f7_top_of_mind(spark, d):
    return answers.top_of_mind(nodes_of(spark, d), owner_of(spark, d)).select("id", "score")


@R.query()
def f9_hints(spark, d):
    n = nodes_of(spark, d)
    near = search.semantic(n.where("archived = 0"), "id", "embedding", _Q64, 40)
    return ingest.hints(n, search.in_order(search.search_nodes(n, _QUERY), 40), near)


@R.query("SELECT id, name, importance FROM nodes WHERE archived = 0 AND importance >= 0.7 AND path IS NULL")
def f13_coverage_gaps(spark, d):
    return nodes_of(spark, d).where("archived = 0 and importance >= 0.7 and path is null").select("id", "name", "importance")


@R.query("SELECT type, CAST(r AS BIGINT) AS rank, id FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY importance DESC NULLS LAST, weight DESC NULLS LAST, id) AS r FROM nodes WHERE archived = 0) WHERE r <= 3")
def f14_top_per_type(spark, d):
    return graph.ranked_per_type(nodes_of(spark, d)).select("type", c("rank").cast("long").alias("rank"), "id")


@R.query()
def f15_who_search(spark, d):
    return search.best_files(search.file_scores(_files(spark, d), "who asked about the harbour"), who=True).select("path", "kind", "score")


@R.query("""WITH v AS (SELECT id, type, CAST(embedding AS DOUBLE[]) AS v FROM nodes WHERE archived = 0 AND type IN ('skill', 'task') AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0)
    SELECT a, b, cosine FROM (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS cosine, row_number() OVER (PARTITION BY x.id ORDER BY round(list_cosine_similarity(x.v, y.v), 9) DESC, y.id) AS r FROM v x JOIN v y ON x.type = y.type AND x.id <> y.id) WHERE r = 1""")
def f20_nearest_of_type(spark, d):
    """The most similar other node of its type for every skill and task; of equal ones the smaller id."""
    v = nodes_of(spark, d).where("archived = 0 and type in ('skill', 'task') and size(embedding) = 64").where(V.norm(c("embedding")) > 0).select("id", "type", F.transform("embedding", lambda x: x.cast("double") / V.norm(c("embedding"))).alias("u"))
    return I.nearest_of_type(v).select("a", "b", F.round("cos", 6).alias("cosine"))


# ---- traversal ----


@R.query(f"""WITH {E_}, {A_}, {ENDS}, s AS (SELECT id, 0 AS d FROM a WHERE type = 'skill'), deg AS (SELECT id, count(DISTINCT other) AS k FROM n GROUP BY id),
    l1 AS (SELECT DISTINCT n.other AS id FROM s JOIN n ON n.id = s.id JOIN a ON a.id = n.other WHERE n.other NOT IN (SELECT id FROM s)),
    l2 AS (SELECT DISTINCT n.other AS id FROM l1 JOIN deg ON deg.id = l1.id AND deg.k <= 8 JOIN n ON n.id = l1.id JOIN a ON a.id = n.other WHERE n.other NOT IN (SELECT id FROM s) AND n.other NOT IN (SELECT id FROM l1))
    SELECT id, CAST(d AS BIGINT) AS depth FROM s UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2""")
def g1_neighbourhood(spark, d):
    n = nodes_of(spark, d)
    seeds = n.where("type = 'skill'").select("id")
    return graph.neighbourhood(n, edges_of(spark, d), seeds, depth=2, hub=8).select("id", c("depth").cast("long").alias("depth"))


@R.query(f"WITH {E_} SELECT DISTINCT target_id AS parent, source_id AS child FROM e WHERE relation = 'part_of'")
def g3_children(spark, d):
    return graph.children(edges_of(spark, d))


@R.query()
def g6_cycles(spark, d):
    """Nodes on cycles of first parents with the smallest node of their cycle; checked in the tests."""
    one = graph.first_parent(edges_of(spark, d))
    lost = hierarchy.roots_and_depths(one).where("depth = -1").select(c("node_id").alias("child"))
    return I.cycle_members(one.join(lost, "child"))


@R.query()
def g7_tree(spark, d):
    """Pre-order of the forest of first parents by importance; checked in the tests."""
    return graph.tree_rows(edges_of(spark, d), nodes_of(spark, d)).select("id", c("depth").cast("long").alias("depth"), "sort_path")


@R.query(f"{UP_SQL} SELECT anc AS id, count(DISTINCT node) AS descendants FROM ok GROUP BY anc")
def g8_subtree_sizes(spark, d):
    links = hierarchy.structural_links(nodes_of(spark, d), table(spark, d, "edges"))
    return graph.subtree_sizes(hierarchy.closure(links))


@R.query()
def g10_communities(spark, d):
    """Label propagation, another algorithm than modularity optimisation; checked in the tests on a fixture."""
    return graph.label_propagation(edges_of(spark, d))


@R.query()
def g11_link_hop(spark, d):
    f = _files(spark, d)
    s = search.file_scores(f, _QUERY)
    v = table(spark, d, "vault_file_nodes").select("path", "node_id")
    links = v.join(v.select(c("path").alias("target"), "node_id"), "node_id").where("path <> target").select("path", "target").distinct()  # files of one node, which has few
    return search.hop(s, links, f).select("path", "score")


@R.query(f"{UP_SQL} SELECT id FROM nodes WHERE archived = 0 AND type <> 'category' AND id NOT IN (SELECT node FROM ok WHERE anc IN (SELECT id FROM nodes WHERE type = 'category'))")
def g12_loose_ends(spark, d):
    """Active nodes below no category."""
    n, e = nodes_of(spark, d), edges_of(spark, d)
    cl = hierarchy.closure(hierarchy.structural_links(n, table(spark, d, "edges")))
    inside = cl.join(n.where("type = 'category'").select(c("id").alias("ancestor_id")), "ancestor_id", "left_semi").select(c("node_id").alias("id")).distinct()
    return I.active(n).where("type <> 'category'").select("id").join(inside, "id", "left_anti")


# ---- retrieval ----


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return search.in_order(search.search_nodes(nodes_of(spark, d), _QUERY), 6)


@R.query()
def h2_file_scores(spark, d):
    """All file scores with their reasons; checked in the tests."""
    return search.file_scores(_files(spark, d), _QUERY, table(spark, d, "vault_file_nodes").join(_seeds(spark, d).select(c("id").alias("node_id")), "node_id", "left_semi")).select("path", "score", F.array_join("why", "; ").alias("why"))


@R.query()
def h3_query_touch(spark, d):
    """The touch delta of all nodes a query found, before any limit."""
    n = nodes_of(spark, d)
    found = search.search_nodes(n, _QUERY).select("id")
    return decaying.touched(n, edges_of(spark, d), found, AS_OF).select("id", F.round("weight", 6).alias("weight"), c("access_count").cast("long").alias("access_count"), "last_accessed").join(n.select("id", c("last_accessed").alias("before")), "id").where("last_accessed is distinct from before").drop("before")


@R.query()
def h6_evidence(spark, d):
    files = search.best_files(search.file_scores(_files(spark, d), _QUERY))
    return answers.evidence(nodes_of(spark, d), edges_of(spark, d), _seeds(spark, d), files)


@R.query("SELECT type, count(*) AS n FROM nodes WHERE archived = 0 GROUP BY type")
def h7_context(spark, d):
    n = nodes_of(spark, d)
    return answers.context(n, I.active(n).select("id")).select("type", "n")


@R.query()
def h8_digest(spark, d):
    """Sections of a digest: top of mind, fading, areas."""
    n, own = nodes_of(spark, d), owner_of(spark, d)
    a = answers.top_of_mind(n, own).select(F.lit("top").alias("section"), c("id").alias("ref"), F.col("score").alias("value"))
    b = decaying.at_risk(n, AS_OF).select(F.lit("fading").alias("section"), c("id").alias("ref"), F.round("days_left", 6).alias("value"))
    e = answers.breakdown(n, below_owner(spark, d, own), own).select(F.lit("area").alias("section"), c("id").alias("ref"), F.col("descendants").cast("double").alias("value"))
    return a.unionByName(b).unionByName(e)


#: Contents with claims, of which the tables have none: plans, promises with a date, dated plans and cited loops.
_CLAIM = "concat(coalesce(content, ''), CASE abs(access_count) % 5 WHEN 0 THEN ' It plans to grow.' WHEN 1 THEN ' It will open on May 5, 2026.' WHEN 2 THEN ' As of May it plans to stay.' WHEN 3 THEN ' It waits for L-' || lpad(CAST(abs(access_count) % 1000 AS VARCHAR), 3, '0') || ' and plans to go on.' ELSE '' END)"
_PROMISE = D.PROMISED.replace("content", "c")
_pg = lambda g: f"regexp_extract(c, '{_PROMISE}', {g})"


@R.query(rf"""SELECT id, phrase, CAST(age AS BIGINT) AS age_days FROM (SELECT id, age, coalesce(
      CASE WHEN len(cited) > 0 THEN 'cites closed ' || array_to_string(cited, ', ') END,
      CASE WHEN try_cast(concat(coalesce(nullif({_pg(3)}, ''), CAST(year({DAY}) AS VARCHAR)), '-', {MONTH_NO.format(_pg(1))}, '-', {_pg(2)}) AS DATE) < {DAY} AND {MONTH_NO.format(_pg(1))} IS NOT NULL THEN trim({_pg(0)}) || ' (passed)' END,
      CASE WHEN age >= 30 AND NOT regexp_matches(c, '{X.DATED}') AND regexp_matches(c, '{X.PLAN}') THEN regexp_extract(c, '{X.PLAN}', 0) END) AS phrase
    FROM (SELECT id, c, age, list_filter(regexp_extract_all(c, '\bL-\d{{3}}\b'), lambda r, i: list_position(regexp_extract_all(c, '\bL-\d{{3}}\b'), r) = i AND CAST(right(r, 1) AS INT) % 2 = 0) AS cited FROM (SELECT id, {_CLAIM} AS c, CAST(floor(({AS_OF} - created_at) / 86400) AS INT) AS age FROM nodes WHERE archived = 0 AND type <> 'category'))) WHERE phrase IS NOT NULL""")
def i2_stale_claims(spark, d):
    """Cited closed loops first, here those of even numbers, then promises whose day is past, then plans of a month and more."""
    k = F.abs("access_count")
    claim = F.when(k % 5 == 0, " It plans to grow.").when(k % 5 == 1, " It will open on May 5, 2026.").when(k % 5 == 2, " As of May it plans to stay.").when(k % 5 == 3, F.concat(F.lit(" It waits for L-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" and plans to go on."))).otherwise("")
    n = nodes_of(spark, d).withColumn("content", F.concat(F.coalesce("content", F.lit("")), claim))
    closed = spark.range(0, 1000, 2).select(F.format_string("L-%03d", "id").alias("id"))
    return I.stale_claims(n, AS_OF, closed).select("id", "phrase", c("age_days").cast("long").alias("age_days"))


@R.query("SELECT 'index' AS check, CASE WHEN (SELECT max(indexed_at) FROM vault_files) >= (SELECT max(mtime) FROM vault_files) THEN 'ok' ELSE 'stale' END AS status UNION ALL SELECT 'coverage', CASE WHEN (SELECT count(*) FROM nodes WHERE archived = 0 AND importance >= 0.7 AND path IS NULL) = 0 THEN 'ok' ELSE 'gap' END")
def i7_doctor(spark, d):
    f = _files(spark, d).agg(F.max("indexed_at").alias("i"), F.max("mtime").alias("m")).select(F.lit("index").alias("check"), F.when(c("i") >= c("m"), "ok").otherwise("stale").alias("status"))
    g = f13_coverage_gaps(spark, d).agg(F.count("*").alias("n")).select(F.lit("coverage").alias("check"), F.when(c("n") == 0, "ok").otherwise("gap").alias("status"))
    return f.unionByName(g)


# ---- sets ----


@R.query("SELECT path FROM vault_files EXCEPT SELECT path FROM documents")
def n1_removed_files(spark, d):
    return _files(spark, d).select("path").subtract(table(spark, d, "documents").select("path"))


@R.query("SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'index' WHEN a.path IS NULL THEN 'disk' ELSE 'both' END AS place FROM (SELECT DISTINCT path FROM vault_files) a FULL JOIN (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL) b ON a.path = b.path")
def n2_disk_and_index(spark, d):
    a = _files(spark, d).select("path", F.lit(1).alias("a")).distinct()
    b = table(spark, d, "documents").where("path is not null").select("path", F.lit(1).alias("b")).distinct()
    return a.join(b, "path", "full_outer").select("path", F.when(c("b").isNull(), "index").when(c("a").isNull(), "disk").otherwise("both").alias("place"))


@R.query("SELECT path FROM vault_files UNION SELECT path FROM documents WHERE path IS NOT NULL")
def n3_all_paths(spark, d):
    return _files(spark, d).select("path").union(table(spark, d, "documents").where("path is not null").select("path")).distinct()


_W = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"


@R.query(f"SELECT id, len(list_intersect({_W.format('name')}, {_W.format('content')})) AS shared, len(list_filter({_W.format('name')}, lambda x: NOT list_contains({_W.format('content')}, x))) AS only_name, len(list_filter({_W.format('name')}, lambda x: NOT list_contains({_W.format('content')}, x))) = 0 AS inside FROM nodes")
def n4_token_sets(spark, d):
    a, b = F.array_distinct(X.ascii_words(c("name"))), F.array_distinct(X.ascii_words(c("content")))
    return nodes_of(spark, d).select("id", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_except(a, b)).alias("only_name"), (F.size(F.array_except(a, b)) == 0).alias("inside"))


@R.query(f"WITH {E_} SELECT DISTINCT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi FROM e")
def n7_unordered_pairs(spark, d):
    return edges_of(spark, d).select(F.least("source_id", "target_id").alias("lo"), F.greatest("source_id", "target_id").alias("hi")).distinct()


@R.query("WITH x AS (SELECT path, unnest([lower(title)] || list_transform(aliases, lambda a: lower(a))) AS w FROM vault_files) SELECT path, count(DISTINCT w) AS n FROM x GROUP BY path")
def n8_distinct_aliases(spark, d):
    f = _files(spark, d)
    return f.select("path", F.size(F.array_distinct(F.concat(F.array(F.lower("title")), F.transform("aliases", lambda a: F.lower(a))))).cast("long").alias("n"))
