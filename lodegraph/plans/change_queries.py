"""Queries of ledger changes, ledgers by meaning, views, structure and the store's calls, with their SQL.

Changes run on a ledger of short ids and on requests derived from the tables, some of which break a rule.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vocab import relation
from ..operators import ledger_changes as C
from ..operators import ledger_index, mutate, search, structure, views
from ..sources import ledgers
from ..sources.tables import AS_OF, table
from ..store import Store
from . import composite_sql as S
from . import graph_queries as G
from .ledger_queries import _DEC, _LOOPS, TODAY, _day, _flat, decision_rows, loop_rows
from .registry import Registry
from .scalar_queries import sql_list

R = Registry()
c = F.col
SHORT = f"{_LOOPS}, lg AS (SELECT 'L-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id, title, due, owner, area, CAST(prio AS INT) AS prio, since, touched, done, '' AS note, next FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM l))"


def short_loops(spark: SparkSession, d: str) -> DataFrame:
    """The ledger under the numbers of its loops."""
    return loop_rows(spark, d).withColumn("id", F.format_string("L-%03d", F.row_number().over(W.orderBy("id"))))  # a ledger is one file


_BROKEN = """CASE WHEN trim(title) = '' THEN 'title is empty' WHEN due IS NULL THEN 'due: bad date' WHEN NOT regexp_matches(owner, '^(owner|agent|waiting:[a-z0-9][a-z0-9-]*)$') THEN 'bad owner' WHEN area NOT IN ('work', 'study', 'training', 'business', 'life', 'other') THEN 'bad area'
    WHEN prio NOT BETWEEN 1 AND 3 THEN 'bad prio' WHEN contains(title || next || note, '·') THEN 'a text holds a separator or line end' WHEN trim(next) = '' THEN 'next action is empty' END"""
_NEW = f"""nw AS (SELECT *, {_BROKEN} AS refusal FROM (SELECT id AS pos, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS title, CAST(make_timestamp(CAST(created_at * 1000000 AS BIGINT)) AS DATE) + 30 AS due, list_extract(['owner', 'agent', 'nobody here'], CAST(abs(access_count) % 3 + 1 AS INT)) AS owner,
    list_extract(['work', 'study', 'training', 'business', 'life', 'other', 'nowhere'], CAST(abs(access_count) % 7 + 1 AS INT)) AS area, CAST(abs(access_count) % 4 AS INT) AS prio, CASE WHEN abs(access_count) % 5 = 0 THEN '' ELSE 'go on' END AS next, '' AS note FROM nodes WHERE type = 'event' AND trim(name) <> ''))"""


def _added(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.abs("access_count")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    new = table(spark, d, "nodes").where("type = 'event' and trim(name) <> ''").select(c("id").alias("pos"), _flat(c("name")).alias("title"), _day("created_at", 30).alias("due"), pick(["owner", "agent", "nobody here"], 3).alias("owner"), pick([*ledgers.AREAS, "nowhere"], 7).alias("area"), (k % 4).cast("int").alias("prio"), F.when(k % 5 == 0, "").otherwise("go on").alias("next"))
    return C.added(short_loops(spark, d), new, TODAY)


@R.query(f"WITH {SHORT}, {_NEW}, m AS (SELECT max(CAST(regexp_extract(id, '(\\d+)$', 1) AS INT)) AS n FROM lg) SELECT 'L-' || CASE WHEN n + r < 1000 THEN lpad(CAST(n + r AS VARCHAR), 3, '0') ELSE CAST(n + r AS VARCHAR) END AS id, title, CAST(due AS VARCHAR) AS due, owner, area, CAST(prio AS BIGINT) AS prio FROM (SELECT *, row_number() OVER (ORDER BY pos) AS r FROM nw WHERE refusal IS NULL), m")
def d21_added(spark, d):
    return _added(spark, d)[0].select("id", "title", c("due").cast("string").alias("due"), "owner", "area", c("prio").cast("long").alias("prio"))


@R.query(f"WITH {_NEW} SELECT pos, refusal FROM nw WHERE refusal IS NOT NULL")
def d21_add_refusals(spark, d):
    return _added(spark, d)[1]


def _ids(loops: DataFrame, where: str) -> DataFrame:
    return loops.where(where).select("id").unionByName(loops.sparkSession.createDataFrame([("L-99999999",)], "id string"))


@R.query(f"WITH {SHORT} SELECT id, CAST(CASE WHEN done IS NULL AND area = 'work' THEN DATE '{TODAY}' ELSE done END AS VARCHAR) AS done, CAST(CASE WHEN done IS NULL AND area = 'work' THEN DATE '{TODAY}' ELSE touched END AS VARCHAR) AS touched, CASE WHEN done IS NULL AND area = 'work' THEN 'closed now' ELSE note END AS note FROM lg")
def d21_closed(spark, d):
    lg = short_loops(spark, d)
    out, _ = C.closed(lg, _ids(lg, "area = 'work'").withColumn("note", F.lit(" closed now ")), TODAY)
    return out.select("id", c("done").cast("string").alias("done"), c("touched").cast("string").alias("touched"), "note")


@R.query(f"WITH {SHORT} SELECT id, CAST(CASE WHEN done IS NULL AND prio = 1 THEN DATE '{TODAY}' ELSE touched END AS VARCHAR) AS touched FROM lg")
def d21_touched(spark, d):
    lg = short_loops(spark, d)
    return C.touched(lg, _ids(lg, "prio = 1"), TODAY)[0].select("id", c("touched").cast("string").alias("touched"))


@R.query(f"WITH {SHORT} SELECT id, 'closed already' AS refusal FROM lg WHERE prio = 1 AND done IS NOT NULL UNION ALL SELECT 'L-99999999', 'unknown loop'")
def d21_touch_refusals(spark, d):
    lg = short_loops(spark, d)
    return C.touched(lg, _ids(lg, "prio = 1"), TODAY)[1]


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lg = short_loops(spark, d)
    e = lg.where("prio = 2").select("id", F.when(c("area") == "study", "agent").alias("owner"), F.when(c("area") == "life", 5).alias("prio"), F.when(c("area") == "other", "").alias("next"), F.when(c("area") == "business", "2026-13-01").when(c("area") == "study", "2026-7-9").alias("due"))
    return C.edited(lg, e, TODAY)


@R.query(f"WITH {SHORT} SELECT id, CASE WHEN prio = 2 AND area = 'study' AND done IS NULL THEN 'agent' ELSE owner END AS owner, CAST(CASE WHEN prio = 2 AND area = 'study' AND done IS NULL THEN DATE '2026-07-09' ELSE due END AS VARCHAR) AS due, CAST(CASE WHEN prio = 2 AND area = 'study' AND done IS NULL THEN DATE '{TODAY}' ELSE touched END AS VARCHAR) AS touched FROM lg")
def d21_edited(spark, d):
    return _edited(spark, d)[0].select("id", "owner", c("due").cast("string").alias("due"), c("touched").cast("string").alias("touched"))


@R.query(f"WITH {SHORT} SELECT * FROM (SELECT id, CASE WHEN done IS NOT NULL THEN 'closed already' WHEN area IN ('work', 'training') THEN 'nothing to change' WHEN area = 'business' THEN 'due: bad date' WHEN area = 'life' THEN 'bad prio' WHEN area = 'other' THEN 'next action is empty' END AS refusal FROM lg WHERE prio = 2) WHERE refusal IS NOT NULL")
def d21_edit_refusals(spark, d):
    return _edited(spark, d)[1]


_AREA = f"list_extract({sql_list(ledgers.AREAS)}, CAST(length(title) % 6 + 1 AS INT))"


def area_files(spark: SparkSession, d: str) -> DataFrame:
    a = F.element_at(F.array(*[F.lit(x) for x in ledgers.AREAS]), (F.length("title") % 6 + 1).cast("int"))
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n## Now\n- first\n"), F.when(F.length("title") % 2 == 0, F.concat(F.lit("- about "), F.col("title"), F.lit("\n"))).otherwise(""), F.lit("\n## Later\nx\n"))
    return table(spark, d, "vault_files").where("kind = 'area'").select("path", a.alias("area"), "title", "updated", body.alias("body"), "aliases")


@R.query(f"WITH f AS (SELECT path, {_AREA} AS area, updated FROM vault_files WHERE kind = 'area') SELECT path, CASE WHEN path IN (SELECT min(path) FROM f WHERE area IN ('work', 'study') GROUP BY area) THEN '{TODAY}' ELSE updated END AS updated FROM f")
def d25_touched_areas(spark, d):
    return C.touched_area(area_files(spark, d), spark.createDataFrame([("work",), ("study",)], "area string"), TODAY).select("path", "updated")


@R.query(f"WITH h AS ({G.R.sql['a22_usable_inputs']}) SELECT '{TODAY}' AS date, 'ingest' AS source, count(*) AS n FROM (SELECT DISTINCT 'call ' || coalesce(source, 'nobody') AS t FROM ingestion_log WHERE raw_text IS NOT NULL) WHERE t <> 'call cli'")
def d29_routed_tasks(spark, d):
    """Tasks of all texts on their way to the inbox, one of them known."""
    known = spark.createDataFrame([("Call CLI.",)], "text string")
    r = C.routed(G.d14_tasks(spark, d).select("text"), known, known.where("false").select(c("text").alias("hash")), TODAY, "ingest")
    return r.groupBy(c("date").cast("string").alias("date"), "source").agg(F.count("*").alias("n"))


# ---- ledgers by meaning ----

_LETTERS = "aeinorst"
_DX = "dx AS (SELECT 'D-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS id, * FROM dd)"
_REC = f"{SHORT}, {_DEC}, {_DX}, rec AS (SELECT *, left(sha256(text), 16) AS sha FROM (SELECT id AS key, trim(id || ' ' || title || '. Next: ' || next || '. ' || note) AS text FROM lg UNION ALL SELECT id, trim(id || ' ' || title || '. ' || decision || ' Why: ') FROM dx))"
_VEC = "[" + ", ".join(f"CAST(length(text) - length(replace(text, '{x}', '')) AS DOUBLE)" for x in _LETTERS) + "]"
_QV = [float("harbour invoice".count(x)) for x in _LETTERS]


def letter_counts(texts: pd.Series) -> list[list[float]]:
    """A stand-in for an embedder: how often a text has each of eight letters."""
    return [[float(t.count(x)) for x in _LETTERS] for t in texts]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return ledger_index.records(short_loops(spark, d), decision_rows(spark, d))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all records after an index that knew some of them, in part in another wording."""
    r = _records(spark, d)
    last = F.right("key", F.lit(1)).cast("int")
    prev = r.where(last < 5).select("key", F.when(last == 1, "older").otherwise(c("sha")).alias("sha"), F.array(*[F.lit(1.0)] * 8).cast("array<float>").alias("embedding"))
    return ledger_index.embedded(r, prev.unionByName(spark.createDataFrame([("L-gone", "x", [1.0])], "key string, sha string, embedding array<float>")), letter_counts)


_IDX = f"{_REC}, ix AS (SELECT key, CASE WHEN CAST(right(key, 1) AS INT) < 5 THEN CASE WHEN CAST(right(key, 1) AS INT) = 1 THEN 'updated' ELSE 'unchanged' END ELSE 'added' END AS status, CASE WHEN CAST(right(key, 1) AS INT) IN (0, 2, 3, 4) THEN [1.0, 1, 1, 1, 1, 1, 1, 1] ELSE {_VEC} END AS v FROM rec)"
_NEARL = f"{_IDX}, nl AS (SELECT key, round(c, 3) AS cosine FROM (SELECT key, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST({_QV} AS DOUBLE[])), 6) AS c FROM ix) WHERE c >= 0.5 ORDER BY cosine DESC, key LIMIT 6)"


@R.query(f"WITH {_IDX} SELECT key, status, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ' ') AS v FROM ix")
def d18_ledger_vectors(spark, d):
    return _indexed(spark, d).select("key", "status", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("v"))


@R.query(f"WITH {_NEARL} SELECT key, cosine FROM nl")
def f4_ledger_semantic(spark, d):
    return ledger_index.semantic(_indexed(spark, d), _QV)


_LHITS = lambda of: f"len(list_filter(['harbour', 'invoice'], lambda t: list_contains(regexp_extract_all(lower({of}), '[a-z0-9][a-z0-9.+-]{{2,}}'), t)))"


@R.query(f"""WITH {_NEARL}, dh AS (SELECT id, 'decision' AS kind, 0 AS src, -h AS o, 0 AS o2 FROM (SELECT id, {_LHITS("title || ' ' || decision")} AS h FROM dx) WHERE h > 0 ORDER BY h DESC, id LIMIT 5),
    lh AS (SELECT id, 'loop' AS kind, 0 AS src, -h AS o, CASE WHEN done IS NULL THEN 0 ELSE 1 END AS o2 FROM (SELECT id, done, {_LHITS("title || ' ' || next")} AS h FROM lg) WHERE h > 0 ORDER BY h DESC, done IS NOT NULL, id LIMIT 5),
    ev AS (SELECT * FROM dh UNION ALL SELECT * FROM lh UNION ALL SELECT key, CASE WHEN starts_with(key, 'D-') THEN 'decision' ELSE 'loop' END, 1, -cosine, 0 FROM nl WHERE key NOT IN (SELECT id FROM dh UNION ALL SELECT id FROM lh)),
    tp AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY src, o, o2, id) AS pos FROM ev)
    SELECT kind, pos, id, coalesce((SELECT id || ' (' || CAST(date AS VARCHAR) || ') ' || title || ': ' || decision || ' Why: ' FROM dx WHERE dx.id = tp.id), (SELECT id || ' ' || title || ' (' || CASE WHEN done IS NOT NULL THEN 'done ' || CAST(done AS VARCHAR) ELSE 'due ' || CAST(due AS VARCHAR) || ', owner ' || owner END || '): next ' || next FROM lg WHERE lg.id = tp.id)) AS line
    FROM tp WHERE pos <= CASE WHEN kind = 'decision' THEN 6 ELSE 8 END""")
def h4_ledger_context(spark, d):
    return ledger_index.context(short_loops(spark, d), decision_rows(spark, d), "harbour invoice", f4_ledger_semantic(spark, d)).select("kind", c("pos").cast("long").alias("pos"), "id", "line")


# ---- views ----


def _read_short(spark: SparkSession, d: str) -> DataFrame:
    return short_loops(spark, d).withColumn("error", F.lit(None).cast("string")).withColumn("waiting_on", F.nullif(F.regexp_extract("owner", "^waiting:(.*)$", 1), F.lit("")))


@R.query(f"WITH {SHORT} SELECT row_number() OVER (ORDER BY prio, due, id) AS pos, title || ' (due ' || CAST(due AS VARCHAR) || ', ' || owner || ') ' || id AS line FROM lg WHERE done IS NULL")
def k6_open_loops(spark, d):
    return views.open_loops(_read_short(spark, d)).select(c("pos").cast("long").alias("pos"), "line")


@R.query(f"""WITH {SHORT}, o AS (SELECT *, nullif(regexp_extract(owner, '^waiting:(.*)$', 1), '') AS w, strftime(due, '%b %-d') AS day FROM lg WHERE done IS NULL)
    SELECT row_number() OVER (ORDER BY prio, due, id) AS pos, '- **' || title || '** — due ' || day || ' · P' || prio || CASE WHEN owner = 'owner' THEN '' ELSE ' · ' || owner END || ' · next: ' || next || '  `' || id || '`' AS line FROM o WHERE w IS NULL
    UNION ALL SELECT 2147483647, '- ⏳ **Waiting on:** ' || string_agg(w || ' — ' || title || ' (by ' || day || ') `' || id || '`', '; ' ORDER BY prio, due, id) FROM o WHERE w IS NOT NULL HAVING count(*) > 0""")
def k1_view_block(spark, d):
    return views.block(_read_short(spark, d)).select(c("pos").cast("long").alias("pos"), "line")


@R.query(f"SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN 'x{views.START}' || chr(10) || '- new' || chr(10) || '{views.END}' || coalesce(text, '') ELSE 'x' || coalesce(text, '') END) AS text, CASE WHEN doc_id % 2 = 0 THEN 'view is out of date' ELSE 'view has no marks' END AS stale FROM documents")
def k2_rendered_views(spark, d):
    """Every text as a view, half of them with a block between marks."""
    t = F.concat(F.lit("x"), F.when(c("doc_id") % 2 == 0, F.lit(f"{views.START}\nold\n{views.END}")).otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.sha2(views.with_block(t, F.lit("- new")), 256).alias("text"), views.staleness(t, F.lit("- new")).alias("stale"))


@R.query(f"""WITH f AS (SELECT path, {_AREA} AS area, title, updated FROM vault_files WHERE kind = 'area'), g AS (SELECT * FROM f WHERE path IN (SELECT min(path) FROM f GROUP BY area))
    SELECT area, 0 AS pos, '### ' || title || ' · updated ' || coalesce(strftime(try_cast(nullif(updated, '') AS DATE), '%b %-d'), '?') AS line FROM g UNION ALL SELECT area, 1, '- first' FROM g UNION ALL SELECT area, 2, '- about ' || title FROM g WHERE length(title) % 2 = 0""")
def k5_area_lines(spark, d):
    return views.area_lines(area_files(spark, d))


@R.query(f"""WITH f AS (SELECT path, {_AREA} AS area, title, try_cast(nullif(updated, '') AS DATE) AS day, aliases FROM vault_files WHERE kind = 'area'), m AS (SELECT area, min(path) AS first FROM f GROUP BY area)
    SELECT 'error' AS level, path, 'area ' || area || ' is taken by ' || first AS message FROM f JOIN m USING (area) WHERE path <> first UNION ALL SELECT 'error', path, 'updated: bad date' FROM f WHERE day IS NULL
    UNION ALL SELECT 'warning', path, 'mentioned on ' || count(DISTINCT date) || ' later days' FROM (SELECT path, day, unnest(list_distinct(list_append(coalesce(aliases, []), area))) AS al FROM f WHERE day IS NOT NULL) a
      JOIN (SELECT DISTINCT lower(text) AS t, CAST(updated AS DATE) AS date FROM documents WHERE text IS NOT NULL AND CAST(updated AS DATE) < DATE '{TODAY}') x ON x.date > a.day AND contains(x.t, lower(al)) AND regexp_matches(' ' || x.t || ' ', '[^\\p{{L}}\\p{{N}}]' || regexp_replace(lower(al), '([^\\p{{L}}\\p{{N}} ])', '\\\\\\1', 'g') || '[^\\p{{L}}\\p{{N}}]') GROUP BY path""")
def i5_area_lint(spark, d):
    logs = table(spark, d, "documents").where("text is not null").select(F.to_date("updated").alias("date"), "text")
    return views.lint(area_files(spark, d), logs, TODAY)


# ---- structure ----


@R.query(f"""{S._ANY}, {G.E_}, bl AS (SELECT node, min(d) AS d FROM ok WHERE anc = {G.OWNER} GROUP BY node), {G.ENDS}
    SELECT 'total' AS section, 'nodes' AS name, CAST(count(*) AS DOUBLE) AS n FROM nodes UNION ALL SELECT 'total', 'categories', count(*) FILTER (type = 'category') FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM e UNION ALL SELECT 'depth', 'max', coalesce(max(d), 0) FROM bl UNION ALL SELECT 'depth', 'mean', round(coalesce(avg(d), 0), 6) FROM bl
    UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'category', x.id, count(DISTINCT s.source_id) FROM nodes x LEFT JOIN (SELECT source_id, target_id FROM e WHERE relation = 'part_of') s ON s.target_id = x.id WHERE x.type = 'category' GROUP BY x.id
    UNION ALL SELECT * FROM (SELECT 'hub', id, count(*) AS k FROM n WHERE id IN (SELECT id FROM nodes) GROUP BY id ORDER BY k DESC, id LIMIT 8)""")
def e12_structure(spark, d):
    return structure.report(G.nodes_of(spark, d), G.edges_of(spark, d), G.owner_of(spark, d))


@R.query(f"""WITH {G.E_}, k AS (SELECT id, name, access_count FROM nodes WHERE archived = 0 AND type = 'category'), f AS (SELECT source_id AS id, target_id, created_at, id AS eid FROM e WHERE relation = 'part_of' UNION ALL SELECT id, (SELECT min(id) FROM k), 0.0, 'x' || id FROM k WHERE access_count % 2 = 1),
    p AS (SELECT id, min_by(target_id, (created_at, eid)) AS parent FROM f GROUP BY id) SELECT CASE WHEN a.name IS NULL THEN 0 ELSE 1 END AS level, CASE WHEN a.name IS NULL THEN k.name ELSE a.name || ' > ' || k.name END AS label FROM k LEFT JOIN p ON p.id = k.id LEFT JOIN k a ON a.id = p.parent""")
def f19_category_labels(spark, d):
    """Labels with every other category hung below the first one."""
    n = G.nodes_of(spark, d)
    k = n.where("archived = 0 and type = 'category'")
    first = k.agg(F.min("id")).first()[0]
    more = k.where("access_count % 2 = 1").select(F.concat(F.lit("x"), c("id")).alias("id"), c("id").alias("source_id"), F.lit(first).alias("target_id"), F.lit("part_of").alias("relation"), F.lit(0.0).alias("created_at"))
    return structure.category_labels(n, G.edges_of(spark, d).select("id", "source_id", "target_id", "relation", "created_at").unionByName(more))


@R.query(f"SELECT id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({G._Q64} AS DOUBLE[])), 6) AS cosine FROM nodes WHERE archived = 0 AND type <> 'category' AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0 AND round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({G._Q64} AS DOUBLE[])), 6) >= 0.2 ORDER BY 2 DESC, 1 LIMIT 6")
def f21_semantic_seeds(spark, d):
    """Seeds by meaning from a cosine on, here of 0.2, as no vector of the tables comes nearer to this query."""
    return search.semantic(G.nodes_of(spark, d).where("archived = 0 and type <> 'category'"), "id", "embedding", G._Q64, 6, 0.2)


@R.query(f"WITH {G.E_}, {G.ENDS} SELECT id AS source_id, {G.OWNER} AS target_id, 'relates_to' AS relation FROM nodes WHERE archived = 0 AND weight >= 0.3 AND id NOT IN (SELECT id FROM n) ORDER BY created_at, id LIMIT 5")
def d20_connected(spark, d):
    """Links for nodes without any, from a stand-in for a model that always names the owner."""
    return structure.connected(G.nodes_of(spark, d), G.edges_of(spark, d), lambda lone: lone.select("id", F.lit("OWNER").alias("target"), F.lit("").alias("relation")), AS_OF).select("source_id", "target_id", "relation")


@R.query("SELECT (SELECT count(*) FROM nodes WHERE archived = 0) AS nodes, (SELECT count(*) FROM (" + f"WITH {G.E_} SELECT * FROM e WHERE source_id NOT IN (SELECT id FROM nodes WHERE archived = 1) AND target_id NOT IN (SELECT id FROM nodes WHERE archived = 1))) AS edges, 0 AS cleared")
def d23_pruned(spark, d):
    n, e = mutate.pruned(G.nodes_of(spark, d), G.edges_of(spark, d))
    gone = mutate.cleared(G.nodes_of(spark, d))[0].agg(F.count("*").alias("cleared")).withColumn("k", F.lit(1))
    return n.agg(F.count("*").alias("nodes")).withColumn("k", F.lit(1)).join(e.agg(F.count("*").alias("edges")).withColumn("k", F.lit(1)), "k").join(gone, "k").drop("k")


@R.query("SELECT id, CASE WHEN type = 'task' THEN 2 ELSE coalesce(len(embedding), -1) END AS dims FROM nodes")
def d27_vectors_set(spark, d):
    n = G.nodes_of(spark, d)
    return mutate.with_vectors(n, n.where("type = 'task'").select("id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))).select("id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims"))


_KIDS = "(SELECT id FROM nodes WHERE archived = 0 AND type = 'concept')"


@R.query("""WITH k AS (SELECT min(id) AS cat FROM nodes WHERE archived = 0 AND type = 'category'), m AS (SELECT id AS child, 'Group ' || (length(trim(name)) % 3) AS grp FROM nodes WHERE archived = 0 AND type = 'concept' AND name IS NOT NULL AND length(trim(name)) % 3 > 0),
    u AS (SELECT lower(trim(name)) AS nm FROM nodes WHERE archived = 0 AND type = 'concept') SELECT child, cat AS old, 'category:' || lower(grp) AS new FROM m, k""")
def d15_subgrouped(spark, d):
    """All concepts hung below one category and dealt to groups by a plan that leaves some out."""
    n = G.nodes_of(spark, d)
    cat = n.where("archived = 0 and type = 'category'").agg(F.min("id")).first()[0]
    kids = n.where("archived = 0 and type = 'concept' and name is not null")
    e = kids.select(c("id").alias("source_id"), F.lit(cat).alias("target_id"), F.lit("part_of").alias("relation"))
    size = F.length(F.trim("name")) % 3
    plan = kids.select(F.lit(cat).alias("category_id"), F.when(size > 0, F.concat(F.lit("Group "), size.cast("string"))).otherwise("").alias("group"), c("name").alias("member"))
    return structure.subgrouped(n, e, plan)[1]


# ---- calls of a store ----


def _store(spark: SparkSession, d: str) -> Store:
    s = Store.open(spark, d, G.owner_of(spark, d), AS_OF)
    return Store(s.nodes, s.edges.withColumn("relation", relation(c("relation"))).select(*G.EDGE_COLS).distinct(), s.log, s.files, s.file_nodes, s.owner, s.as_of, _read_short(spark, d), decision_rows(spark, d))


@R.query(f"SELECT CAST(f.rank AS BIGINT) AS rank, f.id, n.name, n.type, left(coalesce(n.content, ''), 140) AS content FROM ({G.R.sql['f1_keyword_search']}) f JOIN nodes n USING (id) WHERE f.rank <= 12")
def h9_query(spark, d):
    return _store(spark, d).query(G._QUERY).withColumn("rank", c("rank").cast("long"))


@R.query(f"WITH {G.E_} SELECT count(*) AS nodes, count(*) FILTER (archived = 0) AS active, count(*) FILTER (archived = 1) AS archived, round(avg(weight), 3) AS mean_weight, (SELECT count(*) FROM e) AS edges, (SELECT max(ingested_at) FROM ingestion_log) AS last_ingested, (SELECT max(indexed_at) FROM vault_files) AS last_indexed FROM nodes")
def h9_status(spark, d):
    return _store(spark, d).status()


@R.query(f"WITH {G.E_} SELECT DISTINCT CASE WHEN source_id = {G.OWNER} THEN 'out' ELSE 'in' END AS side, relation, CASE WHEN source_id = {G.OWNER} THEN target_id ELSE source_id END AS other, n.name FROM e LEFT JOIN nodes n ON n.id = CASE WHEN source_id = {G.OWNER} THEN target_id ELSE source_id END WHERE source_id = {G.OWNER} OR target_id = {G.OWNER}")
def h9_node(spark, d):
    return _store(spark, d).node(G.owner_of(spark, d))


@R.query(f"SELECT id, cosine AS score FROM ({R.sql['f21_semantic_seeds'].replace('LIMIT 6', 'LIMIT 8')})")
def h10_search(spark, d):
    return _store(spark, d).search(G._QUERY, G._Q64, least=0.2)
