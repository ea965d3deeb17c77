"""SQL of composite queries: changes, traversal, file search, evidence, digests.  Importing it completes the registry of `graph_queries`."""

from __future__ import annotations

from ..functions import text as X
from ..sources.tables import AS_OF
from . import graph_queries as G
from .hierarchy_queries import UP_SQL
from .scalar_queries import TOKENS, _shelf, sql_list

SQL = G.R.sql
_ANY = UP_SQL.replace(" AND source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)", "")

SQL["d6_merged_edges"] = f"""WITH {G.E_}, x AS (SELECT id, type, {G._IN} AS k FROM nodes WHERE archived = 0 AND type <> 'category'), p AS (SELECT * FROM (SELECT min(id) OVER (PARTITION BY type, k) AS keep, id AS dr FROM x WHERE k <> '') WHERE keep <> dr),
    m AS (SELECT coalesce(a.keep, e.source_id) AS s, coalesce(b.keep, e.target_id) AS t, e.relation, e.weight, a.dr IS NOT NULL AS was FROM e LEFT JOIN p a ON a.dr = e.source_id LEFT JOIN p b ON b.dr = e.target_id),
    o AS (SELECT DISTINCT s FROM m WHERE s <> t AND relation = 'part_of' AND NOT was), k AS (SELECT m.*, relation = 'part_of' AND was AND s IN (SELECT s FROM o) AS second FROM m WHERE s <> t)
    SELECT s AS source_id, t AS target_id, CASE WHEN second THEN 'relates_to' ELSE relation END AS relation, max(weight) AS weight FROM k WHERE NOT (second AND t IN (SELECT id FROM nodes WHERE type = 'category')) GROUP BY 1, 2, 3"""

SQL["d7_imported_edges"] = f"""WITH {G.E_}, h AS (SELECT lower(name) AS k, min(id) AS have FROM nodes WHERE source IS NULL OR source <> 'import' GROUP BY 1),
    t AS (SELECT id, id AS tid FROM nodes WHERE source IS NULL OR source <> 'import' UNION ALL SELECT n.id, coalesce(h.have, n.id) FROM nodes n LEFT JOIN h ON h.k = lower(n.name) WHERE n.source = 'import')
    SELECT e.id, a.tid AS source_id, b.tid AS target_id, e.relation FROM e JOIN t a ON a.id = e.source_id JOIN t b ON b.id = e.target_id
    WHERE e.reinforcement_count % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.reinforcement_count % 2 = 0 AND o.source_id = a.tid AND o.target_id = b.tid AND o.relation = e.relation)"""

SQL["d8_move_refusals"] = f"""{_ANY}, {G.E_}, m AS (SELECT DISTINCT source_id AS id, target_id AS parent FROM e WHERE relation = 'requires')
    SELECT m.id, m.parent, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'missing' WHEN m.id = m.parent THEN 'self' WHEN EXISTS (SELECT 1 FROM ok WHERE ok.node = m.parent AND ok.anc = m.id) THEN 'cycle'
      WHEN a.type = 'category' AND b.type <> 'category' AND m.parent <> {G.OWNER} THEN 'category' END AS refusal FROM m LEFT JOIN nodes a ON a.id = m.id LEFT JOIN nodes b ON b.id = m.parent"""

SQL["d14_tasks"] = "SELECT DISTINCT id AS key, 'call ' || coalesce(source, 'nobody') AS text FROM ingestion_log WHERE raw_text IS NOT NULL"

_FP = f"WITH RECURSIVE {G.E_}, {G._FIRST}"
SQL["g6_cycles"] = f"{_FP}, r AS (SELECT child AS node, parent AS top FROM fp UNION SELECT r.node, fp.parent FROM r JOIN fp ON fp.child = r.top) SELECT node AS id, min(top) AS cycle FROM r WHERE node IN (SELECT node FROM r WHERE node = top) GROUP BY node"
SQL["g7_tree"] = f"""{_FP}, lim AS (SELECT count(*) + 1 AS n FROM fp), r AS (SELECT child AS node, parent AS anc, 1 AS d FROM fp UNION ALL SELECT r.node, fp.parent, d + 1 FROM r JOIN fp ON fp.child = r.anc WHERE d < (SELECT n FROM lim)),
    ok AS (SELECT * FROM r WHERE node NOT IN (SELECT node FROM r WHERE d = (SELECT n FROM lim))), s AS (SELECT * FROM ok UNION ALL SELECT DISTINCT node, node, 0 FROM ok),
    k AS (SELECT id, lpad(CAST(CAST(floor((1 - coalesce(importance, 0)) * 1e6) AS BIGINT) AS VARCHAR), 7, '0') || coalesce(name, '') || id AS k FROM nodes)
    SELECT s.node AS id, CAST(max(s.d) AS BIGINT) AS depth, string_agg(k.k, '/' ORDER BY s.d DESC) AS sort_path FROM s JOIN k ON k.id = s.anc GROUP BY s.node"""


# ---- search of files ----


def _hits(tokens: list[str], of: str) -> str:
    return "(" + " + ".join(f"(CASE WHEN len(list_filter({of}, lambda h: h = '{t}' OR (least(length(h), {len(t)}) >= 4 AND abs(length(h) - {len(t)}) <= 3 AND (starts_with(h, '{t}') OR starts_with('{t}', h))))) > 0 THEN 1 ELSE 0 END)" for t in tokens) + ")"


def file_scores(query: str, tokens: list[str], who: bool = False, seeds: str | None = None) -> str:
    """CTEs that end in fs (path, kind, title, score, prio, stamp, why): scores of files and what they are made of."""
    n = len(tokens)
    head = f"{G._HEAD} || CASE WHEN kind = 'person' THEN ' ' || lower(coalesce(summary, '')) ELSE '' END" if who else G._HEAD
    seeded = f"path IN (SELECT v.path FROM vault_file_nodes v JOIN ({seeds}) sd ON sd.id = v.node_id)" if seeds else "false"
    return f"""f0 AS (SELECT path, kind, title, updated, {head} AS h, coalesce(tokens, []) AS tk, {G._KIND} AS prio, {seeded} AS seed FROM vault_files),
    f1 AS (SELECT *, list_filter(regexp_extract_all(h, '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({sql_list(X.STOP)}, t)) AS ht FROM f0),
    f2 AS (SELECT *, {_hits(tokens, 'ht')} AS t, {_hits(tokens, 'tk')} AS b, contains(h, '{query}') AS ph FROM f1),
    f3 AS (SELECT *, kind = 'person' AND {'true' if who else 'false'} AND (t > 0 OR b > 0) AS w, kind IN ('readme', 'hub') AS ix FROM f2),
    f4 AS (SELECT *, 3 * t + b + CASE WHEN w THEN 3 ELSE 0 END + CASE WHEN ph THEN {2 * n} ELSE 0 END + CASE WHEN seed THEN 3 ELSE 0 END AS s FROM f3),
    fs AS (SELECT path, kind, title, prio, coalesce(try_cast(left(replace(coalesce(updated, ''), '-', ''), 8) AS INT), 0) AS stamp, round(CASE WHEN ix THEN s * 0.6 ELSE CAST(s AS DOUBLE) END, 3) AS score,
      array_to_string(list_filter([CASE WHEN t = {n} THEN 'title match' WHEN t > 0 THEN 'title match ' || t || '/{n}' WHEN b > 0 THEN 'body match ' || b || '/{n}' END, CASE WHEN w THEN 'who-question: person file' END, CASE WHEN ph THEN 'exact phrase' END, CASE WHEN seed THEN 'seed node' END, CASE WHEN ix THEN 'index page' END], lambda x: x IS NOT NULL), '; ') AS why
      FROM f4 WHERE s > 0)"""


_ORDER = "score DESC, prio, stamp DESC, path"
_PLAIN = file_scores(G._QUERY, G._T)
_SEEDS = f"SELECT id, rank FROM ({SQL['f1_keyword_search']}) WHERE rank <= 6"
SQL["f3_file_search"] = f"WITH {_PLAIN} SELECT path, score, why FROM fs ORDER BY {_ORDER} LIMIT 6"
SQL["h2_file_scores"] = f"WITH {file_scores(G._QUERY, G._T, seeds=_SEEDS)} SELECT path, score, why FROM fs"
SQL["f15_who_search"] = f"""WITH {file_scores('who asked about the harbour', ['asked', 'harbour'], who=True)}, hd AS (SELECT * FROM fs ORDER BY {_ORDER} LIMIT 6), pe AS (SELECT * FROM fs WHERE kind = 'person' AND path NOT IN (SELECT path FROM hd) ORDER BY {_ORDER} LIMIT 3),
    ev AS (SELECT * FROM hd UNION ALL SELECT * FROM pe), k AS (SELECT *, row_number() OVER (PARTITION BY kind = 'person' ORDER BY {_ORDER}) AS r FROM ev)
    SELECT path, kind, score FROM k WHERE kind = 'person' OR r <= greatest(0, 6 - (SELECT count(*) FROM ev WHERE kind = 'person')) ORDER BY {_ORDER} LIMIT 6"""
SQL["g11_link_hop"] = f"""WITH {_PLAIN}, top AS (SELECT path FROM fs ORDER BY {_ORDER} LIMIT 3), ln AS (SELECT DISTINCT a.path, b.path AS target FROM vault_file_nodes a JOIN vault_file_nodes b USING (node_id) WHERE a.path <> b.path),
    gn AS (SELECT target AS path, count(*) AS n FROM ln WHERE path IN (SELECT path FROM top) GROUP BY 1)
    SELECT v.path, round(coalesce(fs.score, 0) + coalesce(gn.n, 0), 3) AS score FROM vault_files v LEFT JOIN fs USING (path) LEFT JOIN gn USING (path) WHERE fs.path IS NOT NULL OR gn.path IS NOT NULL"""

# ---- nodes ----

_COS = f"CASE WHEN len(embedding) = 64 THEN coalesce(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({G._Q64} AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt({sum(x * x for x in G._Q64)}), 0), 0) ELSE 0.0 END"
SQL["f9_hints"] = f"""WITH a AS (SELECT id, 1 AS src, CAST(rank AS DOUBLE) AS o FROM ({SQL['f1_keyword_search'].replace('LIMIT 20', 'LIMIT 40')})), b AS (SELECT id, 2 AS src, -round({_COS}, 6) AS o FROM nodes WHERE archived = 0 AND embedding IS NOT NULL ORDER BY o, id LIMIT 40),
    c AS (SELECT id, 3 AS src, -importance AS o FROM nodes WHERE archived = 0 ORDER BY importance DESC NULLS LAST, weight DESC NULLS LAST, id LIMIT 80), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
    k AS (SELECT id, src, o FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, o) AS r FROM u) WHERE r = 1) SELECT id, CAST(row_number() OVER (ORDER BY src, o, id) AS INT) AS rank FROM k ORDER BY src, o, id LIMIT 80"""
SQL["h3_query_touch"] = f"""WITH {G.E_}, u AS (SELECT DISTINCT source_id AS id, target_id AS parent FROM e WHERE relation = 'part_of'), l0 AS (SELECT id FROM ({SQL['h1_keyword_scores']})),
    l1 AS (SELECT DISTINCT parent AS id FROM u JOIN l0 USING (id)), l2 AS (SELECT DISTINCT parent AS id FROM u JOIN l1 USING (id)), l3 AS (SELECT DISTINCT parent AS id FROM u JOIN l2 USING (id)),
    m AS (SELECT id, min(d) AS d FROM (SELECT id, 0 AS d FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) GROUP BY id)
    SELECT n.id, round(CASE WHEN m.d = 0 THEN 1.0 ELSE greatest(n.weight, pow(0.6, m.d)) END, 6) AS weight, CAST(n.access_count + CASE WHEN m.d = 0 THEN 1 ELSE 0 END AS BIGINT) AS access_count, {AS_OF} AS last_accessed FROM nodes n JOIN m USING (id) WHERE n.last_accessed IS DISTINCT FROM {AS_OF}"""
SQL["h6_evidence"] = f"""WITH {G.E_}, {G.ENDS}, {_PLAIN}, s AS ({_SEEDS}), nb AS (SELECT x.id, x.weight, x.type, x.name FROM nodes x WHERE archived = 0 AND x.id IN (SELECT other FROM n JOIN s ON s.id = n.id) AND x.id NOT IN (SELECT id FROM s) ORDER BY weight DESC, id LIMIT 12),
    bf AS (SELECT * FROM fs ORDER BY {_ORDER} LIMIT 6)
    SELECT CAST(s.rank AS BIGINT) AS rank, 'node' AS kind, s.id AS ref, '[' || x.type || '] ' || x.name || ': ' || left(coalesce(x.content, ''), 140) AS text FROM s JOIN nodes x ON x.id = s.id UNION ALL SELECT 1000 + row_number() OVER (ORDER BY weight DESC, id), 'neighbour', id, '[' || type || '] ' || name FROM nb
    UNION ALL SELECT 2000 + row_number() OVER (ORDER BY score DESC, path), 'file', path, coalesce(title, '') FROM bf"""
SQL["h8_digest"] = f"""SELECT 'top' AS section, id AS ref, score AS value FROM ({SQL['f7_top_of_mind']}) UNION ALL SELECT 'fading', id, days_left FROM ({SQL['f8_at_risk']}) UNION ALL SELECT 'area', id, CAST(descendants AS DOUBLE) FROM ({SQL['e5_area_sizes']})"""
SQL["a8_file_tokens"] = rf"""WITH t AS (SELECT path, text, CASE WHEN regexp_matches(text, '(?m)^# ') THEN trim(regexp_extract(text, '(?m)^# ([^\r\n]*)', 1)) ELSE replace(regexp_replace(list_last(string_split(path, '/')), '\.[^.]*$', ''), '-', ' ') END AS title FROM documents WHERE text IS NOT NULL AND path IS NOT NULL)
    SELECT DISTINCT path, CASE WHEN NOT contains(path, '/') THEN CASE WHEN path = 'IDENTITY.md' THEN 'identity' ELSE 'note' END WHEN path LIKE '%/README.md' THEN 'readme' ELSE {_shelf} END AS kind, title, CAST(least(3000, len({TOKENS.format("(title || ' ' || text)")})) AS INT) AS n_tokens,
      array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '((?:profile|courses|applications|orgs|projects|people|apps|topics|docs|areas|log)/[\w.\-]+\.md)', 1)), lambda x: x <> path)), ' ') AS links, left(sha256(text), 16) AS sha FROM t"""
