"""Queries of ledgers and of the batch forms of streaming operators.

The tables hold no ledger, so one is written from nodes: tasks and projects become loops, insights become decisions, events
become inbox lines.  Lines are written first and read back by the strict readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ledger as L
from ..sources import ledgers
from ..sources.tables import AS_OF, table
from ..sources.transcript import user_pieces
from ..streaming import capture
from ..workspace import Workspace
from .registry import Registry

R = Registry()
c = F.col
TODAY = "2026-06-01"


def _day(name: str, plus: int = 0):
    return F.date_add(F.to_date(F.timestamp_micros((c(name) * 1000000).cast("long"))), plus)


def _sql_day(name: str, plus: int = 0) -> str:
    return f"CAST(make_timestamp(CAST({name} * 1000000 AS BIGINT)) AS DATE) + {plus}"


def _flat(x):
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def loop_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("type in ('task', 'project') and trim(name) <> ''")
    k = F.abs("access_count")
    return n.select(
        F.concat(F.lit("L-"), F.regexp_replace("id", "[^0-9]", "")).alias("id"), _flat(c("name")).alias("title"), _day("last_accessed", 30).alias("due"),
        F.when(k % 3 == 0, "owner").when(k % 3 == 1, "agent").otherwise(F.concat(F.lit("waiting:"), F.coalesce("source", F.lit("nobody")))).alias("owner"),
        F.element_at(F.array(*[F.lit(a) for a in ledgers.AREAS]), (k % 6 + 1).cast("int")).alias("area"), (k % 3 + 1).cast("int").alias("prio"), _day("created_at").alias("since"), _day("last_accessed").alias("touched"),
        F.when(c("archived") == 1, F.lit(TODAY).cast("date")).alias("done"), F.lit("").alias("note"), F.concat(F.lit("go on with "), _flat(c("name"))).alias("next"),
    )


_LOOPS = f"""l AS (SELECT 'L-' || regexp_replace(id, '[^0-9]', '', 'g') AS id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS title, {_sql_day('last_accessed', 30)} AS due,
    CASE abs(access_count) % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'agent' ELSE 'waiting:' || coalesce(source, 'nobody') END AS owner, list_extract(['work', 'study', 'training', 'business', 'life', 'other'], CAST(abs(access_count) % 6 + 1 AS INT)) AS area,
    abs(access_count) % 3 + 1 AS prio, {_sql_day('created_at')} AS since, {_sql_day('last_accessed')} AS touched, CASE WHEN archived = 1 THEN DATE '{TODAY}' END AS done, 'go on with ' || trim(regexp_replace(name, '\\s+', ' ', 'g')) AS next
    FROM nodes WHERE type IN ('task', 'project') AND trim(name) <> '')"""
_LINE = "'- [' || CASE WHEN done IS NULL THEN ' ' ELSE 'x' END || '] ' || id || ' · ' || title || ' · due ' || CAST(due AS VARCHAR) || ' · owner ' || owner || ' · area ' || area || ' · prio ' || CAST(prio AS VARCHAR) || ' · since ' || CAST(since AS VARCHAR) || ' · touched ' || CAST(touched AS VARCHAR) || CASE WHEN done IS NULL THEN '' ELSE ' · done ' || CAST(done AS VARCHAR) END || ' · next: ' || next"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return loop_rows(spark, d).select(F.xxhash64("id").alias("line_no"), ledgers.loop_line().alias("line"))


def _read(spark: SparkSession, d: str) -> DataFrame:
    """The loops as read; stored, as views read them several times."""
    return Workspace(spark, "ledger").save(ledgers.loops(_lines(spark, d)))


@R.query(f"WITH {_LOOPS} SELECT id, title, CAST(due AS VARCHAR) AS due, owner, area, CAST(prio AS BIGINT) AS prio, CAST(since AS VARCHAR) AS since, CAST(touched AS VARCHAR) AS touched, CAST(done AS VARCHAR) AS done, next, done IS NOT NULL AS closed, nullif(regexp_extract(owner, '^waiting:(.*)$', 1), '') AS waiting_on, CAST(NULL AS VARCHAR) AS error FROM l")
def a11_loops_read(spark, d):
    r = _read(spark, d)
    return r.select("id", "title", *[c(x).cast("string").alias(x) for x in ("due",)], "owner", "area", c("prio").cast("long").alias("prio"), *[c(x).cast("string").alias(x) for x in ("since", "touched", "done")], "next", "closed", "waiting_on", "error")


@R.query(f"WITH {_LOOPS}, o AS (SELECT 'open' AS section, row_number() OVER (ORDER BY prio, due, id) AS pos, {_LINE} AS line FROM l WHERE done IS NULL), k AS (SELECT 'closed' AS section, row_number() OVER (ORDER BY done DESC, id DESC) AS pos, {_LINE} AS line FROM l WHERE done IS NOT NULL) SELECT section, CAST(pos AS BIGINT) AS pos, line FROM o UNION ALL SELECT section, CAST(pos AS BIGINT), line FROM k WHERE pos <= 40")
def a12_loops_written(spark, d):
    return ledgers.written(loop_rows(spark, d)).select("section", c("pos").cast("long").alias("pos"), "line")


def decision_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("type = 'insight' and trim(name) <> '' and trim(content) <> ''")
    w = W.orderBy("created_at", "id")  # a ledger is one file
    return n.select(F.row_number().over(w).alias("k"), _day("created_at").alias("date"), _flat(c("name")).alias("title"), _flat(c("content")).alias("decision"), F.coalesce("source", F.lit("")).alias("source")).select(F.format_string("D-%03d", "k").alias("id"), "k", "date", "title", "decision", F.lit("").alias("why"), F.lit("").alias("rejected"), F.lit("").alias("revisit"), "source")


_DEC = f"dd AS (SELECT row_number() OVER (ORDER BY created_at, id) AS k, {_sql_day('created_at')} AS date, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS title, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS decision, nullif(coalesce(source, ''), '') AS source FROM nodes WHERE type = 'insight' AND trim(name) <> '' AND trim(content) <> '')"


def _decision_lines(spark: SparkSession, d: str) -> DataFrame:
    blocks = decision_rows(spark, d).select("k", ledgers.decision_text().alias("t"))
    return blocks.select((c("k") * 100).alias("k"), F.posexplode(F.split("t", "\n")).alias("p", "line")).select((c("k") + c("p")).alias("line_no"), "line")


@R.query(f"WITH {_DEC} SELECT 'D-' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0') AS id, CAST(date AS VARCHAR) AS date, title, decision, source FROM dd")
def a13_decisions_read(spark, d):
    return ledgers.decisions(_decision_lines(spark, d)).where("error is null").select("id", c("date").cast("string").alias("date"), "title", "decision", "source")


@R.query(f"WITH {_DEC}, m AS (SELECT count(*) AS n FROM dd) SELECT 'D-' || lpad(CAST(n + r AS VARCHAR), CAST(greatest(3, length(CAST(n + r AS VARCHAR))) AS INT), '0') AS id, name FROM (SELECT name, row_number() OVER (ORDER BY id) AS r FROM nodes WHERE type = 'skill'), m")
def a14_next_ids(spark, d):
    new = table(spark, d, "nodes").where("type = 'skill'").select(c("id").alias("pos"), "name")
    return ledgers.next_ids(decision_rows(spark, d).select("id"), new, "D").select("id", "name")


_IBX = f"i AS (SELECT CAST({_sql_day('created_at')} AS VARCHAR) AS date, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS text, coalesce(source, 'none') AS source FROM nodes WHERE type = 'event' AND trim(name) <> '')"


@R.query(f"WITH {_IBX} SELECT date, text, source FROM i")
def a15_inbox(spark, d):
    n = table(spark, d, "nodes").where("type = 'event' and trim(name) <> ''").select(F.date_format(_day("created_at"), "yyyy-MM-dd").alias("date"), _flat(c("name")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"))
    return ledgers.inbox(n.select(F.lit(0).alias("line_no"), F.concat(F.lit("- "), "date", F.lit(" · "), "text", F.lit(" · "), "source").alias("line"))).select(c("date").cast("string").alias("date"), "text", "source")


@R.query("SELECT id AS k, source AS s FROM nodes")
def a16_seen_set(spark, d):
    """JSON lines of a seen set, bad lines between them."""
    n = table(spark, d, "nodes").select(F.to_json(F.struct(c("id").alias("k"), c("source").alias("s"))).alias("line"))
    bad = n.limit(1).select(F.lit("{broken").alias("line"))
    return ledgers.json_lines(n.unionByName(bad), "k string, s string")


_KEY = r"left(sha256(regexp_replace(lower(replace(trim(regexp_replace({}, '\s+', ' ', 'g')), '·', '-')), '[.!?,;: ]+$', '')), 16)"


@R.query(f"SELECT DISTINCT {_KEY.format('name')} AS hash FROM nodes WHERE type = 'task' AND name IS NOT NULL AND {_KEY.format('name')} NOT IN (SELECT {_KEY.format('title')} FROM vault_files) AND {_KEY.format('name')} NOT IN (SELECT {_KEY.format('name')} FROM nodes WHERE type = 'event')")
def d22_inbox_additions(spark, d):
    n = table(spark, d, "nodes")
    new = n.where("type = 'task' and name is not null").select(c("name").alias("text"))
    cur = table(spark, d, "vault_files").select(c("title").alias("text"))
    seen = n.where("type = 'event'").select(X.inbox_key(c("name")).alias("hash"))
    return ledgers.inbox_additions(new, cur, seen).select("hash")


_AGE = f"DATE '{TODAY}' - touched"


@R.query(f"""WITH {_LOOPS}, o AS (SELECT *, nullif(regexp_extract(owner, '^waiting:(.*)$', 1), '') AS w, CAST({_AGE} AS BIGINT) AS age FROM l WHERE done IS NULL)
    SELECT 'warning' AS level, id, 'overdue by ' || CAST(DATE '{TODAY}' - due AS VARCHAR) || 'd' AS message FROM o WHERE due < DATE '{TODAY}' UNION ALL SELECT 'warning', id, 'untouched for ' || CAST(age AS VARCHAR) || 'd' FROM o WHERE age > 7 AND due - DATE '{TODAY}' <= 21
    UNION ALL SELECT 'warning', id, 'waiting on ' || w || ' for ' || CAST(age AS VARCHAR) || 'd' FROM o WHERE w IS NOT NULL AND age > 5 UNION ALL SELECT 'error', id, 'duplicate id ' || id FROM l GROUP BY id HAVING count(*) > 1""")
def i3_loop_lint(spark, d):
    return L.lint_loops(_read(spark, d), TODAY)


@R.query(f"""WITH {_DEC}, x AS (SELECT k, CASE WHEN k % 10 = 0 THEN date - 400 ELSE date END AS date FROM dd WHERE k % 7 <> 0), y AS (SELECT *, row_number() OVER (ORDER BY k) AS n, lag(date) OVER (ORDER BY k) AS b FROM x), z AS (SELECT 'D-' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0') AS id, * FROM y)
    SELECT id, 'expected number ' || n AS message FROM z WHERE k <> n UNION ALL SELECT id, 'date goes back' FROM z WHERE date < b""")
def i4_decision_lint(spark, d):
    """A ledger that lacks every seventh decision and has every tenth too early."""
    r = decision_rows(spark, d).where("k % 7 <> 0").withColumn("date", F.when(c("k") % 10 == 0, F.date_sub("date", 400)).otherwise(c("date")))
    lines = r.select((c("k") * 100).alias("k"), F.posexplode(F.split(ledgers.decision_text(), "\n")).alias("p", "line")).select((c("k") + c("p")).alias("line_no"), "line")
    return L.lint_decisions(ledgers.decisions(lines))


@R.query(f"WITH {_LOOPS} SELECT id FROM l WHERE prio = 1")
def e10_duplicate_loops(spark, d):
    """A ledger in which loops of the first priority stand twice."""
    once = loop_rows(spark, d)
    twice = once.unionByName(once.where("prio = 1")).select(F.lit(0).alias("line_no"), ledgers.loop_line().alias("line"))
    return L.duplicates(ledgers.loops(twice)).select("id")


@R.query(f"WITH {_LOOPS} SELECT area, count(*) AS n, string_agg(id, ', ' ORDER BY id) AS ids FROM l WHERE done IS NULL GROUP BY area")
def e11_loops_by_area(spark, d):
    return L.by_area(_read(spark, d))


_REL = f"CASE WHEN due < DATE '{TODAY}' THEN 'OVERDUE ' || CAST(DATE '{TODAY}' - due AS VARCHAR) || 'd' WHEN due = DATE '{TODAY}' THEN 'TODAY' ELSE CAST(due - DATE '{TODAY}' AS VARCHAR) || 'd' END"


@R.query(f"""WITH {_LOOPS}, o AS (SELECT *, nullif(regexp_extract(owner, '^waiting:(.*)$', 1), '') AS w, CAST({_AGE} AS BIGINT) AS age FROM l WHERE done IS NULL), u AS (SELECT * FROM o WHERE due - DATE '{TODAY}' <= 7)
    SELECT 'DUE' AS section, row_number() OVER (ORDER BY due, prio, id) AS pos, strftime(due, '%b %-d') || ' ' || {_REL} || ' ' || id || ' P' || CAST(prio AS VARCHAR) || ' ' || title || CASE WHEN w IS NULL AND age >= 3 THEN ' [untouched ' || CAST(age AS VARCHAR) || 'd]' ELSE '' END || ' -> ' || next AS line FROM u
    UNION ALL SELECT 'STALLED', row_number() OVER (ORDER BY due, prio, id), id || ' ' || CAST(age AS VARCHAR) || 'd' FROM u WHERE w IS NULL AND age >= 3
    UNION ALL SELECT 'WAITING', row_number() OVER (ORDER BY due, prio, id), w || ' ' || CAST(age AS VARCHAR) || 'd ' || id || CASE WHEN age > 5 THEN ' nudge' ELSE '' END FROM o WHERE w IS NOT NULL
    UNION ALL SELECT 'AGENT', row_number() OVER (ORDER BY due, prio, id), id || ' ' || title || ' -> ' || next FROM o WHERE owner = 'agent'
    UNION ALL SELECT 'TOP', pos, line FROM (SELECT row_number() OVER (ORDER BY prio, due, id) AS pos, next || '  (' || id || ', due ' || strftime(due, '%b %-d') || ')' AS line FROM o WHERE w IS NULL) WHERE pos <= 3
    UNION ALL SELECT 'FOOTER', 1, CAST(count(*) AS VARCHAR) || ' open loops, ' || CAST(count(*) FILTER (due - DATE '{TODAY}' > 7) AS VARCHAR) || ' beyond the horizon' FROM o""")
def k3_action_card(spark, d):
    return L.card(_read(spark, d), TODAY).select("section", c("pos").cast("long").alias("pos"), "line")


_CLIP = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(left({x}, CAST({n} - 1 AS INT))) || '…' END"
_STEP = "CASE WHEN step <> '' AND room > 12 THEN ': ' || " + _CLIP("step", "room - 2") + " ELSE '' END"


@R.query(f"""WITH RECURSIVE {_LOOPS}, o AS (SELECT *, nullif(regexp_extract(owner, '^waiting:(.*)$', 1), '') AS w, CAST({_AGE} AS BIGINT) AS age, due - DATE '{TODAY}' AS n FROM l WHERE done IS NULL),
    q AS (SELECT row_number() OVER (ORDER BY due, prio, id) AS r, title || ' (' || CASE WHEN n = 0 THEN 'today' WHEN n < 0 THEN 'overdue ' || -n || 'd' ELSE n || 'd' END || CASE WHEN age >= 3 THEN ', untouched ' || age || 'd' ELSE '' END || ')' AS item, trim(next) AS step FROM o WHERE w IS NULL),
    f AS (SELECT CAST(0 AS BIGINT) AS r, '' AS line UNION ALL
      SELECT q.r, CASE WHEN f.line = '' THEN {_CLIP("one", 200)} ELSE f.line || ' · ' || one END FROM f JOIN (SELECT *, 0 AS z FROM q) q ON q.r = f.r + 1, LATERAL (SELECT 200 - length(f.line) - CASE WHEN f.line = '' THEN 0 ELSE 3 END - length(q.item) AS room) u, LATERAL (SELECT q.item || {_STEP} AS one) v
      WHERE f.line = '' OR length(f.line) + 3 + length(q.item) <= 200)
    SELECT coalesce(nullif(max_by(line, r), ''), 'No open loops.') AS line FROM f""")
def k4_brief(spark, d):
    return L.brief(_read(spark, d), TODAY)


@R.query(f"WITH {_LOOPS} SELECT id, strftime(due, '%b %-d') || ' · ' || id || ' · ' || title || ' · ' || next AS line FROM l WHERE done IS NULL")
def k1_block_lines(spark, d):
    o = _read(spark, d).where("done is null")
    return o.select("id", F.concat_ws(" · ", L.due_text(c("due")), "id", "title", "next").alias("line"))


@R.query(f"WITH {_DEC} SELECT 'D-' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0') AS id, title FROM dd WHERE date >= DATE '{TODAY}' - 30 AND date <= DATE '{TODAY}'")
def k7_recent_decisions(spark, d):
    t = F.lit(TODAY).cast("date")
    return decision_rows(spark, d).where((c("date") >= F.date_sub(t, 30)) & (c("date") <= t)).select("id", "title")


@R.query(f"WITH {_DEC} SELECT 'D-' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0') AS id, len(list_filter(['harbour', 'invoice', 'rough'], lambda t: list_contains(regexp_extract_all(lower(title || ' ' || decision), '[a-z0-9][a-z0-9.+-]{{2,}}'), t))) AS hits FROM dd WHERE len(list_filter(['harbour', 'invoice', 'rough'], lambda t: list_contains(regexp_extract_all(lower(title || ' ' || decision), '[a-z0-9][a-z0-9.+-]{{2,}}'), t))) > 0 ORDER BY 2 DESC, 1 LIMIT 5")
def f5_decision_search(spark, d):
    from ..operators.search import ledger_search

    r = decision_rows(spark, d).select("id", F.concat_ws(" ", "title", "decision").alias("text"))
    return ledger_search(r, "text", "what about the harbour invoice, which was rough").select("id", "hits")


@R.query(f"WITH {_LOOPS} SELECT id, CAST(len(list_filter(['harbour', 'invoice', 'send'], lambda t: list_contains(regexp_extract_all(lower(title || ' ' || next), '[a-z0-9][a-z0-9.+-]{{2,}}'), t))) AS BIGINT) AS hits FROM l WHERE len(list_filter(['harbour', 'invoice', 'send'], lambda t: list_contains(regexp_extract_all(lower(title || ' ' || next), '[a-z0-9][a-z0-9.+-]{{2,}}'), t))) > 0 ORDER BY 2 DESC, done IS NOT NULL, id LIMIT 5")
def f6_loop_search(spark, d):
    from ..operators.search import ledger_search

    r = _read(spark, d).select("id", F.concat_ws(" ", "title", "next").alias("text"), "closed")
    return ledger_search(r, "text", "harbour invoice send", closed="closed").select("id", c("hits").cast("long").alias("hits"))


@R.query("SELECT source AS slug, CAST(count(*) AS BIGINT) AS n FROM nodes WHERE type IN ('task', 'project') AND trim(name) <> '' AND archived = 0 AND abs(access_count) % 3 = 2 AND source IS NOT NULL GROUP BY source")
def c20_waiting_people(spark, d):
    r = _read(spark, d)
    people = table(spark, d, "nodes").where("source is not null").select(c("source").alias("slug"), c("source").alias("key")).distinct()
    return L.waiting_people(people, r).where("ids <> ''").select(c("key").alias("slug"), F.size(F.split("ids", ", ")).cast("long").alias("n"))


#: Everyday words as names of areas: the tables' own areas are named in no text.
_ALIASES = ["the harbour", "garden", "invoice", "new lamp", "letter"]


@R.query(rf"""WITH g AS (SELECT DISTINCT list_extract({_ALIASES}, CAST(length(title) % 5 + 1 AS INT)) AS al, path, CAST(make_timestamp(CAST(mtime * 1000000 AS BIGINT)) AS DATE) AS updated FROM vault_files WHERE kind = 'area'),
    t AS (SELECT DISTINCT lower(text) AS t, CAST(updated AS DATE) AS date FROM documents WHERE text IS NOT NULL AND CAST(updated AS DATE) < DATE '2026-06-01')
    SELECT DISTINCT g.path AS area, CAST(t.date AS VARCHAR) AS log_date FROM g JOIN t ON t.date > g.updated AND contains(t.t, g.al) AND regexp_matches(' ' || t.t || ' ', '[^\p{{L}}\p{{N}}]' || g.al || '[^\p{{L}}\p{{N}}]')""")
def c19_area_mentions(spark, d):
    """Areas named in texts written after the area's file."""
    alias = F.element_at(F.array(*[F.lit(x) for x in _ALIASES]), (F.length("title") % 5 + 1).cast("int"))
    a = table(spark, d, "vault_files").where("kind = 'area'").select(c("path").alias("area"), _day("mtime").alias("updated"), alias.alias("alias"))
    logs = table(spark, d, "documents").where("text is not null").select(F.to_date("updated").alias("date"), "text")
    return L.mentions(a, logs, TODAY).select("area", c("log_date").cast("string").alias("log_date"))


# ---- batch forms of streams ----


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ingestion_log").select("id", "raw_text", "source", "ingested_at").distinct()
    j = F.to_json(F.struct(F.lit("user").alias("type"), F.date_format(F.timestamp_micros((c("ingested_at") * 1000000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(F.lit("user").alias("role"), c("raw_text").alias("content")).alias("message")))
    return user_pieces(t.select("id", F.coalesce("source", F.lit("none")).alias("session"), "ingested_at", j.alias("line")), AS_OF, hours=24 * 60)


_PCS = rf"pc AS (SELECT id, session, ingested_at, left(t, 20000) AS text, floor(ingested_at) < {AS_OF} - 60 * 86400 AS stale FROM (SELECT DISTINCT id, coalesce(source, 'none') AS session, ingested_at, regexp_replace(coalesce(raw_text, ''), '^\s+|\s+$', '', 'g') AS t, raw_text FROM ingestion_log) WHERE t <> '')"


@R.query(f"WITH {_PCS} SELECT id, CAST(length(text) AS BIGINT) AS n, stale FROM pc")
def a17_user_pieces(spark, d):
    """Log rows as a transcript of JSON lines, read back as pieces."""
    return _pieces(spark, d).select("id", F.length("text").cast("long").alias("n"), "stale").distinct()


@R.query(f"WITH {_PCS}, t AS (SELECT session, sum(length(text)) AS total FROM pc GROUP BY 1), m AS (SELECT session, sum(length(text)) AS chars FROM pc WHERE stale GROUP BY 1) SELECT t.session, CAST(total AS BIGINT) AS total, CAST(coalesce(chars, 0) AS BIGINT) AS from_char, CAST(total - coalesce(chars, 0) AS BIGINT) AS new_chars FROM t LEFT JOIN m USING (session)")
def l1_offsets(spark, d):
    """Offsets of all sessions whose stale pieces were read before."""
    p = _pieces(spark, d).select("session", c("ingested_at").alias("seq"), "text", "stale")
    marks = p.where("stale").groupBy("session").agg(F.sum(F.length("text")).alias("chars"))
    return capture.offsets(p, marks).select("session", "total", "from_char", "new_chars")


@R.query(f"WITH {_PCS} SELECT session, count(*) FILTER (stale) AS stale, count(*) FILTER (NOT stale) AS fresh FROM pc GROUP BY session")
def l2_stale_pieces(spark, d):
    return _pieces(spark, d).groupBy("session").agg(F.count_if("stale").alias("stale"), F.count_if(~c("stale")).alias("fresh"))


@R.query(r"SELECT DISTINCT left(sha1(regexp_replace(trim(regexp_replace(lower(f), '\s+', ' ', 'g')), '[.!]+$', '')), 16) AS k FROM (SELECT unnest(regexp_split_to_array(regexp_replace(coalesce(content, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+')) AS f FROM nodes) WHERE trim(f) <> ''")
def l3_distinct_facts(spark, d):
    return capture.facts(table(spark, d, "nodes").select(c("content").alias("text"))).select("k")


@R.query(f"SELECT coalesce(source, 'none') AS session, max(ingested_at) < {AS_OF} - 45 * 86400 AS expired FROM ingestion_log GROUP BY 1")
def l4_idle_sessions(spark, d):
    t = table(spark, d, "ingestion_log").groupBy(F.coalesce("source", F.lit("none")).alias("session")).agg(F.max("ingested_at").alias("m"))
    return t.select("session", (c("m") < AS_OF - 45 * 86400).alias("expired"))


@R.query("SELECT doc_id, CAST(i AS INT) AS window_no, CAST(least(500, length(text) - i * 500) AS BIGINT) AS n FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)")
def l6_text_windows(spark, d):
    return capture.windows(table(spark, d, "documents").select("doc_id", "text"), "text", 500).select("doc_id", "window_no", F.length("piece").cast("long").alias("n"))


def _pushes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(c("user_id").cast("string").alias("recipient"), c("event_type").alias("text"), (F.unix_micros(c("ts").cast("timestamp")) / 1e6).alias("ts"))


@R.query("""WITH RECURSIVE x AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS recipient, event_type AS text, epoch_us(ts) / 1e6 AS ts FROM events), f AS (SELECT recipient, text, min(ts) AS ts FROM x GROUP BY 1, 2),
    r AS (SELECT * FROM f UNION ALL SELECT recipient, text, nxt AS ts FROM (SELECT r.recipient, r.text, min(x.ts) AS nxt FROM r JOIN x ON x.recipient = r.recipient AND x.text = r.text AND x.ts - r.ts >= 21600 GROUP BY r.recipient, r.text, r.ts)) SELECT recipient, text, round(ts, 3) AS ts FROM r""")
def l8_suppressed_pushes(spark, d):
    return capture.suppressed(_pushes(spark, d)).select("recipient", "text", F.round("ts", 3).alias("ts"))


@R.query("WITH q AS (SELECT CAST(user_id AS VARCHAR) AS recipient, event_type AS text, min(ts) AS ts FROM events WHERE hour(ts) >= 23 OR hour(ts) < 7 GROUP BY 1, 2) SELECT recipient, count(*) AS n, string_agg(text, chr(10) ORDER BY ts, text) AS message FROM q GROUP BY recipient")
def l9_quiet_hours(spark, d):
    return capture.held(_pushes(spark, d))


@R.query("SELECT CAST(user_id AS VARCHAR) AS recipient, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS texts FROM events GROUP BY user_id")
def e15_pushes_by_recipient(spark, d):
    return _pushes(spark, d).groupBy("recipient").agg(F.array_join(F.array_sort(F.collect_set("text")), ", ").alias("texts"))


@R.query("""WITH x AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), m AS (SELECT user_id, min(r) FILTER (NOT bad) AS first_ok, count(*) AS n FROM x GROUP BY 1) SELECT user_id, CAST(coalesce(first_ok - 1, n) AS BIGINT) AS run FROM m""")
def e14_trailing_errors(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return L.trailing_run(e, "user_id", "at", c("event_type") == "error").select("user_id", c("run").cast("long").alias("run"))


@R.query("SELECT user_id, count(*) AS n, max(ts) AS latest FROM events GROUP BY user_id")
def l11_access_batch(spark, d):
    """Touches of one micro-batch by key, which the decay transform takes."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
