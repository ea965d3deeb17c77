"""Queries of the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decay as D
from ..functions import text as X
from ..functions import vectors as V
from ..functions.vocab import FILE_KINDS, HALF_LIFE_DAYS, OTHER_KIND, TYPE_OF, base_half_life, lookup, node_type, relation, sql_relation
from ..operators import answers
from ..operators import integrity as I
from ..operators import ledger as L
from ..sources import ledgers, markdown
from ..sources.tables import AS_OF, table
from .registry import Registry

R = Registry()
c = F.col


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def sql_case(values: dict, key: str, other) -> str:
    f = lambda v: "CAST('Infinity' AS DOUBLE)" if v == float("inf") else q(v) if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {f(v)}" for k, v in values.items()) + f" ELSE {f(other)} END"


WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
TOKENS = f"list_filter(list_distinct({WORDS}), lambda t: length(t) > 1 AND NOT list_contains({sql_list(X.STOP)}, t))"
DAY = f"CAST(make_timestamp(CAST({AS_OF} * 1000000 AS BIGINT)) AS DATE)"
TYPE = "(" + sql_case({**TYPE_OF, **{k: k for k in HALF_LIFE_DAYS}}, "lower(trim(coalesce(type, 'concept')))", "concept") + ")"
LIFE = "(" + sql_case(HALF_LIFE_DAYS, TYPE, 60.0) + ")"
MONTH_NO = "(CASE " + " ".join(f"WHEN lower({{0}}) IN ('{m}', '{m[:3]}') THEN {i}" for i, m in enumerate(D.MONTHS, 1)) + " WHEN lower({0}) = 'sept' THEN 9 END)"
DATE_RX = r"\b([A-Za-z]{3,9})\.? (\d{1,2})(?:\s*[-–]\s*(\d{1,2}))?(?:st|nd|rd|th)?(?:,? ((?:19|20)\d\d))?\b"
_part = lambda g: f"regexp_extract(m, '{DATE_RX}', {g})"
_when = f"try_cast(concat(coalesce(nullif({_part(4)}, ''), CAST(year({DAY}) AS VARCHAR)), '-', {MONTH_NO.format(_part(1))}, '-', coalesce(nullif({_part(3)}, ''), {_part(2)})) AS DATE)"
UPCOMING = f"(len(list_filter(regexp_extract_all(coalesce(content, ''), '{DATE_RX}'), lambda m: {MONTH_NO.format(_part(1))} IS NOT NULL AND coalesce({_when} >= {DAY}, false))) > 0)"
INF = "CAST('Infinity' AS DOUBLE)"
HALF = f"(CASE WHEN half_life_days = {INF} AND type <> 'category' AND coalesce(importance, 0) < {D.IMMORTAL_FROM} THEN {D.DEMOTED_DAYS} WHEN type = 'event' AND {UPCOMING} THEN {INF} ELSE half_life_days END)"
SINCE = f"coalesce(greatest(last_decayed, last_accessed), {AS_OF})"
WEIGHT = f"(CASE WHEN {HALF} = {INF} THEN weight ELSE greatest(weight * pow(0.5, (({AS_OF} - {SINCE}) / 86400.0) / ({HALF} * (1 + {D.GAIN} * coalesce(importance, 0)))), {D.FLOOR} * coalesce(importance, 0)) END)"
LEFT = f"(CASE WHEN {HALF} = {INF} OR coalesce(importance, 0) * {D.FLOOR} >= {D.ARCHIVE_BELOW} THEN NULL WHEN weight <= {D.ARCHIVE_BELOW} THEN 0.0 ELSE {HALF} * (1 + {D.GAIN} * coalesce(importance, 0)) * log2(weight / {D.ARCHIVE_BELOW}) END)"
LIFE_NOW = lambda: D.half_life(c("half_life_days"), c("type"), c("importance"), c("content"), AS_OF)
finite = lambda e: F.when(e < D.INF, e)
joined = lambda a: F.array_join(F.array_sort(a), " ")
sql_joined = lambda s: f"array_to_string(list_sort({s}), ' ')"
strip = lambda s: rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"

R.scalar("b1_node_types", "nodes", "id", kind=(lambda: node_type(c("type")), TYPE), base_days=(lambda: finite(base_half_life(node_type(c("type")))), f"CASE WHEN {LIFE} < {INF} THEN {LIFE} END"))
R.scalar("b2_relations", "edges", "id", label=(lambda: relation(c("relation")), sql_relation("relation")))
R.scalar("b4_search_tokens", "nodes", "id", tokens=(lambda: joined(X.search_tokens(c("name"))), sql_joined(TOKENS.format("name"))), n_content=(lambda: F.size(X.search_tokens(c("content"))), f"len({TOKENS.format('content')})"))
R.scalar("b5_ledger_tokens", "documents", "doc_id", n=(lambda: F.size(X.ledger_tokens(c("text"))), f"len(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9.+-]{{2,}}')), lambda t: NOT list_contains({sql_list(X.LEDGER_STOP)}, t)))"))
_qt = TOKENS.format("summary")
_kept = f"list_filter({_qt}, lambda t: NOT list_contains({sql_list(X.QUESTION_STOP)}, t))"
R.scalar("b6_query_tokens", "vault_files", "path", tokens=(lambda: joined(X.query_tokens(F.coalesce(c("summary"), F.lit("")))), sql_joined(f"CASE WHEN len({_qt}) = 0 THEN CASE WHEN trim(coalesce(summary, '')) = '' THEN [] ELSE [lower(trim(summary))] END WHEN len({_kept}) > 0 THEN {_kept} ELSE {_qt} END")))
R.scalar("b7_index_names", "vault_files", "path", name=(lambda: X.norm_name(c("title")), f"array_to_string({WORDS.format('title')}, ' ')"))
R.scalar("b8_bare_names", "nodes", "id", name=(lambda: X.bare_name(c("name")), rf"array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce(name, ''), '\s*\([^()]*\)\s*$', ''), '(?:\s+(?:19|20)\d\d)+\s*$', '')), '[a-z0-9]+'), ' ')"))
_in = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(name, '')), '\b(?:owner''?s?|my|the)\b', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
R.scalar("b9_integrity_names", "nodes", "id", name=(lambda: X.integrity_name(c("name")), _in))
R.scalar("b10_compact_names", "nodes", "id", name=(lambda: X.compact_name(c("name")), f"replace({_in}, ' ', '')"))
R.scalar("b11_slugs", "nodes", "id", slug=(lambda: X.slug(c("name")), r"coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed')"))
_shelf = sql_case(X.SHELVES, "split_part(path, '/', 1)", "note")
R.scalar("b12_file_kinds", "vault_files", "path", kind_of_path=(lambda: X.file_kind(c("path")), f"CASE WHEN NOT contains(path, '/') THEN CASE WHEN path = 'IDENTITY.md' THEN 'identity' ELSE 'note' END WHEN path LIKE '%/README.md' THEN 'readme' ELSE {_shelf} END"), priority=(lambda: lookup(FILE_KINDS, c("kind"), OTHER_KIND), sql_case(FILE_KINDS, "kind", OTHER_KIND)))
R.scalar("b13_vague_names", "nodes", "id", vague=(lambda: X.is_vague(c("name")), f"(regexp_matches(trim(coalesce(name, '')), {q(X.VAGUE)}) OR regexp_matches(trim(coalesce(name, '')), {q(X.PERIOD)}))"))
R.scalar("b14_course_types", "nodes", "id", kind=(lambda: X.course_type(c("name"), c("type")), f"CASE WHEN type = 'event' AND regexp_matches(coalesce(trim(name), ''), {q(X.COURSE)}) THEN 'concept' ELSE type END"))
R.scalar("b15_secrets_masked", "documents", "doc_id", "text IS NOT NULL", assigned=(lambda: F.size(F.regexp_extract_all("text", F.lit(X.SECRET), F.lit(0))), f"len(regexp_extract_all(text, {q(X.SECRET)}))"), masked=(lambda: F.size(F.regexp_extract_all(X.redact_secrets(c("text")), F.lit(r"\[redacted\]"), F.lit(0))), rf"len(regexp_extract_all(text, {q(X.SECRET)})) + len(list_filter(regexp_extract_all(regexp_replace(text, {q(X.SECRET)}, '', 'g'), '\b[A-Za-z0-9_\-]{{32,}}\b'), lambda t: regexp_matches(t, '\d')))"))
R.scalar("b18_cosine", "nodes", "id", "embedding IS NOT NULL", to_first=(lambda: F.round(V.cosine(c("embedding"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.when(i == 1, 1.0).otherwise(0.0))), 6), "CASE WHEN len(embedding) = 64 THEN round(coalesce(CAST(embedding[1] AS DOUBLE) / nullif(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 0), 0), 6) ELSE 0.0 END"))
R.scalar("b19_upcoming", "nodes", "id", upcoming=(lambda: D.upcoming(c("content"), AS_OF), UPCOMING))
R.scalar("b20_half_lives", "nodes", "id", days=(lambda: finite(LIFE_NOW()), f"CASE WHEN {HALF} < {INF} THEN {HALF} END"))
R.scalar("b21_weights_now", "nodes", "id", weight_now=(lambda: F.round(D.weight_at(c("weight"), F.coalesce(F.greatest("last_decayed", "last_accessed"), F.lit(AS_OF)), LIFE_NOW(), c("importance"), AS_OF), 6), f"round({WEIGHT}, 6)"))
R.scalar("b22_days_left", "nodes", "id", days_left=(lambda: F.round(finite(D.days_left(c("weight"), LIFE_NOW(), c("importance"))), 6), f"round({LEFT}, 6)"))
R.scalar("b23_edge_half_lives", "edges", "id", days=(lambda: F.round(D.edge_half_life(c("reinforcement_count")), 6), "round(90.0 * ln(1 + reinforcement_count), 6)"))
_passed_rx = r"(?i)\b(?:will|is going to|is scheduled to|is expected to)\b[^.;]{0,80}?\bon ([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?(?:,? (\d{4}))?"
_pp = lambda g: f"regexp_extract(coalesce(content, ''), '{_passed_rx}', {g})"
R.scalar("b26_passed_dates", "nodes", "id", phrase=(lambda: D.passed_date(c("content"), AS_OF), f"CASE WHEN try_cast(concat(coalesce(nullif({_pp(3)}, ''), CAST(year({DAY}) AS VARCHAR)), '-', {MONTH_NO.format(_pp(1))}, '-', {_pp(2)}) AS DATE) < {DAY} AND {MONTH_NO.format(_pp(1))} IS NOT NULL THEN trim({_pp(0)}) || ' (passed)' END"))
R.scalar("b27_plan_phrases", "nodes", "id", plan=(lambda: F.regexp_extract(F.coalesce("content", F.lit("")), X.PLAN, 0), f"regexp_extract(coalesce(content, ''), {q(X.PLAN)}, 0)"), dated=(lambda: F.coalesce(c("content").rlike(X.DATED), F.lit(False)), f"coalesce(regexp_matches(content, {q(X.DATED)}), false)"), loops=(lambda: F.array_join(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(X.LOOP_REF), F.lit(0)), " "), f"array_to_string(regexp_extract_all(coalesce(content, ''), {q(X.LOOP_REF)}), ' ')"))


def _sql_cut(x: str, limit: int) -> str:
    head, arms = f"left({x}, {limit - 2})", ""
    for sep in ("\n", ". ", "; ", ", ", " "):
        s = "chr(10)" if sep == "\n" else q(sep)
        at = f"(length({head}) - instr(reverse({head}), reverse({s})) - {len(sep)} + 1)"
        arms += f" WHEN contains({head}, {s}) AND {at} >= {int(limit * 0.6)} THEN left({head}, CAST({at} + {1 if sep == '. ' else 0} AS INT))"
    return rf"CASE WHEN length({x}) <= {limit} THEN {x} ELSE regexp_replace(CASE {arms} ELSE {head} END, '\s+$', '') || ' …' END"


R.scalar("b28_cuts", "nodes", "id", "content IS NOT NULL", piece=(lambda: X.cut(c("content"), 140), _sql_cut("content", 140)))
_pos = "coalesce(nullif(instr(lower(content), 'the'), 0), 1) - 1"
_s0 = f"greatest(0, {_pos} - 33)"
_end = f"least(length(content), {_s0} + 96)"
_st = f"greatest(0, {_end} - 96)"
R.scalar("b29_windows", "nodes", "id", "content IS NOT NULL AND content <> ''", piece=(lambda: X.window(c("content"), F.array(F.lit("the")), 100), f"concat(CASE WHEN {_st} > 0 THEN '…' ELSE '' END, trim(substring(content, CAST({_st} + 1 AS INT), CAST({_end} - {_st} AS INT))), CASE WHEN {_end} < length(content) THEN '…' ELSE '' END)"))
_due = "CAST(make_timestamp(CAST(created_at * 1000000 AS BIGINT)) AS DATE)"
_tod = lambda: F.to_date(F.timestamp_seconds(F.lit(AS_OF)))
_dcol = lambda n: F.to_date(F.timestamp_micros((c(n) * 1000000).cast("long")))
R.scalar("b32_due_texts", "nodes", "id", due=(lambda: L.due_text(_dcol("created_at")), f"strftime({_due}, '%b %-d')"), away=(lambda: L.relative(_dcol("created_at"), _tod()), f"CASE WHEN {_due} < {DAY} THEN 'OVERDUE ' || CAST({DAY} - {_due} AS VARCHAR) || 'd' WHEN {_due} = {DAY} THEN 'TODAY' ELSE CAST({_due} - {DAY} AS VARCHAR) || 'd' END"))
_key = r"sha256(regexp_replace(lower(replace(trim(regexp_replace(name, '\s+', ' ', 'g')), '·', '-')), '[.!?,;: ]+$', ''))"
R.scalar("b34_inbox_keys", "nodes", "id", "name IS NOT NULL", key=(lambda: X.inbox_key(c("name")), f"left({_key}, 16)"))
R.scalar("b35_fact_keys", "nodes", "id", "content IS NOT NULL", key=(lambda: X.fact_key(c("content")), r"left(sha1(regexp_replace(trim(regexp_replace(lower(content), '\s+', ' ', 'g')), '[.!]+$', '')), 16)"))
R.scalar("b36_sentences", "nodes", "id", n=(lambda: F.size(X.sentences(c("content"))), rf"len(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(content, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: {strip('s')}), lambda s: s <> ''))"))
R.scalar("b37_automation", "documents", "doc_id", automated=(lambda: X.is_automation(c("text")), "coalesce(" + " OR ".join(f"contains(text, {q(m) if chr(10) not in m else q(m.split(chr(10))[0]) + ' || chr(10) || ' + q(m.split(chr(10))[1])})" for m in X.AUTOMATION) + ", false)"))
R.scalar("b38_times", "vault_files", "path", epoch=(lambda: F.unix_micros(F.try_to_timestamp(F.concat(F.nullif("updated", F.lit("")), F.lit("T00:00:00Z")))) / 1e6, "epoch(try_cast(nullif(updated, '') AS DATE)::TIMESTAMP)"))
R.scalar("b39_json_fields", "events", "event_id", k=(lambda: X.tolerant_json(F.concat(F.lit("```json\n"), "props", F.lit("\n``` done")), "k int")["k"], "CAST(json_extract(props, '$.k') AS INT)"))
R.scalar("b42_source_lines", "nodes", "id", line=(lambda: F.concat_ws(" · ", F.coalesce("source", F.lit("unknown")), c("type"), c("name")), "concat_ws(' · ', coalesce(source, 'unknown'), type, name)"))
R.scalar("b43_sizes", "nodes", "id", size=(lambda: F.round(8 + 22 * F.coalesce("weight", F.lit(0.0)), 3), "round(8 + 22 * coalesce(weight, 0), 3)"), faded=(lambda: c("archived") == 1, "archived = 1"))
R.scalar("b44_quiet_hours", "ingestion_log", "id", quiet=(lambda: (F.hour(F.timestamp_seconds(F.floor("ingested_at"))) >= 23) | (F.hour(F.timestamp_seconds(F.floor("ingested_at"))) < 7), "hour(make_timestamp(CAST(ingested_at * 1000000 AS BIGINT))) >= 23 OR hour(make_timestamp(CAST(ingested_at * 1000000 AS BIGINT))) < 7"))
R.scalar("b45_paths", "documents", "doc_id", paths=(lambda: F.array_join(X.paths_in(c("text")), " "), r"array_to_string(regexp_extract_all(coalesce(text, ''), '(?:/[\w.-]+){2,}'), ' ')"))
R.scalar("b47_display_lines", "nodes", "id", line=(answers.display_line, "concat('[', type, '] ', coalesce(name, ''), ' (weight ', CAST(round(CAST(CAST(weight AS VARCHAR) AS DECIMAL(18, 10)), 2) AS DECIMAL(18, 2)), ')', CASE WHEN coalesce(content, '') <> '' THEN ': ' || content ELSE '' END, CASE WHEN coalesce(path, '') <> '' THEN ' -> ' || path ELSE '' END)"))
R.scalar("b48_strict_dates", "vault_files", "path", day=(lambda: ledgers.strict_date(c("updated")).cast("string"), r"CASE WHEN regexp_matches(trim(updated), '^\d{4}-\d{1,2}-\d{1,2}$') THEN CAST(try_cast(trim(updated) AS DATE) AS VARCHAR) END"), error=(lambda: F.when((c("updated") != "") & ledgers.strict_date(c("updated")).isNull(), "updated: bad date"), r"CASE WHEN updated <> '' AND (NOT regexp_matches(trim(updated), '^\d{4}-\d{1,2}-\d{1,2}$') OR try_cast(trim(updated) AS DATE) IS NULL) THEN 'updated: bad date' END"))
R.scalar("b49_headings", "documents", "doc_id", "text IS NOT NULL", title=(lambda: X.first_heading(c("text"), F.lit("untitled")), r"CASE WHEN regexp_matches(text, '(?m)^# ') THEN trim(regexp_extract(text, '(?m)^# ([^\r\n]*)', 1)) ELSE 'untitled' END"))
R.scalar("b50_ages", "nodes", "id", hours=(lambda: F.round(F.greatest(F.lit(0.0), (F.lit(AS_OF) - c("created_at")) / 3600), 6), f"round(greatest(0.0, ({AS_OF} - created_at) / 3600), 6)"))


@R.query("""
    WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')) AS a FROM vault_files),
    n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(name, '')), '[a-z0-9]+')) AS b FROM nodes)
    SELECT a, b FROM t JOIN n ON a = b OR (left(a, 4) = left(b, 4) AND least(length(a), length(b)) >= 4 AND abs(length(a) - length(b)) <= 3 AND (starts_with(a, b) OR starts_with(b, a)))""")
def b3_stem_pairs(spark, d):
    """Words of file titles and of node names that match by stem.  Equal words, or words with the same first four letters: both are equalities."""
    a = table(spark, d, "vault_files").select(F.explode(X.ascii_words(c("title"))).alias("a")).distinct()
    b = table(spark, d, "nodes").select(F.explode(X.ascii_words(c("name"))).alias("b")).distinct()
    block = lambda w: F.when(F.length(w) >= 4, F.substring(w, 1, 4)).otherwise(F.col(w))
    return a.withColumn("k", block("a")).join(b.withColumn("k", block("b")), "k").where(X.stem_equal(c("a"), c("b"))).select("a", "b")


@R.query()
def b16_chunks(spark, d):
    """Pieces of at most 4 000 characters; a fold, checked against plain Python in the tests."""
    t = table(spark, d, "ingestion_log").where("raw_text is not null").select("id", "raw_text").distinct()
    return t.select("id", F.posexplode(X.chunks(c("raw_text"))).alias("piece_no", "piece"))


@R.query("SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM nodes WHERE embedding IS NOT NULL")
def b17_vectors_round_trip(spark, d):
    n = table(spark, d, "nodes").where("embedding is not null")
    return n.select("id", V.decode(V.encode(c("embedding"))).cast("array<double>").alias("v"))


_W1 = f"list_filter(list_distinct({{0}}), lambda t: NOT list_contains({sql_list(X.STOP)}, t))"


@R.query(f"""
    WITH p AS (SELECT id, content AS new, lag(content) OVER (PARTITION BY lower(name) ORDER BY id) AS old FROM nodes),
    t AS (SELECT id, old, new, {_W1.format(WORDS.format('old'))} AS a, {_W1.format(WORDS.format('new'))} AS b FROM p)
    SELECT id, len(list_filter(b, lambda x: NOT list_contains(a, x))) >= 2 AND length(coalesce(new, '')) >= 0.6 * length(coalesce(old, '')) AS is_novel FROM t""")
def b24_novelty(spark, d):
    """Whether a node's content says something that the one before it of its name doesn't."""
    from pyspark.sql import Window as W

    n = table(spark, d, "nodes").select("id", c("content").alias("new"), F.lag("content").over(W.partitionBy(F.lower("name")).orderBy("id")).alias("old"))
    return n.select("id", X.novel(c("old"), c("new")).alias("is_novel"))


_old, _news = "trim(coalesce(content, ''))", "trim(concat('It was seen again. ', coalesce(content, ''), ' It is larger now, and much heavier.'))"
_join = rf"CASE WHEN o = '' THEN n ELSE regexp_replace(concat(regexp_replace(o, '[. ]+$', ''), '. ', n), '^[. ]+|[. ]+$', '', 'g') || '.' END"
_new_words = f"len(list_filter(list_filter(list_distinct({WORDS.format('n')}), lambda t: NOT list_contains({sql_list(X.STOP)}, t)), lambda x: NOT list_contains({WORDS.format('content')}, x)))"


@R.query(f"""WITH x AS (SELECT id, content, {_old} AS o, {_news} AS n FROM nodes), y AS (SELECT *, {_join} AS j, n <> '' AND lower(n) <> lower(o) AND {_new_words} >= 2 AND length(n) >= 0.6 * length(coalesce(content, '')) AS fresh FROM x),
    z AS (SELECT *, string_split(j, '. ') AS p FROM y)
    SELECT id, CASE WHEN NOT fresh THEN coalesce(content, '') WHEN length(j) <= 600 THEN j ELSE coalesce(list_filter(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '. ')), lambda s: length(s) <= 600)[1], p[-1]) END AS content FROM z""")
def b25_absorbed(spark, d):
    """Contents with a novel one appended, trimmed by sentences."""
    n = table(spark, d, "nodes")
    news = F.concat(F.lit("It was seen again. "), F.coalesce("content", F.lit("")), F.lit(" It is larger now, and much heavier."))
    return n.select("id", X.absorbed(c("content"), news).alias("content"))


@R.query()
def b30_excerpts(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return L.excerpts(t.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body")), ["harbour", "ledger"])


@R.query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_extract(chr(10) || '# T' || chr(10) || '## Now' || chr(10) || coalesce(text, '') || chr(10) || '## Later' || chr(10) || 'x' || chr(10) || '# ', '(?s)\n## Now[ \t]*\r?\n(.*?)\n#{1,6} ', 1), '\r?\n'), lambda s: trim(s) <> '')) AS n_lines FROM documents""")
def b31_now_blocks(spark, d):
    """Every text as the body of a `## Now` block that another heading ends."""
    body = F.concat(F.lit("# T\n## Now\n"), F.coalesce("text", F.lit("")), F.lit("\n## Later\nx"))
    return table(spark, d, "documents").select("doc_id", F.size(X.now_block(body)).alias("n_lines"))


@R.query(f"""
    SELECT id, CAST({DAY} - CAST(make_timestamp(CAST(last_accessed * 1000000 AS BIGINT)) AS DATE) AS BIGINT) AS untouched,
      CASE WHEN source IS DISTINCT FROM 'import' AND {DAY} - CAST(make_timestamp(CAST(last_accessed * 1000000 AS BIGINT)) AS DATE) >= 3 THEN CAST({DAY} - CAST(make_timestamp(CAST(last_accessed * 1000000 AS BIGINT)) AS DATE) AS BIGINT) END AS stalled
    FROM nodes""")
def b33_stalled(spark, d):
    n = table(spark, d, "nodes").select("id", _dcol("last_accessed").alias("touched"), _dcol("created_at").alias("since"), F.when(c("source") == "import", "someone").alias("waiting_on"))
    return n.select("id", L.untouched(_tod()).cast("long").alias("untouched"), L.stalled(_tod()).cast("long").alias("stalled"))


@R.query(r"""
    WITH l AS (SELECT DISTINCT id, raw_text FROM ingestion_log WHERE raw_text IS NOT NULL),
    r AS (SELECT DISTINCT unnest(regexp_extract_all(raw_text, '\b[LD]-\d{3}\b')) AS ref FROM l)
    SELECT l.id, r.ref FROM l JOIN r ON list_contains(regexp_extract_all(l.raw_text, '[\w-]+'), r.ref)""")
def b41_cited(spark, d):
    """Ledger ids that a text cites on their own; ids are taken out of the text, so the join is an equality."""
    t = table(spark, d, "ingestion_log").where("raw_text is not null").select("id", "raw_text").distinct()
    refs = t.select("id", "raw_text", F.explode(F.array_distinct(F.regexp_extract_all("raw_text", F.lit(r"\b[LD]-\d{3}\b"), F.lit(0)))).alias("ref"))
    return refs.where(answers.cited(c("raw_text"), c("ref"))).select("id", "ref")


@R.query()
def b46_alike_names(spark, d):
    """Names of one type alike by matching blocks; checked in the tests against all pairs."""
    return I.name_duplicates(table(spark, d, "nodes")).where("reason = 'ratio'")


@R.query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END AS n_fields, CASE doc_id % 3 WHEN 0 THEN length(text) WHEN 1 THEN length(text) ELSE length(text) + 27 END AS n_body, CASE WHEN doc_id % 3 = 2 THEN 'a line of the front matter has no colon' END AS error FROM documents WHERE text IS NOT NULL AND NOT starts_with(text, '---')""")
def a9_front_matter(spark, d):
    """Texts below a good header, without one and below a bad one; texts with a header of their own are none of the three."""
    head = F.when(c("doc_id") % 3 == 0, '---\ntype: note\n# remark\nname: "A name"\nkeys: [a, b]\n---\n').when(c("doc_id") % 3 == 2, "---\ntype: note\nnothing\n---\n").otherwise("")
    fm, body, err = markdown.front_matter(F.concat(head, F.col("text")))
    return table(spark, d, "documents").where("text is not null and not startswith(text, '---')").select("doc_id", F.coalesce(F.size(fm), F.lit(0)).alias("n_fields"), F.length(body).alias("n_body"), err.alias("error"))
