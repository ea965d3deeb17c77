"""Queries of the training-data operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import compact, words
from ..sources.tables import AS_OF, table
from ..workspace import Workspace
from . import chunks, cutoff, leaks, mixing, names, near, neighbours, pii, survivors

#: How far each source of nodes is trusted, 0 to 1; a parameter of p1_survivors.
TRUST = {"manual": 1.0, "cli": 0.9, "vault": 0.9, "mcp": 0.7, "import": 0.6, "capture": 0.5}


def _fitness() -> dict[str, Column]:
    """How fit a row of nodes is to supply each field; null where it can't."""
    return {
        "content": F.size(F.array_distinct(words(F.col("content")))),
        "importance": F.when(F.col("importance").isNotNull(), F.col("confidence")),
        "accessed": F.when(F.col("last_accessed") <= AS_OF, F.col("last_accessed")),
        "count": F.col("access_count"),
    }


def _values() -> dict[str, Column]:
    """What rows of nodes vote for, normalised."""
    return {
        "content": F.coalesce(F.lower(F.trim(F.regexp_replace("content", r"\s+", " "))), F.lit("")),
        "importance": F.round("importance", 6),
        "accessed": F.round("last_accessed", 0),
        "count": F.col("access_count"),
    }


def _survivors(spark: SparkSession, d: str, rules: list[survivors.FieldRule]) -> DataFrame:
    n = table(spark, d, "nodes").select("id", "name", "type", "content", "source", "last_accessed", "access_count", "importance", "confidence").where("type not in ('person', 'organization')")
    return survivors.winners(n, [F.col("type"), compact(F.col("name"))], F.col("id"), rules, survivors.vote(F.col("source"), F.col("last_accessed"), AS_OF, TRUST))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Votes that weigh as much as the definition's fitness of each field."""
    w = _survivors(spark, d, [survivors.by_fitness(f, F.col("id"), x) for f, x in _fitness().items()])
    return w.select("group_id", "content_id", "importance_id", "accessed_id", "count_id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving records themselves: votes weigh as the row's source is trusted and as its clock is recent, and each field has the value with the most of them."""
    w = _survivors(spark, d, [survivors.FieldRule(f, v, _fitness()[f]) for f, v in _values().items()])
    n = table(spark, d, "nodes").select("id", "content", "importance", "last_accessed", "access_count")  # a repeated id gives repeated rows, of which max takes one
    long = w.select("group_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_id").alias("id")) for c in ("content", "importance", "accessed", "count")])).alias("x")).select("group_id", "x.*")
    got = long.join(n, "id", "left")
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return got.groupBy("group_id").agg(pick("content", "content").alias("content"), pick("importance", "importance").alias("importance"), pick("accessed", "last_accessed").alias("last_accessed"), pick("count", "access_count").alias("access_count"))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nodes").select("id", "name", "content")
    return near.linked(near.word_sets(n, F.col("id"), [F.col("name"), F.col("content")]), share_of_blocks=1.0)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near.expand(*_near(spark, d))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return near.per_record(*_near(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").select(F.lit("nodes").alias("tbl"), F.col("id").alias("rec_id"), F.col("content").alias("text"))
    return n.unionByName(table(spark, d, "ingestion_log").select(F.lit("ingestion_log").alias("tbl"), F.col("id").alias("rec_id"), F.col("raw_text").alias("text")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.detect(_texts(spark, d), ["tbl", "rec_id"], "text").select("tbl", "rec_id", "kind").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_texts(spark, d), "text").select("tbl", "rec_id", "redacted", "n_items").distinct()


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return names.linked(table(spark, d, "nodes").select("id", "name", "type"), F.col("id"), F.col("name"), F.col("type"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.expand(*_names(spark, d))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return names.per_record(*_names(spark, d))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ingestion_log")
    return chunks.split(t, F.col("id"), F.col("raw_text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece_no > 0").select("log_id").distinct()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").select(F.col("id").alias("key"), "embedding").unionByName(table(spark, d, "vault_files").select(F.col("path").alias("key"), "embedding"))
    return neighbours.usable(n, F.col("key"), F.col("embedding"), 64)


def _near_vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.links(_vectors(spark, d), 64, k=5, least=0.88)


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _near_vectors(spark, d).withColumn("cosine", F.round("cosine", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(_near_vectors(spark, d))


def _leaks(spark: SparkSession, d: str, **how) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leaks.find(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"), **how)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_similar(spark: SparkSession, d: str) -> DataFrame:
    """Also passages with changed words, and how much of each item a document holds."""
    return _leaks(spark, d, similarity=0.8).withColumn("share_of_item", F.round(F.col("windows") / F.col("item_windows"), 6))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    docs, targets = mixing.prepared(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))
    docs = Workspace(spark, "mixing").save(docs)  # tokens are counted once
    return docs, mixing.source_sizes(docs, targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that miss their share in the mixture as it is laid out, all their texts used as often as they may be."""
    return p9_shares(spark, d).where("reached_tokens = available_tokens and reached_tokens < wanted_tokens").select("source")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each text is used in the mixture of target shares."""
    docs, sizes = _mix(spark, d)
    return mixing.realise(docs, mixing.plan(sizes))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of the mixture."""
    docs, sizes = _mix(spark, d)
    plans = mixing.plan(sizes)
    return mixing.report(spark, plans, mixing.realise(docs, plans))


def p9_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The same at the largest budget at which every source reaches its share."""
    docs, sizes = _mix(spark, d)
    plans = mixing.plan(sizes, budget=mixing.held_budget(sizes))
    return mixing.report(spark, plans, mixing.realise(docs, plans))


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The flattest mixture of natural shares that the repetition limits allow."""
    docs, sizes = _mix(spark, d)
    total = float(sum(s["tokens"] for s in sizes))
    _, w = mixing.temperature([s["tokens"] for s in sizes], [s["max_repeats"] for s in sizes], total)
    plans = mixing.plan([s | {"target_share": x} for s, x in zip(sizes, w)])
    return mixing.report(spark, plans, mixing.realise(docs, plans))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.flagged(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), F.col("source"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).where("truncated").select(F.col("rec_id").alias("doc_id")).distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.rates(_cut(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [p1_found, p1_survivors, p2_found, p2_records, p3_found, p3_redacted, p5_found, p5_records, p6_found, p6_pieces, p7_found, p7_neighbours, p8_found, p8_similar, p9_found, p9_mixture, p9_shares, p9_balanced, p9_tempered, p10_found, p10_rates]
    return {f.__name__: f for f in every}


#: Brute force over all pairs of vectors; copies of a vector have cosine 1.
_NEAR = """WITH r AS (SELECT key, min(e) AS e FROM (SELECT id AS key, CAST(embedding AS DOUBLE[]) AS e FROM nodes UNION ALL SELECT path, CAST(embedding AS DOUBLE[]) FROM vault_files) WHERE key IS NOT NULL AND len(e) = 64 GROUP BY key),
            v AS (SELECT key, CAST(list_transform(e, lambda x: CAST(x / sqrt(list_dot_product(e, e)) AS FLOAT)) AS DOUBLE[]) AS v FROM r WHERE list_dot_product(e, e) > 0),
            p AS (SELECT x.key, y.key AS other, CASE WHEN x.v = y.v THEN 1.0 ELSE round(list_dot_product(x.v, y.v), 9) END AS cosine FROM v x JOIN v y ON x.key <> y.key WHERE list_dot_product(x.v, y.v) >= 0.88 - 1e-7),
            k AS (SELECT key, other, cosine, row_number() OVER (PARTITION BY key ORDER BY cosine DESC, other) AS rank FROM p WHERE cosine >= 0.88)"""
_W = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"


def oracle_sql() -> dict[str, str]:
    w = _W.format
    return {
        "p1_found": f"""
            WITH x AS (SELECT id, type, array_to_string({w('name')}, '') AS k, len(list_distinct({w('content')})) AS words, importance, confidence, last_accessed, access_count
                       FROM nodes WHERE type NOT IN ('person', 'organization') AND name IS NOT NULL),
            g AS (SELECT type, k, min(id) AS group_id FROM x WHERE k <> '' GROUP BY type, k HAVING count(DISTINCT id) >= 2)
            SELECT group_id, max(content_id) AS content_id, max(importance_id) AS importance_id, max(accessed_id) AS accessed_id, max(count_id) AS count_id FROM (
              SELECT g.group_id,
                first_value(id) OVER (PARTITION BY g.group_id ORDER BY words DESC, id) AS content_id,
                CASE WHEN importance IS NOT NULL AND confidence IS NOT NULL AND row_number() OVER (PARTITION BY g.group_id ORDER BY (importance IS NULL OR confidence IS NULL), confidence DESC, id) = 1 THEN id END AS importance_id,
                CASE WHEN last_accessed <= {AS_OF} AND row_number() OVER (PARTITION BY g.group_id ORDER BY (last_accessed IS NULL OR last_accessed > {AS_OF}), last_accessed DESC, id) = 1 THEN id END AS accessed_id,
                CASE WHEN access_count IS NOT NULL AND row_number() OVER (PARTITION BY g.group_id ORDER BY access_count IS NULL, access_count DESC, id) = 1 THEN id END AS count_id
              FROM x JOIN g USING (type, k)) GROUP BY group_id""",
        "p1_survivors": f"""
            WITH x AS (SELECT id, type, array_to_string({w('name')}, '') AS k, content, importance, confidence, last_accessed, access_count,
                         CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in TRUST.items())} ELSE 0.5 END * pow(0.5, greatest(0.0, ({AS_OF} - coalesce(last_accessed, {AS_OF})) / 86400.0) / 180.0) AS vote
                       FROM nodes WHERE type NOT IN ('person', 'organization') AND name IS NOT NULL),
            g AS (SELECT type, k, min(id) AS group_id FROM x WHERE k <> '' GROUP BY type, k HAVING count(DISTINCT id) >= 2),
            l AS (SELECT g.group_id, x.id, x.vote, u.f, u.v, u.fit FROM x JOIN g USING (type, k), LATERAL (VALUES
                    ('content', coalesce(lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), ''), CAST(len(list_distinct({w('content')})) AS DOUBLE)), ('importance', CAST(round(importance, 6) AS VARCHAR), CASE WHEN importance IS NOT NULL THEN confidence END),
                    ('accessed', CAST(round(last_accessed, 0) AS VARCHAR), CASE WHEN last_accessed <= {AS_OF} THEN last_accessed END), ('count', CAST(access_count AS VARCHAR), CAST(access_count AS DOUBLE))) AS u(f, v, fit)),
            p AS (SELECT group_id, f, v, round(sum(vote), 9) AS votes, max(fit) AS fit, min_by(id, (-fit, id)) AS id FROM l WHERE fit IS NOT NULL GROUP BY group_id, f, v),
            b AS (SELECT group_id, f, id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, f ORDER BY votes DESC, fit DESC, id) AS r FROM p) WHERE r = 1)
            SELECT g.group_id, max(CASE WHEN f = 'content' THEN n.content END) AS content, max(CASE WHEN f = 'importance' THEN n.importance END) AS importance, max(CASE WHEN f = 'accessed' THEN n.last_accessed END) AS last_accessed, max(CASE WHEN f = 'count' THEN n.access_count END) AS access_count
            FROM g LEFT JOIN b USING (group_id) LEFT JOIN nodes n USING (id) GROUP BY g.group_id""",
        "p2_found": f"""
            WITH s AS (SELECT id, list_distinct({w("concat(coalesce(name, ''), ' ', coalesce(content, ''))")}) AS t FROM nodes),
            b AS (SELECT id, t, len(t) AS n FROM s WHERE len(t) >= 20),
            u AS (SELECT id, n, unnest(t) AS w FROM b),
            i AS (SELECT x.id AS a_id, y.id AS b_id, any_value(x.n) AS nx, any_value(y.n) AS ny, count(*) AS shared FROM u x JOIN u y ON x.w = y.w AND x.id < y.id GROUP BY x.id, y.id)
            SELECT a_id, b_id FROM i WHERE shared / (nx + ny - shared) >= 0.7 - 1e-12""",
        "p2_records": f"""
            WITH s AS (SELECT id, list_sort(list_distinct({w("concat(coalesce(name, ''), ' ', coalesce(content, ''))")})) AS t FROM nodes), c AS (SELECT id, t, min(id) OVER (PARTITION BY t) AS class_id, count(*) OVER (PARTITION BY t) AS copies FROM s WHERE len(t) >= 20),
            r AS (SELECT DISTINCT class_id, t FROM c), u AS (SELECT class_id, len(t) AS n, unnest(t) AS w FROM r),
            i AS (SELECT x.class_id AS a, y.class_id AS b, any_value(x.n) AS nx, any_value(y.n) AS ny, count(*) AS shared FROM u x JOIN u y ON x.w = y.w AND x.class_id <> y.class_id GROUP BY 1, 2),
            k AS (SELECT a, count(*) AS links FROM i WHERE shared / (nx + ny - shared) >= 0.7 - 1e-12 GROUP BY a)
            SELECT id, class_id, copies, coalesce(links, 0) AS links FROM c LEFT JOIN k ON k.a = c.class_id""",
        "p7_found": f"{_NEAR} SELECT DISTINCT least(key, other) AS a_key, greatest(key, other) AS b_key FROM k WHERE rank <= 5",
        "p7_neighbours": f"{_NEAR} SELECT key, other, round(cosine, 6) AS cosine, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5",
        "p6_found": "SELECT DISTINCT id AS log_id FROM ingestion_log WHERE length(raw_text) > 4000",
        "p9_found": r"""
            WITH t AS (SELECT source, target_share, max_repeats FROM mix_targets), s AS (SELECT source, sum(len(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+'))) AS n FROM documents WHERE text IS NOT NULL AND source IN (SELECT source FROM t) GROUP BY source)
            SELECT t.source FROM t LEFT JOIN s USING (source) WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(n) FROM s)""",
        "p8_found": f"""
            WITH d AS (SELECT doc_id, {w('text')} AS t FROM documents WHERE text IS NOT NULL),
            e AS (SELECT item_id, {w('text')} AS t FROM eval_items WHERE text IS NOT NULL),
            dw AS (SELECT doc_id, array_to_string(t[i:i+11], ' ') AS g FROM d, unnest(range(1, len(t) - 10)) AS r(i) WHERE len(t) >= 12),
            ew AS (SELECT DISTINCT item_id, array_to_string(t[i:i+11], ' ') AS g FROM e, unnest(range(1, len(t) - 10)) AS r(i) WHERE len(t) >= 12)
            SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)""",
    }
