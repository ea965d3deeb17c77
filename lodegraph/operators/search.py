"""Keyword, vector and file search with explainable scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.vocab import FILE_KINDS, OTHER_KIND, lookup

# Fixed value: words of a question about people.
WHO = r"\b(?:who|whom|whose|people|persons?|friends?|colleagues?|classmates?|contacts?)\b"
SEMANTIC_LEAST = 0.4
SEMANTIC_ALONE = 0.5


def _literal(spark, query: str, expr) -> list[str]:
    """Tokens of a query, one small row of the driver."""
    return spark.createDataFrame([(query,)], "q string").select(expr(F.col("q")).alias("t")).first()["t"]


def search_nodes(nodes: DataFrame, query: str, least_weight: float = 0.0) -> DataFrame:
    """(id, hits, entity, exact, name_hits, weight) of active nodes with a hit, in order of rank (see `in_order`).

    The query is a constant of the plan, so this is one scan without a join.
    """
    q = query.lower().strip()
    tokens = _literal(nodes.sparkSession, q, X.search_tokens) or ([q] if q else [])
    if not tokens:
        return nodes.where("false").select("id", F.lit(0).alias("hits"), F.lit(0).alias("entity"), F.lit(0).alias("exact"), F.lit(0).alias("name_hits"), "weight")
    qt = F.array(*[F.lit(t) for t in tokens])
    name = F.lower(F.coalesce("name", F.lit("")))
    hay = F.concat(name, F.lit(" "), F.lower(F.coalesce("content", F.lit(""))))
    base = nodes.where((F.col("archived") == 0) & (F.col("weight") >= least_weight)).select("id", "type", "weight", name.alias("_n"), hay.alias("_h"))
    base = base.withColumn("_nt", X.ascii_words(F.col("_n"))).withColumn("_ht", F.array_distinct(X.ascii_words(F.col("_h"))))
    base = base.withColumn("hits", X.hits(qt, F.col("_ht"))).where("hits > 0")
    joined = " ".join(sorted(set(tokens)))
    return base.select(
        "id",
        (F.col("hits") + F.when(F.contains("_h", F.lit(q)), len(set(tokens))).otherwise(0)).alias("hits"),
        F.when(F.col("type") == "category", 0).otherwise(1).alias("entity"),
        F.when((F.array_join("_nt", " ") == joined) | (F.col("_n") == q), 1).otherwise(0).alias("exact"),
        X.hits(qt, F.col("_nt")).alias("name_hits"),
        "weight",
    )


def in_order(found: DataFrame, limit: int) -> DataFrame:
    """The best rows by hits, entity, exact, name hits and weight, then id, with their rank."""
    top = found.orderBy(F.desc("hits"), F.desc("entity"), F.desc("exact"), F.desc("name_hits"), F.desc("weight"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("hits"), F.desc("entity"), F.desc("exact"), F.desc("name_hits"), F.desc("weight"), "id")))  # over `limit` rows


def semantic(df: DataFrame, key: str, vector: str, query: list[float], limit: int = 6, least: float | None = None) -> DataFrame:
    """(key, cosine): the rows most similar to a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = df.where(F.col(vector).isNotNull()).select(F.col(key), F.round(V.cosine(F.col(vector), q), 6).alias("cosine"))
    if least is not None:
        out = out.where(F.col("cosine") >= least)
    return out.orderBy(F.desc("cosine"), key).limit(limit)


def file_scores(files: DataFrame, query: str, seeded: DataFrame | None = None, vector: list[float] | None = None) -> DataFrame:
    """(path, kind, title, updated, score, why) of files with a positive score.

    Title and alias hits count triple, an exact phrase twice the number of query tokens, a file of a seed node 3, a close vector 5 times its
    cosine; for a who-question person files count 3 more; index pages keep 0.6.  `why` names the parts.
    """
    q = query.lower().strip()
    spark = files.sparkSession
    tokens = _literal(spark, q, X.query_tokens)
    n = len(tokens)
    qt = F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")
    who = spark.createDataFrame([(q,)], "q string").select(F.col("q").rlike(WHO)).first()[0]
    head = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")))
    person = F.col("kind") == "person"
    if who:
        head = F.when(person, F.concat(head, F.lit(" "), F.lower(F.coalesce("summary", F.lit(""))))).otherwise(head)
    x = files.withColumn("_head", head)
    x = x.withColumn("_t", X.hits(qt, X.search_tokens(F.col("_head")))).withColumn("_b", X.hits(qt, F.coalesce("tokens", F.array().cast("array<string>"))))
    if seeded is not None:
        s = seeded.select(F.col("path").alias("_sp")).distinct().withColumn("_seed", F.lit(True))
        x = x.join(s, F.col("path") == F.col("_sp"), "left").drop("_sp")
    else:
        x = x.withColumn("_seed", F.lit(None).cast("boolean"))
    cos = V.cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in vector])) if vector is not None else F.lit(0.0)
    is_who = person & F.lit(bool(who)) & ((F.col("_t") > 0) | (F.col("_b") > 0))
    phrase = F.contains("_head", F.lit(q)) & F.lit(q != "")
    base = (3 * F.col("_t") + F.col("_b") + F.when(is_who, 3).otherwise(0) + F.when(phrase, 2 * n).otherwise(0) + F.when(F.col("_seed"), 3).otherwise(0)).cast("double")
    x = x.withColumn("_cos", cos).withColumn("_s", base)
    near = (F.col("_cos") >= SEMANTIC_LEAST) & ((F.col("_s") > 0) | (F.col("_cos") >= SEMANTIC_ALONE))
    x = x.withColumn("_s2", F.col("_s") + F.when(near, 5 * F.col("_cos")).otherwise(0.0))
    index = F.col("kind").isin("readme", "hub")
    why = F.filter(
        F.array(
            F.when(F.col("_t") > 0, F.when(F.col("_t") == n, F.lit("title match")).otherwise(F.concat(F.lit("title match "), F.col("_t"), F.lit(f"/{n}")))).when(F.col("_b") > 0, F.concat(F.lit("body match "), F.col("_b"), F.lit(f"/{n}"))),
            F.when(is_who, "who-question: person file"),
            F.when(phrase, "exact phrase"),
            F.when(F.col("_seed"), "seed node"),
            F.when(near, F.format_string("semantic %.2f", "_cos")),
            F.when(index & (F.col("_s2") > 0), "index page"),
        ),
        lambda w: w.isNotNull(),
    )
    return x.where("_s2 > 0").select("path", "kind", "title", F.coalesce("updated", F.lit("")).alias("updated"), F.round(F.when(index, F.col("_s2") * 0.6).otherwise(F.col("_s2")), 3).alias("score"), why.alias("why"))


def file_order() -> list:
    stamp = F.coalesce(F.try_to_number(F.substring(F.replace("updated", F.lit("-"), F.lit("")), 1, 8), F.lit("99999999")).cast("int"), F.lit(0))
    return [F.desc("score"), lookup(FILE_KINDS, F.col("kind"), OTHER_KIND), F.desc(stamp), F.col("path")]


def hop(scores: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """One hop of links from the three best files: a hit gains 1 per link, another file enters with the number of its links."""
    top = scores.orderBy(*file_order()).limit(3).select(F.col("path").alias("_from"))
    gain = links.join(F.broadcast(top), F.col("path") == F.col("_from")).where("path <> target").groupBy(F.col("target").alias("path")).agg(F.count("*").alias("n"))  # three rows
    known = files.select("path", "kind", "title", F.coalesce("updated", F.lit("")).alias("updated"))
    both = known.join(scores.select("path", "score", "why"), "path", "left").join(gain, "path", "left").where("score is not null or n is not null")
    return both.select("path", "kind", "title", "updated", F.round(F.coalesce(F.col("score"), F.lit(0.0)) + F.coalesce("n", F.lit(0)), 3).alias("score"), F.coalesce("why", F.array().cast("array<string>")).alias("why"))


def best_files(scores: DataFrame, k: int = 6, who: bool = False, slots: int = 3) -> DataFrame:
    """The k best files; for a who-question up to `slots` more person files push out the last others."""
    order = file_order()
    if not who:
        return scores.orderBy(*order).limit(k)
    w = W.orderBy(*order)
    head = scores.orderBy(*order).limit(k).withColumn("_in", F.lit(True))
    people = scores.where("kind = 'person'").orderBy(*order).limit(k + slots)
    extra = people.join(head.select("path"), "path", "left_anti").orderBy(*order).limit(slots).withColumn("_in", F.lit(False))
    every = head.unionByName(extra)  # at most k + slots rows
    ranked = every.withColumn("_p", F.sum((F.col("kind") == "person").cast("int")).over(W.partitionBy(F.lit(1)))).withColumn("_r", F.row_number().over(W.partitionBy((F.col("kind") == "person")).orderBy(*order)))
    kept = ranked.where((F.col("kind") == "person") | (F.col("_r") <= F.greatest(F.lit(0), F.lit(k) - F.col("_p"))))
    return kept.withColumn("_o", F.row_number().over(w)).where(F.col("_o") <= k).select("path", "kind", "title", "updated", "score", "why")


def ledger_search(rows: DataFrame, text: str, query: str, limit: int = 5, closed: str | None = None) -> DataFrame:
    """(id, hits) of ledger rows that share tokens with the query: most hits first, open before closed, then id."""
    tokens = _literal(rows.sparkSession, query, X.ledger_tokens)
    qt = F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")
    out = rows.select("id", *([closed] if closed else []), F.size(F.array_intersect(qt, X.ledger_tokens(F.col(text)))).alias("hits")).where("hits > 0")
    return out.orderBy(F.desc("hits"), *([F.col(closed)] if closed else []), "id").limit(limit)
