"""Ledgers by meaning: records of loops and decisions, their vectors, and what an answer sees of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import index, search

LEAST = 0.5


def records(loops: DataFrame, decisions: DataFrame) -> DataFrame:
    """(key, text, sha): one record per loop, closed ones too, and per decision."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = loops.where("id is not null").select(F.col("id").alias("key"), F.trim(F.concat(F.col("id"), F.lit(" "), empty("title"), F.lit(". Next: "), empty("next"), F.lit(". "), empty("note"))).alias("text"))
    b = decisions.where("id is not null").select(F.col("id").alias("key"), F.trim(F.concat(F.col("id"), F.lit(" "), empty("title"), F.lit(". "), empty("decision"), F.lit(" Why: "), empty("why"))).alias("text"))
    return a.unionByName(b).withColumn("sha", F.substring(F.sha2("text", 256), 1, 16))


def embedded(current: DataFrame, previous: DataFrame, embedder: Callable[[pd.Series], list]) -> DataFrame:
    """(key, text, sha, embedding, status) of the records: unchanged ones keep their vector, only new, changed and vectorless ones are embedded, removed ones are gone.

    previous: (key, sha, embedding).  Where the embedder gives nothing the vector stays null and is asked for again next time.
    """
    up = index.upserted(current, previous, "key").join(index.changes(current, previous, "key"), "key")
    todo = up.where("embedding is null").select("key", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "_new": list(embedder(b["text"]))})

    new = todo.mapInPandas(run, "key string, _new array<float>")
    return up.join(new, "key", "left").withColumn("embedding", F.coalesce("embedding", "_new")).select("key", "text", "sha", "embedding", "status")


def semantic(indexed: DataFrame, vector: list[float], limit: int = 6, least: float = LEAST) -> DataFrame:
    """(key, cosine): the records closest to a query's vector, cosines to three digits."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    near = indexed.where("embedding is not null").select("key", F.round(V.cosine(F.col("embedding"), q), 6).alias("c")).where(F.col("c") >= least)
    return near.select("key", F.round("c", 3).alias("cosine")).orderBy(F.desc("cosine"), "key").limit(limit)


def context(loops: DataFrame, decisions: DataFrame, query: str, near: DataFrame | None = None, most_loops: int = 8, most_decisions: int = 6) -> DataFrame:
    """(kind, pos, id, line): decisions and loops for an answer.

    The best five of each by shared words, closed loops too, then records close to the query (`near`: key, cosine) until
    there are `most_loops` and `most_decisions`.
    """
    d = search.ledger_search(decisions.select("id", F.concat_ws(" ", "title", "decision").alias("text")), "text", query).select("id", F.lit("decision").alias("kind"), F.lit(0).alias("src"), (-F.col("hits")).cast("double").alias("o"), F.lit(0).alias("o2"))
    x = loops.withColumn("_closed", F.col("done").isNotNull())
    s = search.ledger_search(x.select("id", F.concat_ws(" ", "title", "next").alias("text"), "_closed"), "text", query, closed="_closed")
    s = s.select("id", F.lit("loop").alias("kind"), F.lit(0).alias("src"), (-F.col("hits")).cast("double").alias("o"), F.col("_closed").cast("int").alias("o2")).distinct()
    every = d.unionByName(s)
    if near is not None:
        n = near.select(F.col("key").alias("id"), F.when(F.col("key").startswith("D-"), "decision").otherwise("loop").alias("kind"), F.lit(1).alias("src"), (-F.col("cosine")).alias("o"), F.lit(0).alias("o2"))
        every = every.unionByName(n.join(every.select("id"), "id", "left_anti"))
    w = W.partitionBy("kind").orderBy("src", "o", "o2", "id")  # at most 5 + 6 rows a kind
    top = every.withColumn("pos", F.row_number().over(w)).where(F.when(F.col("kind") == "decision", F.col("pos") <= most_decisions).otherwise(F.col("pos") <= most_loops))
    revisit = F.when(~F.coalesce(F.col("revisit"), F.lit("")).isin("", "—"), F.concat(F.lit(" Revisit if: "), F.col("revisit"))).otherwise("")
    dl = decisions.select("id", F.concat(F.col("id"), F.lit(" ("), F.date_format("date", "yyyy-MM-dd"), F.lit(") "), F.col("title"), F.lit(": "), F.col("decision"), F.lit(" Why: "), F.coalesce("why", F.lit("")), revisit).alias("line"))
    state = F.when(F.col("done").isNotNull(), F.concat(F.lit("done "), F.date_format("done", "yyyy-MM-dd"))).otherwise(F.concat(F.lit("due "), F.date_format("due", "yyyy-MM-dd"), F.lit(", owner "), F.col("owner")))
    ll = loops.select("id", F.concat(F.col("id"), F.lit(" "), F.col("title"), F.lit(" ("), state, F.lit("): next "), F.col("next")).alias("line"))
    return top.join(dl.unionByName(ll), "id").select("kind", "pos", "id", "line")
