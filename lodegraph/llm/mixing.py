"""Problem 9: mixing sources to target weights.

Token sizes are counted once per text.  The exponent of the temperature is bisected until the weights meet a target
entropy or no source has to repeat its texts more often than it may.  Weights become budgets and every budget is filled
with whole permutations of its source followed by the opening of one more.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace

#: Where the public tokenizers' files are; a parameter of everything below.
TOKENIZERS = os.environ.get("LODEGRAPH_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the split pattern published with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hash blocks in which a source's permutation is laid out; the largest unit that is sorted by one task is one block.
BLOCKS = 4096


@cache
def encoding(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Replace the column `text` by its size in tokens; null texts have 0.  Texts are encoded whole, in Arrow batches."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(count, schema)


def tempered(shares: Sequence[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and normalised; 1 keeps them, 0 makes the positive ones equal."""
    raw = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raw)
    return [r / total if total else 0.0 for r in raw]


def entropy(weights: Sequence[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect_exponent(shares: Sequence[float], ok, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The smallest exponent in [low, high] for which ok(weights) holds; ok must hold from some exponent on; `high` if it never does."""
    if ok(tempered(shares, low)):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(tempered(shares, mid)) else (mid, high)
    return high


def temperature(sizes: Sequence[int], repeats: Sequence[int], budget: float, target_entropy: float | None = None) -> tuple[float, list[float]]:
    """Exponent and weights: as flat as the repetition limits allow for this budget, but no flatter than the target entropy."""
    total = sum(sizes)
    shares = [s / total if total else 0.0 for s in sizes]

    def ok(w: Sequence[float]) -> bool:
        fits = all(x * budget <= s * r + 1e-6 for x, s, r in zip(w, sizes, repeats))
        return fits and (target_entropy is None or entropy(w) <= target_entropy + 1e-12)

    e = bisect_exponent(shares, ok)
    return e, tempered(shares, e)


def for_entropy(shares: Sequence[float], target_entropy: float) -> tuple[float, list[float]]:
    """Exponent and weights of shares whose entropy is the target's; an exponent above 1 is not looked for."""
    e = bisect_exponent(shares, lambda w: entropy(w) <= target_entropy + 1e-12)
    return e, tempered(shares, e)


def source_sizes(docs: DataFrame, targets: DataFrame) -> list[dict]:
    """Per target source: share, max_repeats, texts and tokens.  One row per source of the targets, which are few by nature and checked to be."""
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"))
    rows = targets.join(sums, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts")).orderBy("source").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10 000 target sources")
    return [r.asDict() for r in rows]


def plan(sizes: list[dict], budget: float | None = None, target_entropy: float | None = None) -> list[dict]:
    """Token budgets per source.

    Weights are the target shares at the temperature that meets `target_entropy`, by default that of the target shares themselves.
    A source that can't fill its budget within max_repeats is `short`: it gives all it may, and the shortfall is not
    passed on to others, so the mixture is smaller and the shares really reached say so (`held_budget` is the largest budget
    at which none is short).  The budget defaults to the size of all texts of the sources, each counted once.
    """
    total = float(sum(s["tokens"] for s in sizes)) if budget is None else float(budget)
    shares = [s["target_share"] or 0.0 for s in sizes]
    whole = sum(shares)
    shares = [s / whole if whole else 0.0 for s in shares]
    _, weights = for_entropy(shares, entropy(shares) if target_entropy is None else target_entropy)
    out = []
    for s, w in zip(sizes, weights):
        most = s["tokens"] * max(0, s["max_repeats"] or 0)
        want = w * total
        out.append(s | {"weight": w, "budget": total, "want": want, "most": most, "short": most < want, "take": min(want, float(most))})
    return out


def held_budget(sizes: list[dict]) -> float:
    """The largest budget at which every source with texts reaches its share of it; sources without any can't at any budget and don't count."""
    limits = [s["tokens"] * max(0, s["max_repeats"] or 0) / s["target_share"] for s in sizes if (s["target_share"] or 0) > 0 and s["tokens"]]
    return float(min(limits, default=0.0))


#: Rounds in which a budget is filled up by single texts, and the share of it that may be missing after fewer.
ROUNDS, MISSING = 6, 0.001


def realise(docs: DataFrame, plans: list[dict], rec_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """(rec_id, source, n_tokens, uses): how often each text is used.

    A source's budget is floor(budget / size) whole permutations plus the opening of one more: texts are ordered by a
    seeded hash and taken until the rest of the budget is met (the text that crosses it is left out).  Sums run over hash
    blocks first, and only the one block that holds the crossing is ordered row by row, so no task sees a whole source.
    What is still missing is filled up by unused texts, one a source and round: the largest that fits, or where none does the
    smallest if that brings the source nearer to its budget.
    """
    spark = docs.sparkSession
    rows = []
    for p in plans:
        whole = int(p["take"] // p["tokens"]) if p["tokens"] else 0
        rows.append((p["source"], whole, float(p["take"] - whole * p["tokens"]) if p["tokens"] else 0.0))
    want = F.broadcast(spark.createDataFrame(rows, "source string, whole int, rest double"))  # one row per target source
    h = F.xxhash64(F.lit(seed), F.col(rec_id))
    x = docs.join(want, "source").withColumn("_h", h).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(BLOCKS)))
    blocks = x.groupBy("source", "_b").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    from pyspark.sql import Window as W

    before = F.sum("t").over(W.partitionBy("source").orderBy("_b")) - F.col("t")  # at most BLOCKS rows a source
    blocks = blocks.select(F.col("source").alias("_s"), F.col("_b").alias("_bb"), before.alias("_before"), (before + F.col("t") <= F.col("rest")).alias("_all"), (before > F.col("rest")).alias("_none"))
    x = x.join(blocks, (F.col("source") == F.col("_s")) & (F.col("_b") == F.col("_bb")))
    done = x.where("_all or _none").select(rec_id, "source", "n_tokens", (F.col("whole") + F.col("_all").cast("int")).alias("uses"))
    run = F.sum("n_tokens").over(W.partitionBy("source", "_b").orderBy("_h", rec_id).rowsBetween(W.unboundedPreceding, 0))
    crossing = x.where("not _all and not _none").withColumn("_run", run + F.col("_before"))
    edge = crossing.select(rec_id, "source", "n_tokens", (F.col("whole") + (F.col("_run") <= F.col("rest")).cast("int")).alias("uses"))
    laid = Workspace(spark, "mixture").save(done.unionByName(edge))
    got = {r["source"]: float(r["t"] or 0) for r in laid.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("t")).collect()}  # one row per target source
    missing = {p["source"]: p["take"] - got.get(p["source"], 0.0) for p in plans}
    spare = {p["source"]: whole for p, (_, whole, _) in zip(plans, rows) if whole < max(0, p["max_repeats"] or 0)}
    extra: list[tuple[str, int]] = []
    for _ in range(ROUNDS):
        todo = [(s, w, missing[s]) for s, w in spare.items() if missing[s] > max(1.0, MISSING * next(p["take"] for p in plans if p["source"] == s))]
        if not todo:
            break
        # At most one row a target source and round travels.
        open_ = F.broadcast(spark.createDataFrame(todo, "source string, whole int, miss double"))
        free = laid.join(open_, "source").where((F.col("uses") == F.col("whole")) & (F.col("n_tokens") < 2 * F.col("miss")) & (F.col("n_tokens") > 0))
        if extra:
            free = free.join(F.broadcast(spark.createDataFrame(extra, f"source string, {rec_id} {laid.schema[rec_id].dataType.simpleString()}")), ["source", rec_id], "left_anti")
        best = free.groupBy("source").agg(F.min(F.struct((F.col("n_tokens") > F.col("miss")).alias("over"), F.abs(F.col("n_tokens") - F.col("miss")).alias("off"), F.col(rec_id).alias("rec"), "n_tokens")).alias("b")).collect()
        if not best:
            break
        for r in best:
            extra.append((r["source"], r["b"]["rec"]))
            missing[r["source"]] -= r["b"]["n_tokens"]
    if extra:
        more = F.broadcast(spark.createDataFrame(extra, f"source string, {rec_id} {laid.schema[rec_id].dataType.simpleString()}").withColumn("_more", F.lit(1)))
        laid = laid.join(more, ["source", rec_id], "left").select(rec_id, "source", "n_tokens", (F.col("uses") + F.coalesce("_more", F.lit(0))).alias("uses"))
    return laid.where("uses > 0")


def prepared(df: DataFrame, rec_id: str, text: str, source: str, targets: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> tuple[DataFrame, DataFrame]:
    """Texts of the target sources with their sizes, and clean targets.  Null sources and texts and sources without a target take no part; repeated target rows count once."""
    t = targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source is not null").dropDuplicates(["source"])
    docs = df.select(F.col(rec_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("_t")).where("_t is not null").join(F.broadcast(t.select("source")), "source", "left_semi")  # few sources: checked in source_sizes
    return with_tokens(docs.select("doc_id", "source", "_t"), "_t", folder=folder, name=name), t


def report(spark, plans: list[dict], used: DataFrame | None = None) -> DataFrame:
    """One row per source: target, wanted, available and reached tokens and shares."""
    base = spark.createDataFrame([(p["source"], float(p["weight"]), int(p["max_repeats"] or 0), int(p["texts"]), int(p["tokens"]), float(p["want"]), int(p["most"]), bool(p["short"]), float(p["budget"])) for p in plans], "source string, target_share double, max_repeats int, texts long, tokens long, wanted_tokens double, available_tokens long, short boolean, budget double")
    if used is None:
        return base
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("reached_tokens"), F.max("uses").alias("most_uses"))
    both = base.join(got, "source", "left").fillna(0, ["reached_tokens", "most_uses"])
    from pyspark.sql import Window as W

    total = F.sum("reached_tokens").over(W.partitionBy(F.lit(1)))  # over as many rows as there are targets
    return both.withColumn("_all", total).select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", "texts", "tokens", F.round("wanted_tokens", 3).alias("wanted_tokens"), "available_tokens", "reached_tokens", "most_uses", "short", F.round(F.col("reached_tokens") / F.col("budget"), 6).alias("share_of_budget"), F.round(F.try_divide(F.col("reached_tokens").cast("double"), F.col("_all").cast("double")), 6).alias("share_reached"))
