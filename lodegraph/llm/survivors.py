"""Problem 1: one surviving record per duplicate group, chosen field by field.

Fields are unpivoted to long rows, each row votes for its normalised value, values are ranked, `max_by` picks the
winners and the result is pivoted back.  Both aggregations combine on the map side and keep one struct per group and
field, so a group that holds a third of all rows is never gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldRule:
    """How one field is chosen.

    name: of the field in the result.
    value: normalised value that rows vote for; rows with equal values add their votes.
    fitness: a row's own rank within the field, null where the row can't supply it.
    vote: how much the row's vote weighs in this field; null takes the votes of all fields.
    pooled: votes of rows with equal values are added; otherwise every id stands for itself and its largest vote counts.
    """

    name: str
    value: Column
    fitness: Column
    vote: Column | None = None
    pooled: bool = True


def by_fitness(name: str, rec_id: Column, fitness: Column) -> FieldRule:
    """A field whose definition names the fittest row: every row stands for itself, and its vote weighs as much as it is fit."""
    return FieldRule(name, rec_id, fitness, fitness, False)


def vote(source: Column, clock: Column, as_of: float, trust: dict[str, float], other_trust: float = 0.5, half_life_days: float = 180.0) -> Column:
    """Source trust times recency decay.  Null or future clocks count as just now; unknown and null sources as `other_trust`."""
    trusted = F.coalesce(F.create_map(*[x for k, v in trust.items() for x in (F.lit(k), F.lit(float(v)))])[source], F.lit(other_trust)) if trust else F.lit(other_trust)
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - F.coalesce(clock, F.lit(as_of))) / 86400.0)
    return trusted * F.pow(F.lit(0.5), age / half_life_days)


def winners(df: DataFrame, group: Sequence[Column], rec_id: Column, rules: Sequence[FieldRule], votes: Column) -> DataFrame:
    """For every group of at least two distinct ids: group_id (the smallest id) and `<field>_id`, the id that supplies the field.

    The value with the largest sum of votes wins, and of the rows that hold it the fittest supplies it.  Ties go to the smaller
    id.  Rows with a null or empty group key or a null id belong to no group; rows that can't supply a field have
    no vote in it; repeated rows vote once per row, where votes are pooled, but don't make a group; a field that no row
    can supply is null; an empty input gives no rows.
    """
    key = [f"_k{i}" for i in range(len(group))]
    field = lambda r: F.struct(F.xxhash64(r.value).alias("v"), r.fitness.cast("double").alias("f"), (votes if r.vote is None else r.vote).cast("double").alias("w"))
    base = df.select(*[g.cast("string").alias(k) for g, k in zip(group, key)], rec_id.cast("string").alias("_id"), *[field(r).alias(f"_f{i}") for i, r in enumerate(rules)])
    base = base.where(F.col("_id").isNotNull())
    for k in key:
        base = base.where(F.col(k) != "")
    base = base.withColumn("_h", F.xxhash64(*key))
    # A 64-bit key first: only groups that can have two ids are unpivoted.  The exact key decides below.
    several = base.groupBy("_h").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).where("a <> b").select("_h")
    base = base.join(several, "_h", "left_semi")
    long = base.select(*key, "_id", F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.lit(r.pooled).alias("pooled"), F.col(f"_f{i}.v").alias("v"), F.col(f"_f{i}.f").alias("f"), F.col(f"_f{i}.w").alias("w")) for i, r in enumerate(rules)])).alias("x")).select(*key, "_id", "x.*")
    able = F.col("f").isNotNull()
    # (fitness, smaller id first) as an order: the best of max(fitness) and, within it, min(id).
    per_value = long.groupBy(*key, "field", "pooled", "v").agg(
        F.sum(F.when(able, F.col("w"))).alias("added"),
        F.max(F.when(able, F.col("w"))).alias("single"),
        F.min(F.when(able, F.struct((-F.col("f")).alias("nf"), F.col("_id").alias("id")))).alias("best"),
        F.min("_id").alias("lo"),
        F.max("_id").alias("hi"),
    )
    rank = F.struct(F.round(-F.when(F.col("pooled"), F.col("added")).otherwise(F.col("single")), 9).alias("nv"), F.col("best.nf").alias("nf"), F.col("best.id").alias("id"))
    per_field = per_value.groupBy(*key, "field").agg(F.min_by(F.col("best.id"), F.when(F.col("best").isNotNull(), rank)).alias("winner"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    wide = per_field.groupBy(*key).agg(F.min("lo").alias("group_id"), F.max("hi").alias("hi"), *[F.max(F.when(F.col("field") == i, F.col("winner"))).alias(f"{r.name}_id") for i, r in enumerate(rules)])
    return wide.where(F.col("group_id") != F.col("hi")).select("group_id", *[f"{r.name}_id" for r in rules])
