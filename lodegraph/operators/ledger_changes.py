"""Changes of a loop ledger as transforms: rows in, rows and refusals out.  Nothing that a rule forbids is applied, and each refusal says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import ledgers

FIELDS = ["title", "due", "owner", "area", "prio", "next", "note"]


def violation(areas: list[str] = ledgers.AREAS, owner: str = ledgers.OWNER) -> Column:
    """What keeps a row from being a line of the ledger, null if nothing does."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    split = F.lit(False)
    for c in ("title", "next", "note"):
        split = split | text(c).contains("·") | text(c).contains("\n")
    return (
        F.when(F.trim(text("title")) == "", "title is empty").when(F.col("due").isNull(), "due: bad date").when(~text("owner").rlike(owner), "bad owner").when(~text("area").isin(areas), "bad area")
        .when(~F.coalesce(F.col("prio").between(1, 3), F.lit(False)), "bad prio").when(split, "a text holds a separator or line end").when(F.trim(text("next")) == "", "next action is empty")
    )


def added(loops: DataFrame, new: DataFrame, today: str, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """New loops (pos, title, due, owner, area, prio, next, since?) with ids after the ledger's largest, and refusals (pos, refusal).  Null priorities are 2, null `since` is today."""
    t = F.lit(today).cast("date")
    x = new.withColumn("prio", F.coalesce("prio", F.lit(2))).withColumn("since", F.coalesce(F.col("since") if "since" in new.columns else F.lit(None).cast("date"), t)).withColumn("note", F.lit("")).withColumn("touched", t).withColumn("done", F.lit(None).cast("date"))
    x = x.withColumn("refusal", violation())
    ok = ledgers.next_ids(loops, x.where("refusal is null").drop("refusal"), "L", order)
    return ok, x.where("refusal is not null").select(order, "refusal")


def _targets(loops: DataFrame, ids: DataFrame) -> DataFrame:
    """Requests with the loop they mean: `_have` null if there is none."""
    have = loops.groupBy("id").agg(F.min_by(F.struct("title", "due", "owner", "area", "prio", "since", "touched", "done", "note", "next"), F.col("done").isNotNull()).alias("_have"))
    return ids.join(have, "id", "left")


def _standing() -> Column:
    return F.when(F.col("_have").isNull(), "unknown loop").when(F.col("_have.done").isNotNull(), "closed already")


def _replaced(loops: DataFrame, changed: DataFrame) -> DataFrame:
    cols = ["id", "title", "due", "owner", "area", "prio", "since", "touched", "done", "note", "next"]
    return loops.select(*cols).join(changed.select("id"), "id", "left_anti").unionByName(changed.select(*cols))


def closed(loops: DataFrame, ids: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """The ledger with loops (id, note?) done today, and refusals (id, refusal) of unknown and closed ones.  An empty note keeps the old one."""
    t = F.lit(today).cast("date")
    note = F.trim(F.coalesce(F.col("_n"), F.lit(""))) if "note" in ids.columns else F.lit("")
    x = _targets(loops, ids.select("id", *([F.col("note").alias("_n")] if "note" in ids.columns else [])).dropDuplicates(["id"])).withColumn("refusal", _standing())
    ok = x.where("refusal is null").select("id", *[F.col(f"_have.{c}").alias(c) for c in ("title", "due", "owner", "area", "prio", "since", "next")], t.alias("touched"), t.alias("done"), F.coalesce(F.nullif(note, F.lit("")), F.col("_have.note")).alias("note"))
    bad = ok.withColumn("refusal", violation()).where("refusal is not null").select("id", "refusal")
    return _replaced(loops, ok.join(bad.select("id"), "id", "left_anti")), x.where("refusal is not null").select("id", "refusal").unionByName(bad)


def touched(loops: DataFrame, ids: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """The ledger with open loops (id) reviewed today, and refusals (id, refusal)."""
    x = _targets(loops, ids.select("id").distinct()).withColumn("refusal", _standing())
    ok = x.where("refusal is null").select("id", *[F.col(f"_have.{c}").alias(c) for c in ("title", "due", "owner", "area", "prio", "since", "done", "note", "next")], F.lit(today).cast("date").alias("touched"))
    return _replaced(loops, ok), x.where("refusal is not null").select("id", "refusal")


def edited(loops: DataFrame, edits: DataFrame, today: str, touch: bool = True) -> tuple[DataFrame, DataFrame]:
    """The ledger after edits (id and any of title, due, owner, area, prio, next, note; due as text), and refusals (id, refusal).

    Null means unchanged.  An edit counts as a review unless `touch` is false.  Edits of unknown and closed loops, edits that change
    nothing and edits after which the line breaks a rule are refused as a whole; of several edits of a loop one is taken.
    """
    named = [c for c in FIELDS if c in edits.columns]
    x = _targets(loops, edits.select("id", *[F.col(c).alias(f"_{c}") for c in named]).dropDuplicates(["id"]))
    nothing = F.lit(True)
    for c in named:
        nothing = nothing & F.col(f"_{c}").isNull()
    bad_due = (F.col("_due").isNotNull() & ledgers.strict_date(F.col("_due")).isNull()) if "due" in named else F.lit(False)
    x = x.withColumn("refusal", F.coalesce(_standing(), F.when(nothing, "nothing to change"), F.when(bad_due, "due: bad date")))
    value = lambda c: F.coalesce(ledgers.strict_date(F.col("_due")) if c == "due" else F.col(f"_{c}"), F.col(f"_have.{c}")) if c in named else F.col(f"_have.{c}")
    ok = x.where("refusal is null").select("id", *[value(c).alias(c) for c in FIELDS], F.col("_have.since").alias("since"), (F.lit(today).cast("date") if touch else F.col("_have.touched")).alias("touched"), F.col("_have.done").alias("done"))
    ok = ok.withColumn("refusal", violation())
    return _replaced(loops, ok.where("refusal is null")), x.where("refusal is not null").select("id", "refusal").unionByName(ok.where("refusal is not null").select("id", "refusal"))


def routed(tasks: DataFrame, current: DataFrame, seen: DataFrame, today: str, source: str) -> DataFrame:
    """Inbox rows (date, text, source, hash) of tasks (text) that neither the inbox nor the seen ledger knows."""
    return ledgers.inbox_additions(tasks, current, seen).select(F.lit(today).cast("date").alias("date"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.lit(source).alias("source"), "hash")


def touched_area(files: DataFrame, areas: DataFrame, day: str) -> DataFrame:
    """Files (path, area, updated, ...) with the date of the areas (area) set; of several files of an area the first by path."""
    first = files.where("area is not null").groupBy("area").agg(F.min("path").alias("_p")).join(areas.select("area").distinct(), "area", "left_semi")
    return files.join(first.select(F.col("_p").alias("path"), F.lit(True).alias("_hit")), "path", "left").withColumn("updated", F.when(F.col("_hit"), F.lit(day)).otherwise(F.col("updated"))).drop("_hit")
