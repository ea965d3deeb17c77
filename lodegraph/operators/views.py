"""Views of ledgers and area files, what is wrong with their sources, and whether a stored view is behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import ledgers
from .ledger import due_text, mentions

# Marks around the block of loops in a hand-written view, and lines of an area that a view shows.
START, END = "<!-- loops:start -->", "<!-- loops:end -->"
MOST_LINES = 4


def open_loops(loops: DataFrame) -> DataFrame:
    """(pos, line) of open loops by priority, due date and id."""
    o = loops.where("done is null and error is null")
    pos = F.row_number().over(W.orderBy("prio", "due", "id"))  # one ledger
    return o.select(pos.alias("pos"), F.concat(F.col("title"), F.lit(" (due "), F.date_format("due", "yyyy-MM-dd"), F.lit(", "), F.col("owner"), F.lit(") "), F.col("id")).alias("line"))


def block(loops: DataFrame, owner: str = "owner") -> DataFrame:
    """(pos, line) of the block of loops in a view: those that wait for nobody, then one line of those that wait; a line that says so if there is none."""
    o = loops.where("done is null and error is null")
    by = W.orderBy("prio", "due", "id")  # one ledger
    who = F.when(F.col("owner") == owner, "").otherwise(F.concat(F.lit(" · "), F.col("owner")))
    act = o.where("waiting_on is null").select(F.row_number().over(by).alias("pos"), F.concat(F.lit("- **"), F.col("title"), F.lit("** — due "), due_text(F.col("due")), F.lit(" · P"), F.col("prio").cast("string"), who, F.lit(" · next: "), F.col("next"), F.lit("  `"), F.col("id"), F.lit("`")).alias("line"))
    one = F.concat(F.col("waiting_on"), F.lit(" — "), F.col("title"), F.lit(" (by "), due_text(F.col("due")), F.lit(") `"), F.col("id"), F.lit("`"))
    wait = o.where("waiting_on is not null").agg(F.array_sort(F.collect_list(F.struct("prio", "due", "id", one.alias("t")))).alias("w")).where(F.size("w") > 0)  # one line of the view
    wait = wait.select(F.lit(2**31 - 1).alias("pos"), F.concat(F.lit("- ⏳ **Waiting on:** "), F.array_join(F.transform("w", lambda s: s["t"]), "; ")).alias("line"))
    none = o.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("pos"), F.lit("- (no open loops)").alias("line"))
    return act.unionByName(wait).unionByName(none)


def with_block(text: Column, lines: Column) -> Column:
    """The text with the lines between its two marks; a text without both stays."""
    head, rest = F.substring_index(text, START, 1), F.substring(text, F.length(F.substring_index(text, START, 1)) + len(START) + 1, F.length(text))
    tail = F.substring(rest, F.length(F.substring_index(rest, END, 1)) + len(END) + 1, F.length(rest))
    return F.when(text.contains(START) & rest.contains(END), F.concat(head, F.lit(START + "\n"), lines, F.lit("\n" + END), tail)).otherwise(text)


def staleness(text: Column, lines: Column) -> Column:
    """Why a stored view is behind its ledger; empty if it isn't."""
    return F.when(text.isNull(), "view missing").when(~(text.contains(START) & text.contains(END)), "view has no marks").when(with_block(text, lines) == text, "").otherwise("view is out of date")


def area_lines(areas: DataFrame, order: list[str] = ledgers.AREAS) -> DataFrame:
    """(area, pos, line) of area files (path, area, title, updated, body): a heading with the date and the first lines of the `## Now` block; known areas first, of several files of one the first by path."""
    first = areas.where("area is not null").groupBy("area").agg(F.min_by(F.struct("path", "title", "updated", "body"), "path").alias("f")).select("area", "f.*")
    day = ledgers.strict_date(F.col("updated"))
    head = F.concat(F.lit("### "), F.coalesce("title", "area"), F.lit(" · updated "), F.coalesce(due_text(day), F.lit("?")))
    now = F.slice(X.now_block(F.col("body")), 1, MOST_LINES)
    now = F.when(F.size(now) > 0, now).otherwise(F.array(F.concat(F.lit("- (no `## Now` block in "), F.col("path"), F.lit(")"))))
    return first.select("area", F.posexplode(F.concat(F.array(head), now)).alias("pos", "line"))


def lint(areas: DataFrame, logs: DataFrame, today: str, known: list[str] = ledgers.AREAS) -> DataFrame:
    """(level, path, message) of area files (path, area, title, updated, body, aliases): keys that are missing, unknown or taken, bad dates, blocks that are missing or too long, and files that later logs (date, text) mention."""
    n = F.size(X.now_block(F.col("body")))
    first = areas.where("area is not null").groupBy("area").agg(F.min("path").alias("_first"))
    x = areas.join(first, "area", "left").withColumn("day", ledgers.strict_date(F.col("updated")))
    row = lambda level, text: F.struct(F.lit(level).alias("level"), text.alias("message"))
    found = F.filter(F.array(
        F.when(F.col("area").isNull(), row("error", F.lit("needs an area"))), F.when(F.col("area").isNotNull() & ~F.col("area").isin(known), row("error", F.concat(F.lit("unknown area "), F.col("area")))),
        F.when(F.col("path") != F.col("_first"), row("error", F.concat(F.lit("area "), F.col("area"), F.lit(" is taken by "), F.col("_first")))), F.when(F.col("area").isNotNull() & F.col("day").isNull(), row("error", F.lit("updated: bad date"))),
        F.when(F.col("area").isNotNull() & F.col("day").isNotNull() & (n == 0), row("warning", F.lit("no `## Now` block"))), F.when(F.col("day").isNotNull() & (n > MOST_LINES), row("warning", F.concat(F.lit("`## Now` has "), n.cast("string"), F.lit(" lines")))),
    ), lambda r: r.isNotNull())
    out = x.select("path", F.explode(found).alias("r")).select("r.level", "path", "r.message")
    alias = x.where("area is not null and day is not null").select("path", F.col("day").alias("updated"), F.explode(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("area")))).alias("alias"))
    hit = mentions(alias.select(F.col("path").alias("area"), "updated", "alias"), logs, today).groupBy("area").agg(F.count_distinct("log_date").alias("n"))
    return out.unionByName(hit.select(F.lit("warning").alias("level"), F.col("area").alias("path"), F.concat(F.lit("mentioned on "), F.col("n").cast("string"), F.lit(" later days")).alias("message")))
