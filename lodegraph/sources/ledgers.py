"""Line-grammar ledgers: open loops, decisions, inboxes and seen sets.

Readers take (path, line_no, line) or texts and give one row per entry with an `error` column; nothing is dropped in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEP = " · "
KEYS = ["due", "owner", "area", "prio", "since", "touched", "done", "note"]
AREAS = ["work", "study", "training", "business", "life", "other"]
OWNER = r"^(owner|agent|waiting:[a-z0-9][a-z0-9-]*)$"


def lines(df: DataFrame, text: str, key: str = "path") -> DataFrame:
    """(key, line_no, line) of texts."""
    return df.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n|\r")).alias("line_no", "line"))


def strict_date(x: Column) -> Column:
    """A date with or without leading zeros, null if it is none."""
    return F.when(F.trim(x).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(F.trim(x), "yyyy-M-d"))


def loops(rows: DataFrame, areas: list[str] = AREAS, owner: str = OWNER) -> DataFrame:
    """Loop lines of (line_no, line): id, title, due, owner, area, prio, since, touched, done, note, next, closed, waiting_on, error.

    `next:` is always last and keeps separators.  Errors name the first thing wrong; other columns are then null where they can't be read.
    Lines that don't open with a box are no loops.
    """
    x = rows.where(F.col("line").rlike(r"^- \[")).withColumn("_ok", F.col("line").rlike(r"^- \[( |x)\] (L-\d{3,}) · .*$"))
    x = x.withColumn("_box", F.regexp_extract("line", r"^- \[( |x)\]", 1)).withColumn("id", F.nullif(F.regexp_extract("line", r"^- \[[ x]\] (L-\d{3,}) · ", 1), F.lit("")))
    rest = F.regexp_replace(F.regexp_replace("line", r"^- \[[ x]\] L-\d{3,} · ", ""), r"\s+$", "")
    x = x.withColumn("_rest", rest).withColumn("_head", F.regexp_replace(F.col("_rest"), r"(?s) · next:? .*$| · next:?$", ""))
    x = x.withColumn("next", F.nullif(F.trim(F.regexp_extract("_rest", r"(?s) · next:? (.*)$", 1)), F.lit(""))).withColumn("_p", F.split("_head", SEP))
    x = x.withColumn("title", F.nullif(F.trim(F.col("_p")[0]), F.lit("")))
    fields = F.slice("_p", 2, F.greatest(F.lit(0), F.size("_p") - 1))
    key = lambda p: F.regexp_replace(F.substring_index(p, " ", 1), ":$", "")
    value = lambda p: F.trim(F.substring(p, F.lit(1) + F.length(F.substring_index(p, " ", 1)), F.length(p)))
    x = x.withColumn("_f", fields)
    bad = F.get(F.filter("_f", lambda p: ~key(p).isin(KEYS)), 0)

    def last_of(k: str) -> Column:
        return F.nullif(value(F.element_at(F.concat(F.array(F.lit("")), F.filter("_f", lambda p: key(p) == k)), -1)), F.lit(""))

    x = x.withColumns({f"_{k}": last_of(k) for k in KEYS})
    dates = {k: strict_date(F.col(f"_{k}")) for k in ("due", "since", "touched", "done")}
    prio = F.when(F.col("_prio").isNull(), 2).when(F.col("_prio").rlike(r"^\d{1,9}$"), F.try_to_number("_prio", F.lit("999999999")).cast("int")).otherwise(-1)
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for c, n in (("_due", "due"), ("_owner", "owner"), ("_area", "area"), ("next", "next"))]), lambda m: m.isNotNull())
    bad_date = F.filter(F.array(*[F.when(F.col(f"_{k}").isNotNull() & d.isNull(), F.lit(k)) for k, d in dates.items()]), lambda m: m.isNotNull())
    closed = dates["done"].isNotNull()
    err = (
        F.when(~F.col("_ok"), F.concat(F.lit("unparseable line: "), F.substring("line", 1, 80)))
        .when(F.col("title").isNull(), "empty title")
        .when(bad.isNotNull(), F.concat(F.lit("unknown field "), key(bad)))
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), missing[0]))
        .when(F.size(bad_date) > 0, F.concat(bad_date[0], F.lit(": bad date")))
        .when((F.col("_box") == "x") != closed, "checkbox and done disagree")
        .when(~F.col("_owner").rlike(owner), "bad owner")
        .when(~F.col("_area").isin(areas), "bad area")
        .when(~prio.between(1, 3), "bad prio")
    )
    return x.select("line_no", "id", "title", dates["due"].alias("due"), F.col("_owner").alias("owner"), F.col("_area").alias("area"), prio.alias("prio"), dates["since"].alias("since"), dates["touched"].alias("touched"), dates["done"].alias("done"), F.coalesce("_note", F.lit("")).alias("note"), "next", closed.alias("closed"), F.nullif(F.regexp_extract(F.coalesce("_owner", F.lit("")), r"^waiting:(.*)$", 1), F.lit("")).alias("waiting_on"), err.alias("error"))


def loop_line() -> Column:
    """The line of a loop row."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    since = F.coalesce("since", "due")
    done = F.when(F.col("done").isNotNull(), F.concat(F.lit(f"{SEP}done "), day(F.col("done")))).otherwise("")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(f"{SEP}note "), F.col("note"))).otherwise("")
    return F.concat(F.lit("- ["), F.when(F.col("done").isNotNull(), "x").otherwise(" "), F.lit("] "), F.col("id"), F.lit(SEP), F.col("title"), F.lit(f"{SEP}due "), day(F.col("due")), F.lit(f"{SEP}owner "), F.col("owner"), F.lit(f"{SEP}area "), F.col("area"), F.lit(f"{SEP}prio "), F.col("prio").cast("string"), F.lit(f"{SEP}since "), day(since), F.lit(f"{SEP}touched "), day(F.coalesce(F.col("touched"), since)), done, note, F.lit(f"{SEP}next: "), F.col("next"))


def written(rows: DataFrame, keep_closed: int = 40) -> DataFrame:
    """(section, pos, line): open loops by priority, due date and id; the newest closed ones first, `keep_closed` of them."""
    o = rows.where("done is null").withColumn("pos", F.row_number().over(W.orderBy("prio", "due", "id"))).select(F.lit("open").alias("section"), "pos", loop_line().alias("line"))
    c = rows.where("done is not null").orderBy(F.desc("done"), F.desc("id")).limit(keep_closed).withColumn("pos", F.row_number().over(W.orderBy(F.desc("done"), F.desc("id")))).select(F.lit("closed").alias("section"), "pos", loop_line().alias("line"))
    return o.unionByName(c)  # a ledger is one person's file; its order is global by nature


def next_ids(existing: DataFrame, new: DataFrame, prefix: str = "L", order: str = "pos") -> DataFrame:
    """New rows with ids after the largest of the ledger, closed ones included."""
    top = existing.agg(F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("int")), F.lit(0)).alias("_top")).withColumn("_one", F.lit(1))
    n = new.withColumn("_r", F.row_number().over(W.orderBy(order))).withColumn("_one", F.lit(1))
    return n.join(top, "_one").withColumn("id", F.format_string(f"{prefix}-%03d", (F.col("_top") + F.col("_r")).cast("int"))).drop("_top", "_r", "_one")


def decisions(rows: DataFrame) -> DataFrame:
    """Entries of (line_no, line): `## D-nnn · date · title` and their `- field: text` lines; prose between is tolerated.

    The heading an entry belongs to is carried down by a window, the fields are pivoted.
    """
    head = r"^## (D-\d{3,}) · (\S+) · (.*)$"
    x = rows.withColumn("_id", F.when(F.col("line").rlike(r"^## "), F.regexp_extract("line", head, 1)))
    x = x.withColumn("id", F.last("_id", ignorenulls=True).over(W.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))  # one file
    heads = x.where(F.col("_id").isNotNull()).select(F.col("_id").alias("id"), F.col("line_no").alias("at"), strict_date(F.regexp_extract("line", head, 2)).alias("date"), F.nullif(F.trim(F.regexp_extract("line", head, 3)), F.lit("")).alias("title"))
    f = x.where(F.col("line").rlike(r"^- (decision|why|rejected|revisit|source): ")).select("id", F.regexp_extract("line", r"^- (\w+): ", 1).alias("k"), F.trim(F.regexp_extract("line", r"^- \w+: (.*)$", 1)).alias("v"))
    wide = f.groupBy("id").pivot("k", ["decision", "why", "rejected", "revisit", "source"]).agg(F.max("v"))
    out = heads.where("id <> ''").join(wide, "id", "left")
    return out.withColumn("error", F.when(F.col("date").isNull(), "bad date").when(F.col("title").isNull(), "empty title").when(F.col("decision").isNull(), "missing decision"))


def decision_text() -> Column:
    """The block of an entry."""
    f = lambda k: F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(F.lit(f"\n- {k}: "), F.col(k))).otherwise("")
    return F.concat(F.lit("## "), F.col("id"), F.lit(SEP), F.date_format("date", "yyyy-MM-dd"), F.lit(SEP), F.col("title"), *[f(k) for k in ("decision", "why", "rejected", "revisit", "source")])


def inbox(rows: DataFrame) -> DataFrame:
    """(date, text, source) of `- date · text · source` lines."""
    rx = r"^- (\d{4}-\d{2}-\d{2}) · (.*?)(?: · ([^·]*))?$"
    return rows.where(F.col("line").rlike(rx)).select("line_no", strict_date(F.regexp_extract("line", rx, 1)).alias("date"), F.trim(F.regexp_extract("line", rx, 2)).alias("text"), F.trim(F.regexp_extract("line", rx, 3)).alias("source"))


def inbox_additions(new: DataFrame, current: DataFrame, seen: DataFrame) -> DataFrame:
    """New tasks (text) whose identity is neither in the inbox nor in the seen ledger (hash), each once."""
    from ..functions.text import inbox_key

    n = new.withColumn("hash", inbox_key(F.col("text"))).dropDuplicates(["hash"])
    known = current.select(inbox_key(F.col("text")).alias("hash")).unionByName(seen.select("hash")).distinct()
    return n.join(known, "hash", "left_anti")


def json_lines(rows: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """Rows of JSON lines; bad ones are skipped."""
    return rows.select(F.from_json(F.col(line), schema, {"mode": "PERMISSIVE"}).alias("j"), F.col(line).alias("_l")).where(F.col("_l").rlike(r"^\s*\{.*\}\s*$")).select("j.*")
