"""Ledger changes, ledgers by meaning, views, structure and the store on small fixtures, with nulls, empty tables and clashing columns."""

import datetime

from pyspark.sql import functions as F

from lodegraph.operators import ledger_changes as C
from lodegraph.operators import ledger_index, structure, views

DAY = datetime.date(2026, 6, 1)
LOOP = "id string, title string, due date, owner string, area string, prio int, since date, touched date, done date, note string, next string"


def ledger(spark):
    row = lambda i, **m: (i, m.get("title", "T"), DAY, m.get("owner", "owner"), m.get("area", "work"), m.get("prio", 2), DAY, DAY, m.get("done"), "", m.get("next", "go"))
    return spark.createDataFrame([row("L-001"), row("L-002", done=DAY), row("L-009", owner="waiting:ann", prio=1)], LOOP)


def test_added_loops(spark):
    new = spark.createDataFrame([("a", "New", DAY, "owner", "work", None, "step", 1), ("b", "", DAY, "owner", "work", 1, "s", 1), ("c", "X", None, "owner", "work", 1, "s", 1), ("d", "X · y", DAY, "agent", "life", 1, "s", 1), ("e", "X", DAY, "agent", "life", 1, " ", 1), ("f", "Last", DAY, "waiting:bo", "other", 3, "s", 1)], "pos string, title string, due date, owner string, area string, prio int, next string, refused int")
    ok, no = C.added(ledger(spark), new, "2026-06-02")
    assert {(r["id"], r["title"], r["prio"], str(r["since"])) for r in ok.collect()} == {("L-010", "New", 2, "2026-06-02"), ("L-011", "Last", 3, "2026-06-02")}
    assert {r["pos"]: r["refusal"] for r in no.collect()} == {"b": "title is empty", "c": "due: bad date", "d": "a text holds a separator or line end", "e": "next action is empty"}
    assert C.added(ledger(spark).where("false"), new.limit(1), "2026-06-02")[0].first()["id"] == "L-001"


def test_closed_touched_edited(spark):
    ids = spark.createDataFrame([("L-001", "why"), ("L-002", None), ("L-777", None), ("L-001", "why")], "id string, note string")
    out, no = C.closed(ledger(spark), ids, "2026-06-03")
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 3 and str(got["L-001"]["done"]) == "2026-06-03" and got["L-001"]["note"] == "why" and got["L-009"]["done"] is None
    assert {tuple(r) for r in no.collect()} == {("L-002", "closed already"), ("L-777", "unknown loop")}
    out, no = C.touched(ledger(spark), ids, "2026-06-04")
    assert {r["id"]: str(r["touched"]) for r in out.collect()}["L-001"] == "2026-06-04" and no.count() == 2
    e = spark.createDataFrame([("L-001", "2026-7-1", None), ("L-009", None, 7), ("L-002", None, 1), ("L-005", None, 1)], "id string, due string, prio int")
    out, no = C.edited(ledger(spark), e, "2026-06-05")
    assert {r["id"]: str(r["due"]) for r in out.collect()}["L-001"] == "2026-07-01" and {tuple(r) for r in no.collect()} == {("L-009", "bad prio"), ("L-002", "closed already"), ("L-005", "unknown loop")}
    kept, no = C.edited(ledger(spark), spark.createDataFrame([("L-001", None, None)], "id string, due string, prio int"), "2026-06-05", touch=False)
    assert no.first()["refusal"] == "nothing to change" and kept.count() == 3 and C.closed(ledger(spark).where("false"), ids, "2026-06-03")[0].count() == 0


def test_ledgers_by_meaning(spark):
    dec = spark.createDataFrame([("D-001", DAY, "Boats", "no more harbour fees", "cost", "", "—", "s")], "id string, date date, title string, decision string, why string, rejected string, revisit string, source string")
    r = ledger_index.records(ledger(spark), dec)
    assert r.count() == 4
    asked = ledger_index.embedded(r, r.where("key <> 'L-009'").select("key", F.when(F.col("key") == "L-001", "old").otherwise(F.col("sha")).alias("sha"), F.array(F.lit(1.0).cast("float")).alias("embedding")), lambda t: [[2.0]] * len(t))
    assert {x["key"]: (x["status"], x["embedding"]) for x in asked.collect()} == {"L-001": ("updated", [2.0]), "L-002": ("unchanged", [1.0]), "L-009": ("added", [2.0]), "D-001": ("unchanged", [1.0])}
    near = spark.createDataFrame([("L-009", 0.9), ("D-001", 0.8)], "key string, cosine double")
    c = ledger_index.context(ledger(spark), dec, "harbour", near).collect()
    assert [(x["kind"], x["id"]) for x in sorted(c, key=lambda x: (x["kind"], x["pos"]))] == [("decision", "D-001"), ("loop", "L-009")]
    assert ledger_index.context(ledger(spark).where("false"), dec.where("false"), "x").count() == 0


def test_views(spark):
    lg = ledger(spark).withColumn("error", F.lit(None).cast("string")).withColumn("waiting_on", F.nullif(F.regexp_extract("owner", "^waiting:(.*)$", 1), F.lit("")))
    assert [r["line"] for r in views.open_loops(lg).orderBy("pos").collect()] == ["T (due 2026-06-01, waiting:ann) L-009", "T (due 2026-06-01, owner) L-001"]
    assert [r["line"] for r in views.block(lg.where("false")).collect()] == ["- (no open loops)"] and views.block(lg).count() == 2
    t = spark.createDataFrame([(f"a{views.START}\nx\n{views.END}z",), (f"a{views.START}\nnew\n{views.END}z",), ("plain",), (None,)], "t string")
    got = [tuple(r) for r in t.select(views.with_block(F.col("t"), F.lit("new")), views.staleness(F.col("t"), F.lit("new"))).collect()]
    assert got == [(f"a{views.START}\nnew\n{views.END}z", "view is out of date"), (f"a{views.START}\nnew\n{views.END}z", ""), ("plain", "view has no marks"), (None, "view missing")]
    files = spark.createDataFrame([("areas/a.md", "work", "Work", "2026-05-01", "## Now\n- 1\n- 2\n- 3\n- 4\n- 5\n", ["job"]), ("areas/b.md", "work", "W", "soon", "no block", None), ("areas/c.md", None, "C", "", "", []), ("areas/d.md", "moon", "M", "2026-05-01", "", [])], "path string, area string, title string, updated string, body string, aliases array<string>")
    logs = spark.createDataFrame([(datetime.date(2026, 5, 3), "The JOB again."), (datetime.date(2026, 4, 1), "job"), (None, "job"), (datetime.date(2026, 5, 4), None)], "date date, text string")
    got = {(r["path"], r["message"]) for r in views.lint(files, logs, "2026-06-01").collect()}
    assert got == {("areas/a.md", "`## Now` has 5 lines"), ("areas/a.md", "mentioned on 1 later days"), ("areas/b.md", "area work is taken by areas/a.md"), ("areas/b.md", "updated: bad date"), ("areas/c.md", "needs an area"), ("areas/d.md", "unknown area moon"), ("areas/d.md", "no `## Now` block")}
    assert views.area_lines(files).where("area = 'work'").count() == 5 and views.area_lines(files.where("false")).count() == 0


def test_subgroups_need_members_and_a_crowd(spark):
    n = spark.createDataFrame([("c", "Cat", "category", 0), ("g", "old group", "category", 0)] + [(f"n{i}", f"N{i}", "fact", 0) for i in range(14)], "id string, name string, type string, archived int")
    e = spark.createDataFrame([(f"n{i}", "c", "part_of") for i in range(14)], "source_id string, target_id string, relation string")
    plan = spark.createDataFrame([("c", "Old Group", "n0"), ("c", "Old Group", "N1 "), ("c", "Lone", "n2"), ("c", "cat", "n3"), ("c", "cat", "n4"), ("c", "New", "n5"), ("c", "New", "n6"), ("c", "New", "nobody"), ("g", "New", "n7")], "category_id string, group string, member string")
    new, moved = structure.subgrouped(n, e, plan)
    assert [tuple(r) for r in new.collect()] == [("category:new", "New")] and {(r["child"], r["new"]) for r in moved.collect()} == {("n0", "g"), ("n1", "g"), ("n5", "category:new"), ("n6", "category:new")}
    assert structure.subgrouped(n, e.limit(12), plan)[1].count() == 0
