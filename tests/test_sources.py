import json

from pyspark.sql import functions as F

from lodegraph.operators import ledger as L
from lodegraph.sources import ledgers, markdown, portable
from lodegraph.sources.transcript import user_pieces

NOW = 1780272000.0
GOOD = "- [ ] L-003 · Send form · due 2026-06-03 · owner owner · area work · prio 1 · since 2026-05-01 · touched 2026-05-20 · next: call · then send"


def rows(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def test_loop_round_trip_and_errors(spark):
    lines = [
        GOOD, GOOD.replace("L-003", "L-004").replace("- [ ]", "- [x]"), GOOD.replace("due 2026-06-03", "due soon"), GOOD.replace(" · area work", ""), GOOD.replace("prio 1", "colour red"), "- [ ] nonsense", "prose", "",
        GOOD.replace("owner owner", "owner waiting:person-a").replace("- [ ]", "- [x]").replace(" · next", " · done 2026-6-1 · next"), GOOD.replace("prio 1", "prio 9"), GOOD.replace("Send form", " "),
    ]
    got = {r["line_no"]: r for r in ledgers.loops(rows(spark, lines)).collect()}
    assert got[0]["error"] is None and got[0]["next"] == "call · then send" and str(got[0]["due"]) == "2026-06-03"
    assert got[1]["error"] == "checkbox and done disagree"
    assert got[2]["error"] == "due: bad date" and got[3]["error"] == "missing area" and got[4]["error"] == "unknown field colour"
    assert got[5]["error"].startswith("unparseable line") and 6 not in got and 7 not in got
    assert got[8]["error"] is None and got[8]["waiting_on"] == "person-a" and str(got[8]["done"]) == "2026-06-01"
    assert got[9]["error"] == "bad prio" and got[10]["error"] == "empty title"
    back = ledgers.loops(rows(spark, [GOOD])).select(ledgers.loop_line().alias("l")).first()["l"]
    assert back == GOOD
    assert ledgers.loops(rows(spark, [])).count() == 0


def test_lint_and_card(spark):
    lines = [GOOD, GOOD, GOOD.replace("L-003", "L-005").replace("due 2026-06-03", "due 2026-05-03").replace("owner owner", "owner waiting:x")]
    r = ledgers.loops(rows(spark, lines))
    found = {(x["id"], x["message"]) for x in L.lint_loops(r, "2026-06-01").collect()}
    assert ("L-003", "duplicate id L-003") in found and ("L-005", "overdue by 29d") in found and ("L-005", "waiting on x for 12d") in found and ("L-003", "untouched for 12d") in found
    card = [(x["section"], x["line"]) for x in L.card(r, "2026-06-01").collect()]
    assert ("FOOTER", "3 open loops, 0 beyond the horizon") in card and any(s == "WAITING" and "nudge" in t for s, t in card)
    assert len(L.brief(r, "2026-06-01", 60).first()["line"]) <= 60


def test_decisions(spark):
    text = "# Decisions\nprose\n## D-001 · 2026-05-01 · Use parquet\n- decision: yes\n- why: columns\n\n## D-003 · 2026-04-01 · Later\n- decision: no\n## D-004 · nodate · Bad\n- decision: x"
    d = ledgers.decisions(rows(spark, text.split("\n")))
    got = {r["id"]: r for r in d.collect()}
    assert got["D-001"]["why"] == "columns" and got["D-001"]["error"] is None and got["D-004"]["error"] == "bad date"
    assert {(r["id"], r["message"]) for r in L.lint_decisions(d).collect()} == {("D-003", "expected number 2"), ("D-003", "date goes back"), ("D-004", "expected number 3")}


def test_inbox_and_seen(spark):
    i = ledgers.inbox(rows(spark, ["- 2026-05-01 · do this · that · mail", "- 2026-05-02 · alone", "junk"]))
    assert {(r["text"], r["source"]) for r in i.collect()} == {("do this · that", "mail"), ("alone", "")}
    new = spark.createDataFrame([("Do This!",), ("do  this",), ("Other",), ("alone.",)], "text string")
    seen = new.where("text = 'Other'").select(F.lit("x").alias("hash"))
    assert ledgers.inbox_additions(new, i.where("text = 'alone'"), seen).count() == 2
    assert ledgers.json_lines(rows(spark, ['{"k": "a"}', "{bad", ""]), "k string").count() == 1
    first = ledgers.next_ids(spark.createDataFrame([("L-007",)], "id string"), spark.createDataFrame([(1, "a"), (2, "b")], "pos int, t string"))
    assert [r["id"] for r in first.orderBy("pos").collect()] == ["L-008", "L-009"]


def test_front_matter_and_records(spark):
    files = [
        ("people/person-a.md", "---\nname: Person A\ntype: person\naliases: [PA, 'A. Person']\nupdated: 2026-05-01\norg: Org A\n---\n# Heading\nWorks at orgs/org-a.md and people/person-a.md.\n"),
        ("docs/plain-note.md", "no header\n\n## Part\ntext"), ("docs/bad.md", "---\nbroken\n---\nbody"), ("docs/empty.md", ""), ("docs/null.md", None),
    ]
    r = {x["path"]: x for x in markdown.records(spark.createDataFrame(files, "path string, text string")).collect()}
    a = r["people/person-a.md"]
    assert (a["title"], a["kind"], a["aliases"], a["updated"], a["links"]) == ("Person A", "person", ["PA", "A. Person", "Org A"], "2026-05-01", ["orgs/org-a.md"])
    assert r["docs/plain-note.md"]["title"] == "plain note" and r["docs/plain-note.md"]["summary"] == "no header text" and not r["docs/plain-note.md"]["has_frontmatter"]
    assert r["docs/bad.md"]["problem"] and r["docs/bad.md"]["tokens"] and "docs/null.md" not in r and r["docs/empty.md"]["tokens"] == ["empty"]


def test_directory(spark, tmp_path):
    for p in ("people/a.md", "NOW.md", ".git/x.md", "graph/g.md", "b.md", "people/README.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"# {p}\n")
    got = {r["path"]: r["text"] for r in markdown.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"people/a.md", "b.md", "people/README.md"} and got["b.md"] == "# b.md\n"


def test_transcript(spark):
    def line(content, **more):
        return json.dumps({"type": "user", "message": {"role": "user", "content": content}} | more)

    lines = [line("hello there"), line([{"type": "text", "text": "block"}, {"type": "tool_result", "text": "no"}]), line("meta", isMeta=True), line("<system-reminder> x"), "{broken", line("old", timestamp="2026-05-01T00:00:00Z"), line("new", timestamp="2026-05-31T23:00:00Z"), json.dumps({"type": "assistant", "message": {"content": "a"}}), line(""), line(None)]
    got = {(r["text"], r["stale"]) for r in user_pieces(rows(spark, lines), NOW).collect()}
    assert got == {("hello there", False), ("block", False), ("old", True), ("new", False)}


def test_html_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("<p>A &amp; B</p><script>x</script><!-- c --> <b>C</b>",), (None,)], "h string")
    assert [r[0] for r in df.select(portable.html_text(F.col("h"))).collect()] == ["A & B C", ""]
    root = str(tmp_path / "snap")
    for v in ("001", "002", "003"):
        portable.snapshot(spark.createDataFrame([(v,)], "v2 string"), root, v, keep=2)
    assert portable.latest(spark, root).first()["v2"] == "003" and len(list((tmp_path / "snap").glob("v=*"))) == 2


def test_export_of_infinity(spark):
    df = spark.createDataFrame([("a", float("inf"), [1.0], "p")], "id string, half_life_days double, embedding array<double>, path string")
    j = json.loads(portable.export_rows(df).first()["json"])
    assert j == {"id": "a", "half_life_days": None, "embedding": [1.0]}
    assert portable.import_rows(spark.createDataFrame([('{"x": Infinity}',)], "json string"), "x double").first()["x"] == float("inf")
