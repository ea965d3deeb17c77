"""Folds over loops and lines: the brief and the excerpts."""

import pytest
from pyspark.sql import functions as F

from lodegraph import workspace
from lodegraph.functions import vocab
from lodegraph.operators import ledger as L

LOOP = "id string, title string, due date, prio int, next string, touched date, since date, waiting_on string, done date, error string"


def loop(i, title, due, step="", touched="2026-05-31", **more):
    import datetime

    day = lambda s: datetime.date.fromisoformat(s) if s else None
    return (f"L-{i:03}", title, day(due), more.get("prio", 2), step, day(touched), day("2026-05-01"), more.get("waiting"), day(more.get("done")), more.get("error"))


def line(spark, rows, limit=200):
    return L.brief(spark.createDataFrame(rows, LOOP), "2026-06-01", limit).first()["line"]


def test_brief(spark):
    assert line(spark, []) == "No open loops."
    assert line(spark, [loop(1, "a", "2026-06-01", waiting="x"), loop(2, "b", "2026-06-01", done="2026-06-01"), loop(3, "c", "2026-06-01", error="bad")]) == "No open loops."
    rows = [loop(2, "Later", "2026-06-05", "call"), loop(1, "Now", "2026-06-01", "write the letter"), loop(3, "Late", "2026-05-30", touched="2026-05-20")]
    assert line(spark, rows) == "Late (overdue 2d, untouched 12d) · Now (today): write the letter · Later (4d): call"
    assert line(spark, rows, 60) == "Late (overdue 2d, untouched 12d) · Now (today): write the l…"  # the third has no room
    assert line(spark, [loop(1, "T" * 90, "2026-06-01", "x")], 40) == "T" * 39 + "…"
    assert line(spark, [loop(1, "Now", "2026-06-01", "word " * 40)], 40) == "Now (today): word word word word word w…"
    # no more than fit is folded, and the order is by due date, priority and id
    many = [loop(i, "x", "2026-06-02", prio=1 + i % 3) for i in range(300)]
    assert line(spark, many, 80) == " · ".join(["x (1d)"] * 9)


def test_excerpts(spark):
    filler = "plain words stand here and say nothing at all. " * 30
    body = f"  Opening line.\n{filler}\nThe harbour was calm.\n{'far ' * 300}harbour {'away ' * 300}\nno hit\nOld harbours end.\n"
    df = spark.createDataFrame([("a", body), ("b", "short harbour"), ("c", None)], "path string, body string")
    got = {r["path"]: r["excerpt"] for r in L.excerpts(df, ["harbour"], 900).collect()}
    head, hits = got["a"].split("\n…\n")
    assert got["b"] == "short harbour" and got["c"] == "" and head.startswith("Opening line.") and head.endswith(" …") and len(head) <= 450
    first, second = hits.split("\n")
    assert first == "The harbour was calm." and "harbour" in second and second.startswith("…") and second.endswith("…") and len(got["a"]) <= 904
    new = {r["path"]: r["excerpt"] for r in L.excerpts(df, ["harbour"], 2600, newest_first=True).collect()}["a"]
    assert new.startswith("Old harbours end.\n") and "harbour" in new.split("\n")[1] and len(new) <= 2602
    few = spark.createDataFrame([("a", filler + "\nold harbour\nnew harbour")], "path string, body string")
    assert L.excerpts(few, ["harbour"], 400, newest_first=True).first()["excerpt"].split("\n")[:3] == ["new harbour", "old harbour", "…"]
    assert L.excerpts(few, [], 100).first()["excerpt"].endswith(" …") and L.excerpts(few, ["absent"], 100, newest_first=True).first()["excerpt"].endswith(" …")


def test_fixed_tables():
    """Values that must hold, against literals: queries and their SQL share these tables."""
    assert vocab.TYPE_OF["hobby"] == "concept" and vocab.TYPE_OF["place"] == "fact" and vocab.TYPE_OF["habit"] == "skill" and len(vocab.TYPE_OF) == 18
    assert vocab.HALF_LIFE_DAYS == {"task": 5, "event": 7, "fact": 21, "artifact": 30, "concept": 60, "insight": 90, "skill": 180, "project": 365, "person": float("inf"), "organization": float("inf"), "category": float("inf")}
    assert len(vocab.RELATIONS) == 13 and vocab.FRAGMENTS[0][0] == "part_of" and vocab.FRAGMENTS[-2][0] == "used_in"


def test_workspace_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError):
        workspace.shared_folder(Session())
    with workspace.scope():
        ws = workspace.Workspace(spark, "t")
        kept = ws.save(spark.range(3))
        assert kept.count() == 3
    import os

    assert not os.path.exists(ws.root.removeprefix("file://"))


def test_mentions_look_for_each_alias_once(spark):
    """Areas of one alias share its search: they meet days, not texts."""
    areas = spark.createDataFrame([("a", "2026-01-01", "The Lamp"), ("b", "2026-01-03", "the lamp"), ("c", "2026-01-01", "the lam"), ("d", "2026-01-01", None), ("e", "2026-01-01", "x.y")], "area string, updated string, alias string").withColumn("updated", F.to_date("updated"))
    logs = spark.createDataFrame([("2026-01-02", "see the lamp."), ("2026-01-02", "see THE LAMP"), ("2026-01-04", "the lamp, again"), ("2026-01-05", "the lamps"), ("2026-01-06", "x.y"), ("2026-01-07", "xzy"), ("2026-02-01", "the lamp"), ("2026-01-08", None)], "date string, text string").withColumn("date", F.to_date("date"))
    got = L.mentions(areas, logs, "2026-02-01")
    assert sorted((r["area"], str(r["log_date"])) for r in got.collect()) == [("a", "2026-01-02"), ("a", "2026-01-04"), ("b", "2026-01-04"), ("e", "2026-01-06")]
    searches = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RLIKE" in x]
    assert searches and not any("updated" in x for x in searches)
