import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.operators import decaying, graph, index, ingest, mutate, search
from lodegraph.operators import integrity as I
from lodegraph.streaming import capture

NOW = 1780272000.0
DAY = 86400.0
NODES = "id string, name string, type string, content string, source string, created_at double, last_accessed double, access_count int, weight double, confidence double, importance double, half_life_days double, archived int, embedding array<float>, path string, last_decayed double"
EDGES = "id string, source_id string, target_id string, relation string, weight double, created_at double, last_reinforced double, reinforcement_count int, last_decayed double"


def nodes(spark, *rows):
    out = []
    for r in rows:
        d = dict(id="", name="", type="concept", content=None, source=None, created_at=NOW - 100 * DAY, last_accessed=NOW, access_count=0, weight=1.0, confidence=0.8, importance=0.5, half_life_days=60.0, archived=0, embedding=None, path=None, last_decayed=NOW) | r
        d["name"] = d["name"] or d["id"]
        out.append(tuple(d[c.split()[0]] for c in NODES.split(", ")))
    return spark.createDataFrame(out, NODES)


def edges(spark, *rows):
    out = []
    for i, (s, t, r, *more) in enumerate(rows):
        d = dict(id=f"e{i}", source_id=s, target_id=t, relation=r, weight=1.0, created_at=float(i), last_reinforced=NOW, reinforcement_count=1, last_decayed=NOW) | (more[0] if more else {})
        out.append(tuple(d[c.split()[0]] for c in EDGES.split(", ")))
    return spark.createDataFrame(out, EDGES)


@pytest.fixture(scope="module")
def broken(spark):
    n = nodes(
        spark,
        dict(id="owner", name="Owner", type="person"), dict(id="c1", type="category"), dict(id="c2", type="category"), dict(id="c3", type="category"), dict(id="f1", type="fact"), dict(id="m1"), dict(id="m2"), dict(id="orph"), dict(id="under"), dict(id="x"), dict(id="y"),
        dict(id="t", type="task"), dict(id="kid"), dict(id="pa", name="Ann", type="person"), dict(id="pb", name="Ann Example", type="person"),
    )
    e = edges(
        spark,
        ("c1", "owner", "part_of"), ("c3", "f1", "part_of"), ("f1", "c1", "part_of"), ("m1", "c1", "part_of"), ("m1", "c2", "part_of"), ("m2", "c1", "part_of"), ("m2", "m1", "part_of"), ("under", "owner", "part_of"), ("x", "y", "part_of"), ("y", "x", "part_of"),
        ("kid", "f1", "part_of"), ("m1", "gone", "uses"), ("m1", "m2", "relates_to"), ("pa", "m1", "studied_by"), ("m1", "c1", "relates_to"), ("pa", "c1", "part_of"), ("pb", "c1", "part_of"), ("t", "c1", "part_of"),
    )
    return n, e


def test_findings(broken):
    n, e = broken
    got = {(r["finding"], r["id"]) for r in I.parent_findings(n, e, "owner").where("finding <> 'missing_embedding'").collect()}
    assert got == {("unrooted_category", "c2"), ("category_bad_parent", "c3"), ("orphan", "orph"), ("multi_parent", "m1"), ("multi_parent", "m2"), ("under_identity", "under"), ("legacy_task", "t")}
    assert [r["id"] for r in I.dangling(n, e).collect()] == ["e11"]
    assert {r["id"] for r in I.redundant_links(e).collect()} == {"e12", "e14"}
    assert [r["id"] for r in I.misoriented(n, e).collect()] == ["e13"]
    assert [r["id"] for r in I.category_links(n, e).collect()] == ["e14"]
    assert [(r["id"], r["n_children"]) for r in I.fact_parents(n, e).collect()] == [("f1", 2)]
    assert {(r["a"], r["b"], r["reason"]) for r in I.name_duplicates(n).collect()} == {("pa", "pb", "subset")}


def test_repair_is_complete_and_idempotent(broken):
    n, e = broken
    fixed, audit = I.repaired(n, e, "owner", "c1")
    counts = {r["step"]: r["n"] for r in audit.collect()}
    assert counts["dangling"] == 1 and counts["oriented"] == 1 and counts["redundant_links"] == 2 and counts["cycles"] == 1
    left = {r["finding"] for r in I.parent_findings(n, fixed, "owner").collect()} - {"missing_embedding", "legacy_task"}
    assert not left
    again, audit2 = I.repaired(n, fixed, "owner", "c1")
    assert all(r["n"] == 0 for r in audit2.collect())
    key = lambda df: sorted((r["source_id"], r["target_id"], r["relation"]) for r in df.collect())
    assert key(again) == key(fixed)


def test_decay_cases(spark):
    old = dict(last_accessed=NOW - 3650 * DAY, last_decayed=NOW - 3650 * DAY)
    n = nodes(
        spark,
        dict(id="half", importance=0.0, last_accessed=NOW - 60 * DAY, last_decayed=NOW - 60 * DAY), dict(id="ever", type="person", half_life_days=float("inf"), **old), dict(id="gone", archived=1, last_accessed=NOW - 8 * DAY), dict(id="stays", archived=1, last_accessed=NOW - 6 * DAY),
        dict(id="event", type="event", half_life_days=7.0, importance=0.1, last_accessed=NOW - 45 * DAY, last_decayed=NOW - 45 * DAY), dict(id="floor", type="event", half_life_days=7.0, importance=0.9, **old), dict(id="nulls", last_decayed=None, importance=None),
    )
    e = edges(spark, ("half", "ever", "part_of", dict(last_reinforced=NOW - 3650 * DAY, last_decayed=None)), ("half", "ever", "uses", dict(last_reinforced=NOW - 3650 * DAY, last_decayed=None)), ("half", "gone", "part_of"))
    a, b, audit = decaying.run(n, e, NOW)
    w = {r["id"]: (r["weight"], r["archived"]) for r in a.collect()}
    assert w["half"] == (pytest.approx(0.5), 0) and w["ever"] == (1.0, 0) and "gone" not in w and w["stays"][1] == 1 and w["event"][1] == 1 and w["floor"] == (pytest.approx(0.135), 0)
    assert [(r["id"], round(r["weight"], 6)) for r in b.collect()] == [("e0", pytest.approx(0.05))]
    assert audit.first().asDict() == {"updated": 4, "archived": 1, "deleted": 1, "edges_pruned": 1}
    c, d, _ = decaying.run(a, b, NOW)
    # the archived event was last used more than 7 days ago, so the next run deletes it
    assert {r["id"]: round(r["weight"], 9) for r in c.collect()} == {r["id"]: round(r["weight"], 9) for r in a.where("id <> 'event'").collect()} and d.count() == b.count()


def test_touch_and_bfs(spark):
    n = nodes(spark, *[dict(id=i, weight=0.1) for i in "abcdefg"], dict(id="z", archived=1))
    e = edges(spark, ("a", "b", "part_of"), ("b", "c", "part_of"), ("c", "d", "part_of"), ("d", "e", "part_of"), ("a", "z", "uses"), ("z", "g", "uses"), ("f", "f", "uses"))
    seeds = n.where("id = 'a'").select("id")
    t = {r["id"]: (round(r["weight"], 4), r["access_count"]) for r in decaying.touched(n, e, seeds, NOW).collect()}
    assert t["a"] == (1.0, 1) and t["b"] == (0.6, 0) and t["c"] == (0.36, 0) and t["d"] == (0.216, 0) and t["e"] == (0.1, 0)
    got = {r["id"]: r["depth"] for r in graph.neighbourhood(n, e, seeds, depth=3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    hub = {r["id"] for r in graph.neighbourhood(n, e, seeds, depth=3, hub=1).collect()}
    assert hub == {"a", "b"}
    assert {r["id"] for r in graph.isolated(n, e).collect()} == set()


def test_cycle_members(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("s", "s"), ("u", "t")], "child string, parent string")
    assert {(r["id"], r["cycle"]) for r in I.cycle_members(loop).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("s", "s")}


def test_tree_and_labels(spark):
    n = nodes(spark, dict(id="r"), dict(id="a", importance=0.9), dict(id="b", importance=0.1), dict(id="c"))
    e = edges(spark, ("a", "r", "part_of"), ("b", "r", "part_of"), ("c", "b", "part_of"))
    order = [(r["id"], r["depth"]) for r in graph.tree_rows(e, n).orderBy("sort_path").collect()]
    assert order == [("a", 1), ("b", 1), ("c", 2)]
    tri = edges(spark, *[(x, y, "uses") for g in ("abc", "xyz") for x in g for y in g if x < y])
    lab = {r["id"]: r["community"] for r in graph.label_propagation(tri).collect()}
    assert lab["a"] == lab["b"] == lab["c"] != lab["x"] == lab["y"] == lab["z"]


def test_ratio_equals_all_pairs(spark):
    names = ["current semester start", "current semester starts", "curent semester start", "project plan", "project plans", "totally other", "annual report", "anual report", "report annual", "abcd"]
    n = nodes(spark, *[dict(id=f"n{i}", name=x) for i, x in enumerate(names)])
    want = {(f"n{i}", f"n{j}") for i in range(len(names)) for j in range(i + 1, len(names)) if difflib.SequenceMatcher(None, *sorted((names[i], names[j]))).ratio() >= 0.9}
    assert {(r["a"], r["b"]) for r in I.name_duplicates(n).collect()} == want


def test_names_alike_at_all_lengths(spark):
    """Names of a common last word with letters put in, left out and changed, some of them long; few pairs are looked at, none is lost."""
    r = random.Random(4)
    names = set()
    for k in range(150):
        base = "".join(r.choice("aeioulmnrst") for _ in range(r.choice([1, 3, 6, 9, 12, 20, 28, 33, 39, 60, 110]))) + r.choice(["", " method", " slides"])
        names.add(base)
        for _ in range(4):
            t = list(base)
            for _ in range(r.randint(1, max(1, len(t) // 6))):
                p = r.randrange(len(t) + 1)
                if r.random() < 0.5:
                    t.insert(p, r.choice("aeiou "))
                elif p < len(t):
                    del t[p]
            names.add(" ".join("".join(t).split()))
    names = sorted(names - {""})
    want = {(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if difflib.SequenceMatcher(None, x, y).ratio() >= 0.9}
    got = {(x["n1"], x["n2"]) for x in I._alike_candidates(spark.createDataFrame([("event", x) for x in names], "type string, n string")).collect()}
    assert want and want <= got and len(got) < len(want) + 0.01 * len(names) ** 2 / 2, (len(names), len(want), len(got))
    assert I.ratio_at_least(I._alike_candidates(spark.createDataFrame([("event", x) for x in names], "type string, n string")), "n1", "n2").count() == len(want)


def test_nearest_of_type_equals_all_pairs(spark):
    """Blocks smaller than the types; equal vectors, ties and a type with a single row."""
    r = np.random.default_rng(3)
    u = r.normal(size=(60, 4))
    u = np.round(u / np.linalg.norm(u, axis=1, keepdims=True), 2)
    u[20:30] = u[10:20]
    u[40:43] = u[10]
    rows = [(f"i{k:02}", "skill" if k < 45 else "task" if k < 59 else "event", x.tolist()) for k, x in enumerate(u)]
    got = {(x["a"], x["b"], round(x["cos"], 6)) for x in I.nearest_of_type(spark.createDataFrame(rows, "id string, type string, u array<double>"), block=8).collect()}
    want = set()
    for a, t, x in rows:
        best = min(((-round(sum(p * q for p, q in zip(x, y)), 9), b) for b, s, y in rows if s == t and a != b), default=None)
        if best:
            want.add((a, best[1], round(-best[0], 6)))
    assert got == want and len(got) == 59


def test_upsert(spark):
    n = nodes(spark, dict(id="p", type="person"), dict(id="q"), dict(id="r"))
    e = edges(spark, ("q", "r", "part_of", dict(weight=0.5)), ("q", "p", "requires", dict(weight=0.9)))
    batch = spark.createDataFrame([("r", "q", "relates to"), ("q", "p", "needs"), ("q", "p", "requires"), ("p", "q", "created by"), ("q", "q", "uses"), (None, "q", "uses")], "source_id string, target_id string, relation string")
    got = {(r["source_id"], r["target_id"], r["relation"]): (r["weight"], r["reinforcement_count"], r["how"]) for r in mutate.upsert_edges(n, e, batch, NOW).collect()}
    assert got == {("q", "r", "part_of"): (0.5, 2, "reinforced"), ("q", "p", "requires"): (1.0, 3, "reinforced"), ("q", "p", "created_by"): (1.0, 1, "inserted")}


def test_merge_move_import_edit(spark):
    n = nodes(spark, dict(id="k", content="", importance=0.2), dict(id="d", content="text", importance=0.9), dict(id="c", type="category"), dict(id="o", type="person"), dict(id="s"))
    e = edges(spark, ("k", "c", "part_of"), ("d", "c", "part_of"), ("s", "d", "uses"), ("k", "d", "uses"))
    pairs = spark.createDataFrame([("k", "d")], "keep string, drop string")
    a, b = mutate.merge_nodes(n, e, pairs, NOW)
    k = a.where("id = 'k'").first()
    assert (k["content"], k["importance"], k["access_count"]) == ("text", 0.9, 1) and a.count() == 4
    assert {(r["source_id"], r["target_id"], r["relation"]) for r in b.collect()} == {("k", "c", "part_of"), ("s", "k", "uses")}
    moves = spark.createDataFrame([("c", "k"), ("k", "k"), ("k", "zz"), ("s", "c"), ("k", "s")], "id string, parent string")
    e2 = edges(spark, ("k", "c", "part_of"), ("s", "k", "part_of"))
    why = {(r["id"], r["parent"]): r["refusal"] for r in mutate.move_refusals(n, e2, moves, "o").collect()}
    assert why == {("c", "k"): "cycle", ("k", "k"): "self", ("k", "zz"): "missing", ("s", "c"): None, ("k", "s"): "cycle"}
    assert {(r["source_id"], r["target_id"]) for r in mutate.move_nodes(n, e2, moves, "o").collect()} == {("k", "c"), ("s", "c")}
    add, links = mutate.import_graph(n, e, nodes(spark, dict(id="new1", name="K"), dict(id="new2"), dict(id="s")), edges(spark, ("new1", "new2", "uses"), ("new1", "none", "uses"), ("new1", "d", "uses")))
    assert [r["id"] for r in add.collect()] == ["new2"] and {(r["source_id"], r["target_id"]) for r in links.collect()} == {("k", "new2")}
    ed = {r["id"]: r for r in mutate.edit_nodes(n, spark.createDataFrame([("k", " ", "team", 2.0), ("s", "S2", None, 0.7)], "id string, name string, type string, importance double")).collect()}
    assert (ed["k"]["name"], ed["k"]["type"], ed["k"]["half_life_days"], ed["k"]["importance"]) == ("k", "organization", float("inf"), 0.2) and (ed["s"]["name"], ed["s"]["importance"]) == ("S2", 0.7)
    assert {(r["id"], r["refusal"]) for r in mutate.forget_refusals(n, e).collect()} == {("k", None), ("d", None), ("c", "category"), ("o", "person"), ("s", None)}
    assert mutate.unlink(e, spark.createDataFrame([("d", "s"), ("c", "k")], "a string, b string")).count() == 3
    assert mutate.anchor(n, "own", "K", NOW).count() == 0 and mutate.anchor(n, "own", "Owner", NOW).first()["half_life_days"] == float("inf")


def test_index_links(spark):
    files = spark.createDataFrame([("people/a.md", "person", "Ann Example", ["Annie"], "s1", None), ("projects/x.md", "project", "Deep Sea", [], "s2", [1.0]), ("log/d.md", "log", "Ann Example", [], "s3", None)], "path string, kind string, title string, aliases array<string>, sha string, embedding array<double>")
    n = nodes(spark, dict(id="1", name="Ann Example"), dict(id="2", name="the deep sea study"), dict(id="3", name="child"), dict(id="4", name="ANNIE (2025)"), dict(id="c", type="category"))
    e = edges(spark, ("3", "2", "part_of"))
    got = {(r["path"], r["node_id"], r["how"]) for r in index.linked_files(files, n, e).collect()}
    assert got == {("people/a.md", "1", "name"), ("log/d.md", "1", "name"), ("projects/x.md", "2", "contains"), ("projects/x.md", "3", "inherited"), ("people/a.md", "4", "alias")}
    assert {(r["node_id"], r["path"]) for r in index.best_path(spark.createDataFrame(list(got), "path string, node_id string, how string"), files).collect()} >= {("1", "people/a.md")}
    before = spark.createDataFrame([("people/a.md", "s1"), ("projects/x.md", "old"), ("gone.md", "g")], "path string, sha string")
    assert {(r["path"], r["status"]) for r in index.changes(files, before).collect()} == {("people/a.md", "unchanged"), ("projects/x.md", "updated"), ("log/d.md", "added"), ("gone.md", "removed")}


def test_search(spark):
    n = nodes(spark, dict(id="1", name="Deep Sea", content="notes"), dict(id="2", name="other", content="deep seas and deep sea"), dict(id="3", name="deep", type="category"), dict(id="4", name="nothing"), dict(id="5", name="deep sea", archived=1))
    top = [(r["id"], r["hits"], r["exact"]) for r in search.in_order(search.search_nodes(n, "deep sea"), 9).collect()]
    assert top == [("1", 4, 1), ("2", 4, 0), ("3", 1, 0)]
    assert search.search_nodes(n, "  ").count() == 0
    f = spark.createDataFrame([("a.md", "person", "Deep Sea", [], "", ["deep"], "2026-01-01", None), ("b.md", "readme", "Index", [], "", ["deep", "sea"], "", None), ("c.md", "note", "x", [], "", ["zzz"], "", None)], "path string, kind string, title string, aliases array<string>, summary string, tokens array<string>, updated string, embedding array<double>")
    s = {r["path"]: (r["score"], list(r["why"])) for r in search.file_scores(f, "deep sea").collect()}
    assert s["a.md"] == (3 * 2 + 1 + 4, ["title match", "exact phrase"]) and s["b.md"] == (1.2, ["body match 2/2", "index page"]) and "c.md" not in s
    links = spark.createDataFrame([("a.md", "c.md"), ("a.md", "b.md"), ("b.md", "c.md")], "path string, target string")
    hop = {r["path"]: r["score"] for r in search.hop(search.file_scores(f, "deep sea"), links, f).collect()}
    assert hop == {"a.md": 11.0, "b.md": 2.2, "c.md": 2.0}
    assert [r["path"] for r in search.best_files(search.file_scores(f, "who knows the deep sea"), k=1, who=True).collect()] == ["a.md"]


def test_ingest(spark):
    t = spark.createDataFrame([("1", "Alpha meets Bravo.\n\nTODO: send form\nTODO: Send Form"), ("2", None), ("3", "")], "id string, text string")
    r = ingest.extracted(t, "id", "text")
    assert {x["name_key"] for x in ingest.candidate_nodes(r).collect()} >= {"alpha", "bravo"}
    assert [x["text"] for x in ingest.tasks(r).collect()] == ["send form"]
    n = nodes(spark, dict(id="n1", name="ALPHA", created_at=1.0), dict(id="n2", name="alpha", created_at=0.0), dict(id="v", name="zz", embedding=[1.0, 0.0]))
    got = {x["name_key"]: (x["id"], x["how"]) for x in ingest.resolved(ingest.candidate_nodes(r), n, spark.createDataFrame([("bravo", [0.99, 0.05])], "name_key string, v array<double>")).collect()}
    assert got["alpha"] == ("n2", "name") and got["bravo"] == ("v", "vector")
    att = {x["name_key"]: (x["parent"], x["how"]) for x in ingest.attached(spark.createDataFrame([("f", "fact", None), ("p", "person", "Work > Team"), ("q", "skill", "stuff")], "name_key string, type string, parent string"), spark.createDataFrame([("f", "p")], "source_key string, target_key string")).collect()}
    assert att == {"f": ("p", "neighbour"), "p": ("Team", "explicit"), "q": ("Skills", "type")}
    e = ingest.embedded(n, lambda s: [[float(len(x))] for x in s])
    assert {x["id"] for x in e.collect()} == {"n1", "n2"}


def test_capture_batch(spark):
    p = spark.createDataFrame([("s", 1, "x" * 90, True), ("s", 2, "y" * 50, False), ("auto", 1, "<scheduled-task " + "z" * 200, False)], "session string, seq int, text string, stale boolean")
    m = spark.createDataFrame([("s", 90), ("auto", 9999)], "session string, chars long")
    got = {r["session"]: (r["from_char"], r["new_chars"], r["mine"]) for r in capture.offsets(p, m).collect()}
    assert got["s"] == (90, 50, False) and got["auto"][0] == 0 and got["auto"][2] is False
    q = spark.createDataFrame([("a", "hi", float(t)) for t in (0, 100, 21600, 21700, 50000)], "recipient string, text string, ts double")
    assert sorted(r["ts"] for r in capture.suppressed(q).collect()) == [0.0, 21600.0, 50000.0]
    assert [len(r["piece"]) for r in capture.windows(spark.createDataFrame([("1", "a" * 25), ("2", ""), ("3", None)], "id string, t string"), "t", 10).orderBy("window_no").collect()] == [10, 10, 5]


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("s", 1, "It rains. It rains.", False), ("s", 2, "It snows", False)], "session string, seq int, text string, stale boolean").coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("session string, seq int, text string, stale boolean").json(str(src))
    q = capture.facts(stream).writeStream.format("memory").queryName("facts_out").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["fact"] for r in spark.sql("select fact from facts_out").collect()) == ["It rains.", "It snows"]
    q = capture.watermarked(stream, least=10).writeStream.format("memory").queryName("mark_out").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["from_char"], r["to_char"]) for r in spark.sql("select * from mark_out").collect()] == [(0, 27)]
    seen = []
    one = spark.createDataFrame([("a",)], "x string")

    def failing(df, b):
        seen.append(b)
        if len(seen) == 1:
            raise ValueError

    for _ in range(3):  # as after restarts: nothing but the folder remembers
        try:
            capture.each_batch(failing, str(tmp_path / "done"))(one, 1)
        except ValueError:
            pass
    assert seen == [1, 1]
    for _ in range(2):
        capture.batch_sink(str(tmp_path / "out"))(one, 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_empty_tables(spark):
    n, e = nodes(spark), edges(spark)
    assert decaying.run(n, e, NOW)[2].first()["updated"] == 0
    assert graph.degrees(e).count() == 0 and I.name_duplicates(n).count() == 0 and I.parent_findings(n, e, "o").count() == 0
    assert sum(r["n"] for r in I.report(n, e).collect()) == 0
    assert I.repaired(n, e, "o", "f")[0].count() == 0
    assert search.search_nodes(n, "x").count() == 0 and mutate.upsert_edges(n, e, e.select("source_id", "target_id", "relation"), NOW).count() == 0


def test_order_of_rows_does_not_matter(spark, broken):
    n, e = broken
    a = sorted(map(str, graph.first_parent(e).collect()))
    assert a == sorted(map(str, graph.first_parent(e.repartition(7).orderBy(F.desc("id"))).collect()))
