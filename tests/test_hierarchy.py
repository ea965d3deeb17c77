import random

import pytest

from lodegraph.operators import hierarchy as H
from lodegraph.workspace import Workspace


def brute(links):
    up = {}
    for c, p in {(c, p) for c, p in links if c is not None and p is not None}:
        up.setdefault(c, set()).add(p)
        up.setdefault(p, set())

    def runs_into_cycle(n):
        todo, seen = [n], set()
        while todo:
            x = todo.pop()
            for p in up[x]:
                if reach(p, p):
                    return True
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return bool(reach(n, n))

    def reach(a, b):
        todo, seen = list(up[a]), set()
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += up[x]
        return False

    out = set()
    for n in up:
        if not up[n]:
            continue
        if runs_into_cycle(n):
            out.add((n, "cycle", -1))
            continue
        level, d = {n}, 0
        while level:
            out |= {(n, x, d) for x in level if not up[x] and d}
            level, d = {p for x in level for p in up[x]}, d + 1
    return out


def frame(spark, links):
    return spark.createDataFrame(links, "child string, parent string")


def result(df):
    return {tuple(r) for r in df.select("node_id", "root_id", "depth").collect()}


def graph(seed):
    r = random.Random(seed)
    n = r.randint(2, 40)
    links = [(f"n{i}", f"n{r.randrange(max(1, i))}") for i in range(1, n) if r.random() < 0.85]
    links += [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(r.randint(0, 4))]
    return links


def chains(links):
    """Every node's paths to its roots, nodes that run into a cycle left out."""
    up = {}
    for c, p in set(links):
        up.setdefault(c, []).append(p)
    lost = {n for n, r, d in brute(links) if d < 0}
    out, todo = set(), [(n, (n,)) for n in up if n not in lost]
    while todo:
        n, path = todo.pop()
        for p in up.get(path[0], []):
            out.add((n, p, (p, *path), p not in up))
            todo.append((n, (p, *path)))
    return out


def reachable(links, n):
    seen, todo = set(), [n]
    while todo:
        x = todo.pop()
        for c, p in links:
            if c == x and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def many():
    """Random graphs side by side, a long chain with a crowd below it, and nodes with several parents."""
    out = [(f"g{s}{c}", f"g{s}{p}") for s in range(24) for c, p in graph(s)]
    out += [(f"x{i}", f"x{i + 1}") for i in range(40)] + [(f"h{i}", "x9") for i in range(90)] + [("x2", "x5"), ("x1", "x4"), ("x3", "g1n1"), ("x20", "g2n0")]
    return out


@pytest.mark.parametrize("piece", [30, 50_000])
def test_equals_brute_force_whatever_the_pieces(spark, piece):
    links = many()
    rows, back = H._solved(frame(spark, links), piece, paths=True)
    rows, back = rows.collect(), {tuple(r) for r in back.collect()}
    every = brute(links)
    assert {(r["node"], r["anc"] or "cycle", r["steps"]) for r in rows} == every and len(rows) == len(every)
    assert back and back <= set(links) and all(d >= 0 for _, _, d in brute([x for x in links if x not in back]))
    assert all(c == p or c in reachable(links, p) for c, p in back)  # the link is on a cycle
    want = {}
    for n, a, p, top in chains(links):
        if top:
            k = (n, a, len(p) - 1)
            want[k] = min(want.get(k, p), p)
    assert {(r["node"], r["anc"], r["steps"]): (r["anc"], *r["path"]) for r in rows if r["anc"]} == want


@pytest.mark.parametrize("piece", [30, 50_000])
def test_closure_equals_brute_force(spark, piece):
    links = many()
    got = H.closure(frame(spark, links), piece=piece).collect()
    assert {tuple(r) for r in got} == {(n, a, len(p) - 1) for n, a, p, _ in chains(links)} and len(got) == len({tuple(r) for r in got})


def test_edge_cases(spark):
    links = [("a", "a"), ("b", "a"), ("c", "d"), ("c", "d"), (None, "d"), ("e", None), ("f", "c"), ("f", "d")]
    assert result(H.roots_and_depths(frame(spark, links))) == {("a", "cycle", -1), ("b", "cycle", -1), ("c", "d", 1), ("f", "d", 1), ("f", "d", 2)}
    assert H.roots_and_depths(frame(spark, [])).count() == 0


def test_closure_and_paths(spark):
    links = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "a"), ("x", "b"), ("y", "x"), ("q", "q"), ("r", "q")]
    got = {tuple(r) for r in H.closure(frame(spark, links)).select("node_id", "ancestor_id", "steps").collect()}
    assert got == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("d", "c", 1), ("d", "b", 2), ("d", "a", 3), ("x", "a", 1), ("x", "b", 1), ("x", "a", 2), ("y", "x", 1), ("y", "a", 2), ("y", "b", 2), ("y", "a", 3)}
    p = {(r["node_id"], r["root_id"], r["depth"]): r["path"] for r in H.paths(frame(spark, links)).collect()}
    assert p["d", "a", 3] == "a/b/c/d" and p["x", "a", 1] == "a/x" and p["x", "a", 2] == "a/b/x" and p["a", "a", 0] == "a" and p["r", "cycle", -1] is None and len(p) == 10
    assert H.closure(frame(spark, [])).count() == 0


def test_structural_links_need_both_ends_and_ignore_clashing_columns(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "id string, child int")
    edges = spark.createDataFrame([("1", "b", "a", "is a Component of", 0), ("2", "b", "z", "part_of", 0), ("3", "a", "b", "uses", 0), ("4", None, "b", "part_of", 0), ("5", "b", "a", None, 0)], "id string, source_id string, target_id string, relation string, parent int")
    assert [tuple(r) for r in H.structural_links(nodes, edges).collect()] == [("b", "a")]


def test_components(spark):
    ws = Workspace(spark, "test")
    links = [(1, 2), (2, 3), (7, 8), (9, 8), (4, 4)]
    got = {r["node"]: r["comp"] for r in H.components(ws, spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


def test_whole_table_equals_brute_force(spark, data):
    from lodegraph.plans.hierarchy_queries import _links, p4_found

    links = [tuple(r) for r in _links(spark, data).collect()]
    assert result(p4_found(spark, data)) == brute(links)
