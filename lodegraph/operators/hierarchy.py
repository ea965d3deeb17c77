"""Problem 4: parent-child links to full hierarchies, with cycles.

Connected components are found by alternating stars, each is brought to one task and walked there depth first with node
colours.  A component can hold nearly all links, so the graph is cut first: ends of chains and leaves don't connect
anything, and of the nodes between them some are cut, the likelier the more links they have, until every piece fits a task.  A
cut node ends the chains that reach it and is walked on from once more for each of its links; what is left then is a small
graph of cut nodes, which goes the same way, and the answers for cut nodes are carried back to the pieces.  This is one way for
graphs of any size; how many links a piece may have is a parameter that changes no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import relation
from ..workspace import Workspace

CYCLE = "cycle"
#: Links of one piece, which one task holds.
PIECE = 50_000
#: Chance of a node to be cut, for every link it has beyond one; the first under which all pieces fit is used.
RATES = (1 / 8, 1 / 2)
#: Kinds of rows that a walk gives.
END, BETWEEN, LOST, BACK = range(4)


def structural_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(child, parent): distinct part_of links with both ends in `nodes`; null ends are none."""
    e = edges.select(F.col("source_id").alias("child"), F.col("target_id").alias("parent"), F.col("relation").alias("_r")).where(relation(F.col("_r")) == "part_of").select("child", "parent").where("child is not null and parent is not null").distinct()
    ids = nodes.select(F.col("id").alias("_id"))
    return e.join(ids, F.col("child") == F.col("_id"), "left_semi").join(ids, F.col("parent") == F.col("_id"), "left_semi")


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(node, comp) for links (u, v): comp is the smallest node of the connected component.  One stored table a round."""
    figures = {"n": F.count("*"), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    cur, now = ws.measured(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), **figures)
    mark = None
    while now != mark:
        mark = now
        # Laid out by u, tables need no further exchange for the aggregations and joins on it.
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        low2 = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low2, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new, now = ws.measured(small.unionByName(low2.select("u", F.col("m").alias("v"))).repartition("u").distinct(), **figures)
        ws.drop(cur)
        cur = new
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


@dataclass(slots=True)
class Link:
    """A child's way up: over its parent `via` to `to` (null: into a cycle) in `steps`, passing `seg`, the nodes below `to` down to the child."""

    child: str
    via: str
    to: str | None
    steps: int
    seg: tuple[str, ...] | None
    own: bool
    cut: bool


def walk(links: list[Link], between: bool = False) -> Iterator[tuple]:
    """Depth-first walk from children to parents of one piece: rows (node, via, anc, steps, kind, path).

    White nodes are unseen, grey ones on the current chain, black ones done.  A link to a grey node closes a cycle: it is a
    back link, and whoever reaches the cycle is lost.  Chains end at nodes without links of their own here.  Links that
    aren't `own` belong to leaves and cut nodes, which nothing here leads to; those of cut nodes keep their `via`.
    With `between` all ancestors are given, else ends only; of several chains of a length to one end the smallest path stays.
    """
    up: dict[str, list[Link]] = {}
    for x in links:
        if x.own:
            up.setdefault(x.child, []).append(x)
    colour: dict[str, int] = {}
    found: dict[str, dict[tuple[str, int, int], tuple | None]] = {}
    lost: set[str] = set()

    def above(x: Link) -> dict[tuple[str, int, int], tuple | None]:
        if x.to not in up:
            return {(x.to, x.steps, END): x.seg}
        out = {(a, s + x.steps, k): None if p is None else p + x.seg for (a, s, k), p in found[x.to].items()}
        return out | {(x.to, x.steps, BETWEEN): x.seg} if between else out

    def merged(ways: list[Link]) -> dict[tuple[str, int, int], tuple | None]:
        out: dict[tuple[str, int, int], tuple | None] = {}
        for x in ways:
            for k, p in above(x).items():
                if k not in out or (p is not None and p < out[k]):
                    out[k] = p
        return out

    for start in sorted(up):
        if start in colour:
            continue
        colour[start] = 1
        stack = [(start, iter(up[start]))]
        while stack:
            node, rest = stack[-1]
            x = next(rest, None)
            if x is None:
                stack.pop()
                colour[node] = 2
                if any(y.to is None or y.to in lost for y in up[node]):
                    lost.add(node)
                if node not in lost:
                    found[node] = merged(up[node])
            elif x.to in up:
                if x.to not in colour:
                    colour[x.to] = 1
                    stack.append((x.to, iter(up[x.to])))
                elif colour[x.to] == 1:
                    lost |= {x.to, node}
                    yield node, x.via, None, -1, BACK, None
    for node in up:
        if node in lost:
            yield node, None, None, -1, LOST, None
        else:
            for (a, s, k), p in found[node].items():
                yield node, None, a, s, k, p
    for x in links:
        if not x.own:
            via = x.via if x.cut else None
            if x.to is None or x.to in lost:
                yield x.child, via, None, -1, LOST, None
            else:
                for (a, s, k), p in above(x).items():
                    yield x.child, via, a, s, k, p


ROW = "node string, via string, anc string, steps long, kind int, path array<string>"
SHAPE = pa.schema([("node", pa.string()), ("via", pa.string()), ("anc", pa.string()), ("steps", pa.int64()), ("kind", pa.int32()), ("path", pa.list_(pa.string()))])


def walked(frag: DataFrame, between: bool) -> DataFrame:
    """Rows of all pieces of (comp, u, via, v, w, seg, own, cut): a piece is in one task, in the order of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, links = None, []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], SHAPE.types[i]) for i in range(len(SHAPE))], schema=SHAPE)
            out.clear()
            return b

        for b in batches:
            for k, u, via, v, w, seg, own, cut in zip(*(c.to_pylist() for c in b.columns)):
                if k != piece:
                    out.extend(walk(links, between))
                    piece, links = k, []
                    if len(out) > 20_000:
                        yield batch()
                links.append(Link(u, via, v, w, None if seg is None else tuple(seg), own, cut))
        out.extend(walk(links, between))
        yield batch()

    cols = ["comp", "u", "via", "v", "w", "seg", "own", "cut"]
    return frag.select(*cols).repartition("comp").sortWithinPartitions("comp", "u", "via", "v", "w").mapInArrow(run, ROW)


def pieces(ws: Workspace, links: DataFrame, level: int, most: int) -> DataFrame:
    """Links with their piece `comp` (null: nothing to walk, the link leads from a leaf or cut node to an end or cut node), `own` and `cut`."""
    ins = links.where("v is not null").groupBy(F.col("v").alias("n")).agg(F.count("*").alias("i"))
    outs = links.groupBy(F.col("u").alias("n")).agg(F.count("*").alias("o"))
    inner = ws.save(ins.join(outs, "n").select("n", (F.col("i") + F.col("o") - 1).alias("d")))
    chance = F.pmod(F.xxhash64(F.lit(level), "n"), F.lit(1 << 40)) / float(1 << 40)
    for rate in RATES:
        mark = inner.select("n", (chance < F.col("d") * rate).alias("is_cut"))
        x = links.join(mark.select(F.col("n").alias("u"), F.col("is_cut").alias("cu")), "u", "left").join(mark.select(F.col("n").alias("v"), F.col("is_cut").alias("cv")), "v", "left")
        x = ws.save(x.select("u", "via", "v", "w", "seg", (~F.coalesce("cu", F.lit(True))).alias("own"), F.coalesce("cu", F.lit(False)).alias("cut"), (~F.coalesce("cv", F.lit(True))).alias("on")))
        comp = components(ws, x.where("own and on").select("u", "v"))
        key = F.when(F.col("own"), F.col("u")).when(F.col("on"), F.col("v"))
        x = x.withColumn("key", key).join(comp.select(F.col("node").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        x = ws.save(x)
        largest = x.where("comp is not null").groupBy("comp").count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            break
    return x  # under the last rate a piece is a few nodes unless nearly all nodes have many parents


def solve(ws: Workspace, links: DataFrame, most: int, between: bool, level: int = 0) -> tuple[DataFrame, DataFrame]:
    """Of links (u, via, v, w, seg): rows (node, anc, steps, kind, path) and back links (child, parent).

    Rows are the ends of every node (END) or its being lost (LOST), with `between` its other ancestors (BETWEEN) too, if no chain is lost.
    """
    x = pieces(ws, links, level, most)
    still = x.where("comp is null").select(F.col("u").alias("node"), F.when(F.col("cut"), F.col("via")).alias("via"), F.col("v").alias("anc"), F.when(F.col("v").isNull(), -1).otherwise(F.col("w")).alias("steps"), F.when(F.col("v").isNull(), LOST).otherwise(END).alias("kind"), F.col("seg").alias("path"))
    rows, n = ws.measured(walked(x.where("comp is not null"), between).unionByName(still), left=F.count_if(F.col("via").isNotNull() & (F.col("kind") != BACK) & (F.col("kind") != BETWEEN)))
    back = rows.where(F.col("kind") == BACK).select(F.col("node").alias("child"), F.col("via").alias("parent"))
    local = rows.where(F.col("via").isNull() & (F.col("kind") != BACK)).drop("via")
    if not n["left"]:
        return local, back
    beside = rows.where(F.col("via").isNotNull() & (F.col("kind") != BACK))
    rest = beside.where(F.col("kind") != BETWEEN).select(F.col("node").alias("u"), "via", F.col("anc").alias("v"), F.col("steps").alias("w"), F.col("path").alias("seg"))
    if n["left"] <= most:
        whole = walked(rest.select(F.lit("").alias("comp"), "*", F.lit(True).alias("own"), F.lit(False).alias("cut")), between)
        got = ws.save(whole)
        more_back = got.where(F.col("kind") == BACK).select(F.col("node").alias("child"), F.col("via").alias("parent"))
        got = got.where(F.col("kind") != BACK).drop("via")
    else:
        got, more_back = solve(ws, ws.save(rest), most, between, level + 1)
        got = ws.save(got)
    if between:
        got = _filled(ws, got, beside.where(F.col("kind") == BETWEEN))
    # What ends at a cut node goes on with that node's answers.
    on = got.select(F.col("node").alias("anc"), F.col("anc").alias("a2"), F.col("steps").alias("s2"), F.col("kind").alias("k2"), F.col("path").alias("p2"))
    ends = local.where(F.col("kind") == END).join(on, "anc", "left")
    lost = F.coalesce(F.col("k2") == LOST, F.lit(False))
    moved = ends.select(
        "node", F.when(F.col("k2").isNull(), F.col("anc")).otherwise(F.col("a2")).alias("anc"), F.when(lost, -1).otherwise(F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"),
        F.coalesce("k2", F.lit(END)).alias("kind"), F.when(F.col("k2").isNull(), F.col("path")).otherwise(F.concat("p2", "path")).alias("path"),
    )
    out = local.where(F.col("kind") != END).unionByName(moved).unionByName(got)
    if between:  # cut nodes themselves are ancestors too
        out = out.unionByName(local.where(F.col("kind") == END).join(got.select(F.col("node").alias("anc")).distinct(), "anc", "left_semi").select("node", "anc", "steps", F.lit(BETWEEN).alias("kind"), "path"))
    return out, back.unionByName(more_back)


def _filled(ws: Workspace, got: DataFrame, passed: DataFrame) -> DataFrame:
    """All ancestors of cut nodes: those that are cut or ends (`got`), and those between that they and their cut ancestors pass."""
    p = passed.select(F.col("node").alias("t"), "anc", F.col("steps").alias("s2"))
    start = got.select("node", F.col("anc").alias("t"), F.col("steps").alias("s")).unionByName(p.select(F.col("t").alias("node"), "t", F.lit(0).cast("long").alias("s")).distinct())
    more = start.join(p, "t").select("node", "anc", (F.col("s") + F.col("s2")).alias("steps"), F.lit(BETWEEN).alias("kind"), F.lit(None).cast("array<string>").alias("path"))
    return ws.save(got.unionByName(more))


def _solved(links: DataFrame, most: int, paths: bool = False, between: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of `solve`, each once, a lost node with that row only, and back links."""
    ws = Workspace(links.sparkSession, "hierarchy")
    one = links.where("child is not null and parent is not null").select(F.col("child").cast("string").alias("u"), F.col("parent").cast("string").alias("v")).distinct()
    seg = F.array("u") if paths else F.lit(None).cast("array<string>")
    rows, back = solve(ws, ws.save(one.select("u", F.col("v").alias("via"), "v", F.lit(1).cast("long").alias("w"), seg.alias("seg"))), most, between)
    rows = ws.save(rows)
    lost = rows.where(F.col("kind") == LOST).select("node").distinct()
    kept = rows.where(F.col("kind") != LOST).join(lost, "node", "left_anti").groupBy("node", "anc", "steps").agg(F.min("path").alias("path"))
    return kept.unionByName(lost.select("node", F.lit(None).cast("string").alias("anc"), F.lit(-1).cast("long").alias("steps"), F.lit(None).cast("array<string>").alias("path"))), back


def roots_and_depths(links: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node_id, root_id, depth) of links (child, parent): one row for each distinct root and number of steps of a node.

    Nodes without a parent give no row.  A node whose chain runs into a cycle, a link to itself included, has the
    single row (node_id, 'cycle', -1).  Repeated links count once; links with a null end are left out; an empty
    input gives no rows.
    """
    rows, _ = _solved(links, piece)
    return rows.select(F.col("node").alias("node_id"), F.coalesce("anc", F.lit(CYCLE)).alias("root_id"), F.col("steps").alias("depth"))


def back_links(links: DataFrame, piece: int = PIECE) -> DataFrame:
    """(child, parent): the links that close cycles in the walk.  Each is on a cycle, and without them there is none; which link of a cycle it is depends on the order of the walk, which follows ids."""
    _, back = _solved(links, piece)
    return back.distinct()


def closure(links: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node_id, ancestor_id, steps): every ancestor of every node with the distances at which it is one; read the other way, all descendants.

    Nodes whose chain runs into a cycle are left out, as their chain has no end; `roots_and_depths` names them.
    """
    rows, _ = _solved(links, piece, between=True)
    return rows.where("anc is not null").select(F.col("node").alias("node_id"), F.col("anc").alias("ancestor_id"), "steps")


def paths(links: DataFrame, separator: str = "/", piece: int = PIECE) -> DataFrame:
    """(node_id, root_id, depth, path): for every node and each of its roots and depths the ids from the root down to the node.

    Of several chains of one length to one root the path that is smallest, id by id, is given.  Roots have their own id
    at depth 0; nodes whose chain runs into a cycle have root 'cycle', depth -1 and no path.
    """
    rows, _ = _solved(links, piece, paths=True)
    out = rows.select(F.col("node").alias("node_id"), F.coalesce("anc", F.lit(CYCLE)).alias("root_id"), F.col("steps").alias("depth"), F.when(F.col("anc").isNotNull(), F.array_join(F.concat(F.array("anc"), F.col("path")), separator)).alias("path"))
    clean = links.where("child is not null and parent is not null")
    roots = clean.select(F.col("parent").cast("string").alias("node_id")).distinct().join(clean.select(F.col("child").cast("string").alias("node_id")).distinct(), "node_id", "left_anti")
    return out.unionByName(roots.select("node_id", F.col("node_id").alias("root_id"), F.lit(0).cast("long").alias("depth"), F.col("node_id").alias("path")))
