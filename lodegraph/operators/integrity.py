"""Integrity of a graph: findings as tables, repairs as transforms.

`nodes` of a check are active ones unless said otherwise; parents are part_of targets that are active nodes.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decay as D
from ..functions import text as X
from ..functions import vectors as V
from ..functions.vocab import AGENTS

ENTITY_KINDS = ["person", "org", "project", "course", "application", "app", "topic"]
CROWDED = 12


def active(nodes: DataFrame) -> DataFrame:
    return nodes.where("archived = 0")


def parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(child, parent) between active nodes, each once."""
    a = active(nodes).select("id")
    p = edges.where("relation = 'part_of'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")).distinct()
    return p.join(a, F.col("child") == F.col("id"), "left_semi").join(a, F.col("parent") == F.col("id"), "left_semi")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select(F.col("id").alias("_id"))
    e = edges.select("id", "source_id", "target_id").distinct()
    return e.join(ids, F.col("source_id") == F.col("_id"), "left_anti").unionByName(e.join(ids, F.col("target_id") == F.col("_id"), "left_anti")).distinct()


def pair_key(a: str = "source_id", b: str = "target_id"):
    return F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")


def redundant_links(edges: DataFrame) -> DataFrame:
    """relates_to edges beside a part_of between the same two nodes, in either direction."""
    spine = edges.where("relation = 'part_of'").select(*pair_key()).distinct()
    return edges.where("relation = 'relates_to'").select("id", *pair_key()).join(spine, ["_lo", "_hi"], "left_semi").select("id").distinct()


def with_end_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    t = active(nodes).select("id", "type")
    return edges.join(t.select(F.col("id").alias("source_id"), F.col("type").alias("source_type")), "source_id").join(t.select(F.col("id").alias("target_id"), F.col("type").alias("target_type")), "target_id")


def misoriented_flag():
    """True for passive edges whose agent stands at the source."""
    out = F.lit(False)
    for rel, kinds in AGENTS.items():
        out = out | ((F.col("relation") == rel) & F.col("source_type").isin(kinds) & ~F.col("target_type").isin(kinds))
    return out


def misoriented(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return with_end_types(nodes, edges).where(misoriented_flag()).select("id", "source_id", "relation", "target_id").distinct()


def oriented(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with passive ones turned the right way round; edges with an unknown end stay."""
    t = nodes.select("id", "type")
    e = edges.join(t.select(F.col("id").alias("_s"), F.col("type").alias("source_type")), F.col("source_id") == F.col("_s"), "left").join(t.select(F.col("id").alias("_t"), F.col("type").alias("target_type")), F.col("target_id") == F.col("_t"), "left")
    swap = F.coalesce(misoriented_flag(), F.lit(False))
    return e.withColumn("_swap", swap).withColumn("_a", F.when(F.col("_swap"), F.col("target_id")).otherwise(F.col("source_id"))).withColumn("_b", F.when(F.col("_swap"), F.col("source_id")).otherwise(F.col("target_id"))).withColumn("source_id", F.col("_a")).withColumn("target_id", F.col("_b")).select(*edges.columns)


def category_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cross-links that touch a category."""
    return with_end_types(nodes, edges.where("relation <> 'part_of'")).where("source_type = 'category' or target_type = 'category'").select("id").distinct()


def parent_findings(nodes: DataFrame, edges: DataFrame, owner: str | None = None) -> DataFrame:
    """(finding, id): unrooted_category, category_bad_parent, orphan, multi_parent, under_identity, legacy_task, missing_embedding."""
    a = active(nodes).select("id", "type", "embedding")
    p = parents(nodes, edges)
    kinds = a.select(F.col("id").alias("parent"), (F.col("type") == "category").alias("cat"))
    own = F.col("parent") == F.lit(owner) if owner else F.lit(False)
    per = p.join(kinds, "parent").groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n"), F.max(own).alias("under"), F.min(F.col("cat") | own).alias("good"))
    x = a.join(per, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if owner:
        x = x.where(F.col("id") != owner)
    cat = F.col("type") == "category"
    has_owner = F.lit(owner is not None)
    empty = F.col("embedding").isNull() | (F.size("embedding") == 0)
    found = F.array(
        F.when(cat & (F.col("n") == 0), "unrooted_category"),
        F.when(cat & has_owner & (F.col("n") > 0) & ((F.col("n") > 1) | ~F.col("good")), "category_bad_parent"),
        F.when(~cat & (F.col("n") == 0), "orphan"),
        F.when(~cat & (F.col("n") > 1), "multi_parent"),
        F.when(~cat & F.coalesce("under", F.lit(False)), "under_identity"),
        F.when(F.col("type") == "task", "legacy_task"),
        F.when(empty, "missing_embedding"),
    )
    return x.select(F.explode(F.filter(found, lambda f: f.isNotNull())).alias("finding"), "id")


def crowded(nodes: DataFrame, edges: DataFrame, owner: str | None = None, most: int = CROWDED) -> DataFrame:
    """(finding, id, n): categories (oversized) and other nodes (flat_list) with more than `most` children that aren't categories."""
    a = active(nodes).select("id", "type")
    n = parents(nodes, edges).join(a.where("type <> 'category'").select(F.col("id").alias("child")), "child").groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > most)
    x = n.join(a, F.col("parent") == F.col("id"))
    if owner:
        x = x.where((F.col("type") == "category") | (F.col("id") != owner))
    return x.select(F.when(F.col("type") == "category", "oversized").otherwise("flat_list").alias("finding"), "id", "n")


def fact_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_children, first_child): facts used as containers; the children's smallest name."""
    a = active(nodes).select("id", "type", "name")
    p = parents(nodes, edges).join(a.where("type = 'fact'").select(F.col("id").alias("parent")), "parent")
    return p.join(a.select(F.col("id").alias("child"), "name"), "child").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"), F.min("name").alias("first_child"))


def _kin(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) without those of a parent and its child."""
    p = parents(nodes, edges).select(F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b")).distinct()
    return pairs.join(p, ["a", "b"], "left_anti")


def semantic_duplicates(nodes: DataFrame, edges: DataFrame, least: float = 0.89, block: int = 2048) -> DataFrame:
    """(a, b, cosine): active nodes of one type, no categories, whose stored vectors nearly coincide; parents and children don't count.

    All pairs of a type are compared, as the check asks for, but as products of matrices: a type's vectors are dealt into blocks of
    about `block` rows and every task gets one pair of blocks, however large the type is.
    """
    v = active(nodes).where("type <> 'category' and embedding is not null and size(embedding) > 0").select("id", "type", F.size("embedding").alias("dim"), "embedding", V.norm(F.col("embedding")).alias("_n")).where("_n > 0 and not isnan(_n)")
    v = v.select("id", "type", "dim", F.transform("embedding", lambda x: x.cast("double") / F.col("_n")).alias("u"))
    n = v.groupBy("type", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = v.join(n, ["type", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    paired = dealt.select("type", "dim", "id", "own", "u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x")).select("type", "dim", "id", "own", "u", F.least("own", "x").alias("lo"), F.greatest("own", "x").alias("hi"))

    def compare(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        _, _, lo, hi = key
        u, ids, own = np.array(p["u"].tolist(), float), p["id"].to_numpy(), p["own"].to_numpy()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        cos = np.round(u[left] @ u[right].T, 6)
        i, j = np.nonzero(cos >= least)
        a, b = ids[left[i]], ids[right[j]]
        keep = a < b if lo == hi else a != b
        a, b, c = a[keep], b[keep], cos[i, j][keep]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "cosine": c})

    pairs = paired.groupBy("type", "dim", "lo", "hi").applyInPandas(compare, "a string, b string, cosine double")
    return _kin(pairs, nodes, edges)


def nearest_of_type(vectors: DataFrame, block: int = 4096) -> DataFrame:
    """(a, b, cos): for every row of vectors (id, type, u of length 1) the most similar other one of its type, to nine places; of equal ones the smaller id.

    Equal vectors are one class.  All pairs of a type's classes are compared, as products of matrices in blocks like `semantic_duplicates`; what may be
    the nearest is then computed number by number, so that rounding doesn't depend on the blocks.
    """
    v = vectors.select("id", "type", "u").distinct()
    classes = v.groupBy("type", "u").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    n = classes.groupBy("type").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = classes.join(n, "type").withColumn("own", F.pmod(F.xxhash64("first"), F.col("n")).cast("int"))
    paired = dealt.select("type", "first", "own", "u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x")).select("type", "first", "own", "u", F.least("own", "x").alias("lo"), F.greatest("own", "x").alias("hi"))

    def compare(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        u, ids, own = np.array(p["u"].tolist(), float).reshape(len(p), -1), p["first"].to_numpy(), p["own"].to_numpy()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        out = []
        for x, y in ((left, right), (right, left))[: 1 if lo == hi else 2]:
            for i in range(0, len(x), 512):
                if not len(y):
                    break
                rows = x[i : i + 512]
                cos = u[rows] @ u[y].T
                cos[np.isnan(cos)] = -np.inf
                if lo == hi:
                    cos[np.arange(len(rows)), i + np.arange(len(rows))] = -np.inf
                a, b = np.nonzero(cos >= cos.max(axis=1, keepdims=True) - 3e-9)  # rounding and the order of sums are below that
                a, b = rows[a], y[b]
                a, b = a[a != b], b[a != b]
                exact = np.zeros(len(a))
                for d in range(u.shape[1]):
                    exact += u[a, d] * u[b, d]
                out.append(pd.DataFrame({"a": ids[a], "b": ids[b], "cos": exact}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "cos": []})

    def best(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min_by(F.struct("b", "cos"), F.struct(-F.round("cos", 9), F.col("b"))).alias("m")).select(key, "m.b", "m.cos")

    others = best(paired.groupBy("type", "lo", "hi").applyInPandas(compare, "a string, b string, cos double"), "a").withColumnRenamed("a", "first")
    # Within a class the smallest other id.
    second = v.join(classes.where("copies > 1"), ["type", "u"]).where("id <> first").groupBy("first").agg(F.min("id").alias("second"))
    member = v.join(classes, ["type", "u"]).select("id", "first", V.dot(F.col("u"), F.col("u")).alias("cos"))
    same = member.join(second, "first").select("id", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("b"), "cos")
    across = member.select("id", "first").join(others, "first").select("id", "b", "cos")
    return best(same.unionByName(across), "id").withColumnRenamed("id", "a")


def ratio_at_least(pairs: DataFrame, a: str, b: str, least: float = 0.9) -> DataFrame:
    """Pairs whose similarity by matching blocks reaches `least`; Arrow batches, after bounds by lengths and by edits, which stay in the JVM."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    near = pairs.where(2 * short >= least * (short + long))
    # Letters outside the matching blocks are put in or left out, so twice as many edits as this can't be.
    near = near.where(F.levenshtein(F.col(a), F.col(b)) <= (1 - least) * (short + long) + 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = []
            for x, y in zip(p[a], p[b]):
                m = difflib.SequenceMatcher(None, x, y)
                keep.append(m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least)
            yield p[keep]

    return near.mapInPandas(run, near.schema)


#: Names up to this length meet by places of letters, longer ones by pieces of these lengths, wherever they are.
PLACED, PIECES = 40, (4, 5)


def _edits(n: Column, m: Column) -> Column:
    """The most letters to put in or leave out between names of n and m letters alike in nine tenths; as odd as n + m."""
    most = F.floor(((n + m) / 10)).cast("int")
    return most - F.pmod(most + n + m, F.lit(2))


def _parts(n: Column) -> Column:
    """Parts of a name: one more than edits to any longer name (of at most n * 11 / 9 letters)."""
    return F.floor((n + F.floor(n * 11 / 9)) / 10).cast("int") + 1


def _alike_candidates(names: DataFrame) -> DataFrame:
    """(type, n1, n2): pairs of names (type, n) that may be alike in nine tenths, n1 < n2; none that is gets lost.

    The shorter one is cut into one part more than there can be edits.  Some part i is whole in the longer one with exactly i edits before
    it (the first part at which the edits up to its end are no more than its number), so it is moved by i, i - 2 ... -i letters,
    and the rest has room for the other edits.  Letters and how often they occur flip one bit of a sketch each, so sketches differ in at most as many bits as there are edits.
    """
    name, size = F.col("n"), F.col("len")

    def bit(p: Column) -> Column:
        letter, head = F.substring(name, p, F.lit(1)), F.substring(name, F.lit(1), p)
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(letter, F.length(F.replace(head, letter, F.lit(""))) - p), F.lit(64)).cast("int"))

    x = names.select("type", "n", F.length("n").alias("len"), F.xxhash64("type", "n").alias("id"))
    x = x.withColumn("sk", F.aggregate(F.sequence(F.lit(1), size), F.lit(0).cast("long"), lambda s, p: s.bitwiseXOR(bit(p))))

    def start(n: Column, i: Column) -> Column:
        return F.floor(i * n / _parts(n)).cast("int")

    def part(n: Column, i: Column, moved: Column) -> Column:
        return F.substring(name, start(n, i) + moved + 1, start(n, i + 1) - start(n, i))

    def placed(n: Column) -> Column:
        most = _edits(n, size)

        def of(i: Column) -> Column:
            fits = F.filter(F.sequence(-i, i, F.lit(2)), lambda d: (F.abs(size - n - d) <= most - i) & (start(n, i) + d >= 0) & (start(n, i + 1) + d <= size))
            return F.transform(fits, lambda d: F.xxhash64("type", n, i, part(n, i, d)))

        return F.flatten(F.transform(F.sequence(F.lit(0), most), of))

    def pieces(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), size - k + 1), lambda p: F.xxhash64("type", F.substring(name, p, F.lit(k))))

    own = F.transform(F.sequence(F.lit(0), _parts(size) - 1), lambda i: F.when(size <= PLACED, F.xxhash64("type", size, i, part(size, i, F.lit(0)))).otherwise(F.xxhash64("type", part(size, i, F.lit(0)))))
    low = F.ceil(size * 9 / 11).cast("int")  # letters of the shorter name
    near = F.when(low <= PLACED, F.flatten(F.transform(F.sequence(low, F.least(size, F.lit(PLACED))), placed))).otherwise(F.array().cast("array<bigint>"))
    far = F.when(size > PLACED, F.concat(*[pieces(k) for k in PIECES])).otherwise(F.array().cast("array<bigint>"))
    a = x.select(F.explode(F.array_distinct(own)).alias("k"), F.col("id").alias("ia"), F.col("len").alias("la"), F.col("sk").alias("sa"))
    b = x.select(F.explode(F.array_distinct(F.concat(near, far))).alias("k"), F.col("id").alias("ib"), F.col("len").alias("lb"), F.col("sk").alias("sb"))
    met = a.join(b, "k").where((F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("ia") < F.col("ib"))))
    pairs = met.where(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= _edits(F.col("la"), F.col("lb"))).select("ia", "ib").distinct()
    left, right = x.select(F.col("id").alias("ia"), "type", F.col("n").alias("x")), x.select(F.col("id").alias("ib"), F.col("type").alias("_t"), F.col("n").alias("y"))
    both = pairs.join(left, "ia").join(right, "ib").where("type = _t and x <> y")
    return both.select("type", F.least("x", "y").alias("n1"), F.greatest("x", "y").alias("n2"))


def name_duplicates(nodes: DataFrame, owner: str = "owner") -> DataFrame:
    """(a, b, reason): active nodes of one type, no categories, with equal names (equal), of people one name within the other
    (subset), or names alike by ratio (ratio).

    Equality and subsets are joined by name and by rarest token.  Names alike in nine tenths share a part of the shorter one at nearly
    the same place; these parts bring candidates together instead of all pairs of a type.
    """
    n = active(nodes).where("type <> 'category'").select("id", "type", X.integrity_name(F.col("name"), owner).alias("n")).where("n <> ''")
    a = n.select(F.col("id").alias("a"), "type", "n")
    b = n.select(F.col("id").alias("b"), "type", "n")
    equal = a.join(b, ["type", "n"]).where("a < b").select("a", "b", F.lit("equal").alias("reason"))
    people = n.where("type = 'person'").select("id", "n", F.array_distinct(F.split("n", " ")).alias("t"))
    token = people.select("id", "n", "t", F.explode("t").alias("w"))
    freq = token.groupBy("w").count()
    rare = token.join(freq, "w").groupBy("id").agg(F.min_by("w", F.struct("count", "w")).alias("w"), F.first("t").alias("t"), F.first("n").alias("n"))
    sub = rare.select(F.col("id").alias("x"), F.col("t").alias("tx"), F.col("n").alias("nx"), "w").join(token.select(F.col("id").alias("y"), F.col("t").alias("ty"), F.col("n").alias("ny"), "w"), "w").where((F.col("x") != F.col("y")) & (F.col("nx") != F.col("ny")) & (F.size(F.array_except("tx", "ty")) == 0))
    subset = sub.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("subset").alias("reason")).distinct()
    names = n.select("type", "n").distinct()
    alike = ratio_at_least(_alike_candidates(names), "n1", "n2")
    ratio = alike.join(a.withColumnRenamed("n", "n1"), ["type", "n1"]).join(b.withColumnRenamed("n", "n2"), ["type", "n2"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("ratio").alias("reason"))
    every = equal.unionByName(subset).unionByName(ratio)
    return every.groupBy("a", "b").agg(F.min("reason").alias("reason"))


def same_file(nodes: DataFrame, edges: DataFrame, file_nodes: DataFrame) -> DataFrame:
    """(a, b): active nodes of one type on the same entity file, linked by their own name, no parent and child."""
    loose = file_nodes.where("how in ('contains', 'inherited')").select(F.col("node_id").alias("id")).distinct()
    n = active(nodes).where("path is not null and path <> '' and type <> 'category'").where(X.file_kind(F.col("path")).isin(ENTITY_KINDS)).select("id", "type", "path").join(loose, "id", "left_anti")
    pairs = n.select(F.col("id").alias("a"), "type", "path").join(n.select(F.col("id").alias("b"), "type", "path"), ["type", "path"]).where("a < b").select("a", "b")
    return _kin(pairs, nodes, edges)


def compact_classes(nodes: DataFrame, owner: str = "owner") -> DataFrame:
    """(id, class_id, n): active nodes, no categories, of each name without spaces that two or more have, whatever their types; class_id is the smallest id.  As many rows as nodes, however many share a name."""
    x = active(nodes).where("type <> 'category'").select("id", X.compact_name(F.col("name"), owner).alias("k")).where("k <> ''")
    big = x.groupBy("k").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("n")).where("n > 1")
    return x.distinct().join(big, "k").select("id", "class_id", "n")


def same_compact_name(nodes: DataFrame, owner: str = "owner") -> DataFrame:
    """(a, b): active nodes, no categories, whose names are equal without spaces, whatever their types."""
    n = active(nodes).where("type <> 'category'").select("id", X.compact_name(F.col("name"), owner).alias("k")).where("k <> ''")
    return n.select(F.col("id").alias("a"), "k").join(n.select(F.col("id").alias("b"), "k"), "k").where("a < b").select("a", "b")


def without_marked(pairs: DataFrame, nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids without those whose names stand in `marked` (x, y) as different things, in any order and case."""
    low = nodes.select("id", F.lower(F.trim("name")).alias("n"))
    m = marked.select(F.lower(F.trim("x")).alias("x"), F.lower(F.trim("y")).alias("y")).select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()
    p = pairs.join(low.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(low.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return p.withColumn("lo", F.least("na", "nb")).withColumn("hi", F.greatest("na", "nb")).join(m, ["lo", "hi"], "left_anti").select(*pairs.columns)


def stale_claims(nodes: DataFrame, as_of: float, closed_loops: DataFrame | None = None, days: int = 30) -> DataFrame:
    """(id, name, phrase, age_days): claims that stopped being true; a cited closed loop first, then a date gone by, then old plans."""
    content = F.coalesce("content", F.lit(""))
    x = active(nodes).where("type <> 'category'").select("id", "name", content.alias("c"), F.floor((F.lit(as_of) - F.col("created_at")) / 86400).cast("int").alias("age_days"))
    x = x.withColumn("refs", F.array_distinct(F.regexp_extract_all("c", F.lit(X.LOOP_REF), F.lit(0))))
    if closed_loops is not None:
        cited = x.select("id", F.posexplode("refs").alias("p", "loop")).join(closed_loops.select(F.col("id").alias("loop")), "loop", "left_semi").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "loop"))), lambda s: s["loop"]), ", ").alias("cites"))  # as many as one text cites
        x = x.join(cited, "id", "left")
    else:
        x = x.withColumn("cites", F.lit(None).cast("string"))
    passed = D.passed_date(F.col("c"), as_of)
    plan = F.when((F.col("age_days") >= days) & ~F.col("c").rlike(X.DATED) & F.col("c").rlike(X.PLAN), F.regexp_extract("c", X.PLAN, 0))
    phrase = F.coalesce(F.concat(F.lit("cites closed "), F.col("cites")), passed, plan)
    return x.select("id", "name", phrase.alias("phrase"), "age_days").where("phrase is not null")


def report(nodes: DataFrame, edges: DataFrame, owner: str | None = None) -> DataFrame:
    """(finding, n) of all structural checks, zeros included."""
    base = parent_findings(nodes, edges, owner).select("finding").unionByName(crowded(nodes, edges, owner).select("finding"))
    for name, df in (("dangling_edge", dangling(nodes, edges)), ("redundant_link", redundant_links(edges)), ("misoriented", misoriented(nodes, edges)), ("category_link", category_links(nodes, edges)), ("fact_parent", fact_parents(nodes, edges))):
        base = base.unionByName(df.select(F.lit(name).alias("finding")))
    names = ["unrooted_category", "category_bad_parent", "orphan", "multi_parent", "under_identity", "legacy_task", "missing_embedding", "oversized", "flat_list", "dangling_edge", "redundant_link", "misoriented", "category_link", "fact_parent"]
    every = nodes.sparkSession.createDataFrame([(n,) for n in names], "finding string")
    return every.join(base.groupBy("finding").agg(F.count("*").alias("n")), "finding", "left").select("finding", F.coalesce("n", F.lit(0)).alias("n"))


def repaired(nodes: DataFrame, edges: DataFrame, owner: str, fallback: str) -> tuple[DataFrame, DataFrame]:
    """Edges after the ordered repairs, and (step, n); nodes are never deleted, and a second run changes nothing.

    Dangling edges go, passive ones are turned, redundant and category cross-links go, parents of the owner go, categories hang off the
    owner or one category, nodes under the owner and orphans move to the category `fallback`, of several parents one stays (a single
    one that is no category, else the newest), and of every cycle the link of its smallest node moves to the fallback.
    """
    from ..workspace import Workspace
    from . import hierarchy

    # Every step reads the one before several times, so each is stored.
    ws = Workspace(nodes.sparkSession, "repair")
    steps: list[tuple[str, DataFrame]] = []
    nodes = ws.save(nodes.select("id", "type", "archived"))
    cur = ws.save(edges)

    def less(name: str, ids: DataFrame) -> None:
        nonlocal cur
        gone = ws.save(ids.select("id").distinct())
        steps.append((name, gone))
        cur = ws.save(cur.join(gone, "id", "left_anti").select(*edges.columns))

    less("dangling", dangling(nodes, cur))
    steps.append(("oriented", ws.save(misoriented(nodes, cur).select("id"))))
    cur = ws.save(oriented(nodes, cur))
    less("redundant_links", redundant_links(cur))
    less("category_links", category_links(nodes, cur))
    less("root_parents", cur.where((F.col("relation") == "part_of") & (F.col("source_id") == owner)))
    t = nodes.select("id", "type")
    spine = cur.where("relation = 'part_of'").select("id", "source_id", "target_id", "created_at")
    typed = spine.join(t.select(F.col("id").alias("source_id"), F.col("type").alias("st")), "source_id").join(t.select(F.col("id").alias("target_id"), F.col("type").alias("tt")), "target_id")
    # What may stay: categories below the owner or categories; other nodes anywhere but below the owner.
    allowed = typed.where(F.when(F.col("st") == "category", (F.col("target_id") == owner) | (F.col("tt") == "category")).otherwise(F.col("target_id") != owner) & (F.col("source_id") != F.col("target_id")))
    per = allowed.groupBy("source_id").agg(F.count_distinct(F.when(F.col("tt") != "category", F.col("target_id"))).alias("plain"), F.max_by("target_id", F.struct("created_at", "target_id")).alias("newest"), F.max(F.when(F.col("tt") != "category", F.col("target_id"))).alias("one"), F.first("st").alias("st"))
    keep = ws.save(per.select("source_id", F.when((F.col("st") != "category") & (F.col("plain") == 1), F.col("one")).otherwise(F.col("newest")).alias("target_id")))
    kept = typed.join(keep, ["source_id", "target_id"], "left_semi")
    dropped = typed.join(kept.select("id"), "id", "left_anti")
    less("parents", dropped.select("id"))
    homeless = active(nodes).where(F.col("id") != owner).select("id", "type").join(keep.select(F.col("source_id").alias("id")), "id", "left_anti")
    # The fallback itself hangs off the owner.
    homes = ws.save(homeless.select("id", F.when(F.col("type") == "category", F.lit(owner)).otherwise(F.lit(fallback)).alias("target_id")))
    steps.append(("rehomed", homes.select("id")))

    def links_to(df: DataFrame) -> DataFrame:
        row = df.select(F.concat(F.lit("fix:"), F.col("id")).alias("id"), F.col("id").alias("source_id"), "target_id", F.lit("part_of").alias("relation"))
        return row.select(*[F.col(c) if c in row.columns else F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in edges.columns]).fillna({"weight": 1.0} if "weight" in edges.columns else {})

    cur = ws.save(cur.unionByName(links_to(homes)))
    # Cycles: every node has one parent now, so a cycle's nodes are those that reach themselves; cut at the smallest.
    tree = cur.where("relation = 'part_of'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")).distinct()
    lost = hierarchy.roots_and_depths(tree).where("depth = -1").select(F.col("node_id").alias("child"))
    loop = tree.join(lost, "child")
    low = cycle_members(loop)
    cuts = ws.save(low.groupBy("cycle").agg(F.min("id").alias("id")).select("id"))
    steps.append(("cycles", cuts))
    cur = cur.join(cuts.select(F.col("id").alias("source_id"), F.lit("part_of").alias("relation")), ["source_id", "relation"], "left_anti").select(*edges.columns).unionByName(links_to(cuts.where(F.col("id") != fallback).withColumn("target_id", F.lit(fallback))))
    audit = None
    for name, df in steps:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        audit = row if audit is None else audit.unionByName(row)
    return cur, audit


def cycle_members(loop: DataFrame) -> DataFrame:
    """(id, cycle) of the nodes on cycles of links (child, parent) whose nodes have one parent each; cycle is the smallest id on it.

    Leaves are peeled by doubling: after enough doublings every chain stands on its cycle.
    """
    from ..workspace import Workspace

    ws = Workspace(loop.sparkSession, "cycles")
    jump = ws.save(loop.select("child", F.col("parent").alias("at"), F.least("child", "parent").alias("low")))
    n, power = jump.count(), 1
    while power < n:
        nxt = ws.save(jump.alias("a").join(jump.alias("b"), F.col("a.at") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.at").alias("at"), F.least("a.low", "b.low").alias("low")))
        ws.drop(jump)
        jump, power = nxt, power * 2
    on = jump.select(F.col("at").alias("child")).distinct()  # where chains end up: exactly the cycles' nodes
    return jump.join(on, "child", "left_semi").select(F.col("child").alias("id"), F.col("low").alias("cycle"))
