import math

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import decay as D
from lodegraph.functions import text as X
from lodegraph.functions import vectors as V
from lodegraph.functions import vocab

DAY = 86400.0
NOW = 1780272000.0


def one(spark, expr, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<double>' if isinstance(v, list) else 'string'}" for n, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("w, life, days, imp, want", [(1.0, 60.0, 60, 0.0, 0.5), (1.0, 60.0, 120, 0.0, 0.25), (1.0, math.inf, 9999, 0.0, 1.0), (1.0, 7.0, 3650, 0.9, 0.135)])
def test_weight(spark, w, life, days, imp, want):
    got = one(spark, D.weight_at(F.col("w"), F.col("s"), F.col("h"), F.col("i"), NOW), w=w, s=NOW - days * DAY, h=life, i=imp)
    assert got == pytest.approx(want)


def test_importance_stretches(spark):
    assert one(spark, D.weight_at(F.col("w"), F.col("s"), F.col("h"), F.col("i"), NOW), w=1.0, s=NOW - 60 * DAY, h=60.0, i=1.0) > 0.85


def test_horizons(spark):
    left = D.days_left(F.col("w"), F.col("h"), F.col("i"))
    assert one(spark, left, w=0.2, h=7.0, i=0.0) == pytest.approx(7.0)
    assert one(spark, left, w=0.05, h=7.0, i=0.0) == 0.0
    assert one(spark, left, w=0.2, h=7.0, i=0.7) == math.inf
    assert one(spark, D.edge_half_life(F.col("n")), n=1) == pytest.approx(62.38, abs=0.01)


@pytest.mark.parametrize("text, want", [("Fair on June 3", True), ("Fair on May 28-30", False), ("Fair on May 30-June 2", True), ("Sep 19-20, 2026", True), ("Sept. 5", True), ("Feb 30", False), ("March 3, 2025", False), ("Version 9", False), (None, False), ("", False)])
def test_upcoming(spark, text, want):
    assert one(spark, D.upcoming(F.col("t"), NOW), t=text) is want


def test_demotion(spark):
    life = D.half_life(F.col("h"), F.col("k"), F.col("i"), F.col("c"), NOW)
    assert one(spark, life, h=math.inf, k="organization", i=0.3, c="") == 60.0
    assert one(spark, life, h=math.inf, k="category", i=0.0, c="") == math.inf
    assert one(spark, life, h=7.0, k="event", i=0.3, c="on July 9") == math.inf


@pytest.mark.parametrize("label, want", [("partner_of", "part_of"), ("relies on", "requires"), ("Is built upon", "relates_to"), ("builds", "builds_on"), ("is used by", "used_in"), ("Studied-By", "studied_by"), (None, "relates_to"), ("", "relates_to"), (" part of ", "part_of"), ("makes use of work", "works_at")])
def test_relations(spark, label, want):
    assert one(spark, vocab.relation(F.col("r")), r=label) == want


@pytest.mark.parametrize("raw, want", [("Team", "organization"), (None, "concept"), ("", "concept"), ("gadget", "concept"), (" Skill ", "skill")])
def test_types(spark, raw, want):
    assert one(spark, vocab.node_type(F.col("t")), t=raw) == want


@pytest.mark.parametrize("a, b, want", [("transformer", "transformers", True), ("art", "arts", False), ("plan", "planning", False), ("plans", "plan", True), ("x", "x", True)])
def test_stems(spark, a, b, want):
    assert one(spark, X.stem_equal(F.col("a"), F.col("b")), a=a, b=b) is want
    assert one(spark, X.stem_equal(F.col("b"), F.col("a")), a=a, b=b) is want


def plain_chunks(text, size):
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out, cur = [], ""
    for para in text.split("\n\n"):
        if len(para) > size:
            if cur.strip():
                out.append(cur.strip())
            cur = ""
            out += [para[i : i + size].strip() for i in range(0, len(para), size)]
            continue
        if cur and len(cur) + len(para) + 2 > size:
            out.append(cur.strip())
            cur = ""
        cur += para + "\n\n"
    return [c for c in [*out, cur.strip()] if c]


@pytest.mark.parametrize("text", ["", "  ", "short", "a" * 95 + "\n\n" + "b" * 30 + "\n\n" + "c" * 20, "\n\n".join("p" * n for n in (10, 39, 40, 41, 3, 80, 1))])
def test_chunks(spark, text):
    assert one(spark, X.chunks(F.col("t"), 40), t=text) == plain_chunks(text, 40)


def test_secrets(spark):
    assert one(spark, X.redact_secrets(F.col("t")), t="api_key=abcdef123 and " + "a1" * 20) == "api_key=[redacted] and [redacted]"
    assert one(spark, X.redact_secrets(F.col("t")), t=None) == ""


@pytest.mark.parametrize("name, want", [("New Project (Work)", True), ("the meeting", True), ("September 2026", True), ("Meeting with Person A", False), ("", False), (None, False), ("TBD", True)])
def test_vague(spark, name, want):
    assert one(spark, X.is_vague(F.col("n")), n=name) is want


def test_absorb(spark):
    a = X.absorbed(F.col("o"), F.col("n"))
    assert one(spark, a, o="Runs the club.", n="Treasurer of the rowing club since May") == "Runs the club. Treasurer of the rowing club since May."
    assert one(spark, a, o="Runs the club.", n="runs the club.") == "Runs the club."
    assert one(spark, a, o=None, n="New and fresh words") == "New and fresh words"
    long = one(spark, a, o="One old line. " * 45, n="Brand new closing statement with many other words " * 11)
    assert len(long) <= 600


def test_cut_and_window(spark):
    text = "First sentence is here. Second sentence goes on and on without any end in sight for long"
    got = one(spark, X.cut(F.col("t"), 30), t=text)
    assert got == "First sentence is here. …" and len(got) <= 30
    assert one(spark, X.cut(F.col("t"), 30), t="short") == "short"
    w = one(spark, X.window(F.col("t"), F.array(F.lit("goes")), 40), t=text)
    assert "goes" in w and len(w) <= 40


def test_cosine(spark):
    cos = V.cosine(F.col("a"), F.col("b"))
    assert one(spark, cos, a=[1.0, 0.0], b=[1.0, 0.0]) == 1.0
    assert one(spark, cos, a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    assert one(spark, cos, a=[1.0], b=[1.0, 0.0]) == 0.0
    assert one(spark, cos, a=[], b=[]) == 0.0


def test_legacy_vectors(spark):
    df = spark.createDataFrame([(b"[0.5, 1.0]",), (b"\x00\x00\x80?",), (None,), (b"abc",)], "b binary")
    assert [r[0] for r in df.select(V.decode(F.col("b"))).collect()] == [[0.5, 1.0], [1.0], None, None]


def test_keys_ignore_drift(spark):
    k = X.inbox_key(F.col("t"))
    assert one(spark, k, t="Send  the · Form.") == one(spark, k, t="send the - form")
    f = X.fact_key(F.col("t"))
    assert one(spark, f, t="It rains!") == one(spark, f, t="it  rains.")


def test_tolerant_json(spark):
    assert one(spark, X.tolerant_json(F.col("t"), "a int")["a"], t='Sure!\n```json\n{"a": 4}\n```') == 4
    assert one(spark, X.tolerant_json(F.col("t"), "a int"), t="no braces") is None


@pytest.mark.parametrize("path, kind, want", [("README.md", None, "note"), ("IDENTITY.md", None, "identity"), ("people/README.md", None, "readme"), ("people/a.md", "artifact", "person"), ("other/a.md", "Recipe", "recipe"), ("other/a.md", None, "note")])
def test_kinds(spark, path, kind, want):
    assert one(spark, X.file_kind(F.col("p"), F.col("k")), p=path, k=kind) == want


def test_absorbed_query_reads_whole_contents(spark, tmp_path):
    from lodegraph.plans import catalogue

    text = "The harbour opens early. " * 20 + "Boats leave at noon. Quartz lanterns shine brightly tonight"
    spark.createDataFrame([("n1", text)], "id string, content string").write.parquet(str(tmp_path / "nodes.parquet"))
    got = catalogue.queries()["b25_absorbed"](spark, str(tmp_path)).first()["content"]
    assert "Boats leave at noon" in got
