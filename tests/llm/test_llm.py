import math
import random
import re
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.functions.words import compact, words
from lodegraph.llm import chunks, cutoff, leaks, mixing, names, near, neighbours, pii, queries, survivors
from lodegraph.sources.tables import table

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import database, rows

WORD = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    assert rows(queries.queries()[name](spark, data).toPandas()) == rows(database(data).execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.columns and df.count() >= 0


# ---- survivors ----


def test_survivors_fields_ties_and_nulls(spark):
    rows_ = [("b", "x", "T-1", "one two", 5.0), ("a", "x", "t1", "two one", 5.0), ("c", "x", "T 1", None, 9.0), ("d", "y", "t1", "z", 1.0), ("e", "x", None, "q", 1.0), ("f", None, "t1", "q", 1.0), ("a", "x", "t1", "two one", 5.0), ("g", "y", "!!", "q", 1.0), ("h", "y", "", "r", 1.0)]
    df = spark.createDataFrame(rows_, "id string, type string, name string, content string, f double").withColumn("_id", F.lit("clash")).withColumn("group_id", F.lit(1))
    rule = [survivors.by_fitness("content", F.col("id"), F.size(F.array_distinct(words(F.col("content"))))), survivors.FieldRule("never", F.lit(1), F.lit(None).cast("double"))]
    got = survivors.winners(df, [F.col("type"), compact(F.col("name"))], F.col("id"), rule, F.lit(1.0)).collect()
    assert [tuple(r) for r in got] == [("a", "a", None)]
    assert survivors.winners(df.where("false"), [F.col("type")], F.col("id"), rule, F.lit(1.0)).count() == 0


def test_survivors_votes(spark):
    df = spark.createDataFrame([("1", "k", "A", 0.3), ("2", "k", "a", 0.3), ("3", "k", "B", 0.5)], "id string, k string, v string, w double")
    got = survivors.winners(df, [F.col("k")], F.col("id"), [survivors.FieldRule("v", F.lower("v"), F.lit(1.0))], F.col("w")).first()
    assert got["v_id"] == "1"
    vote = survivors.vote(F.col("s"), F.col("t"), 100 * 86400.0, {"good": 1.0}, 0.5, 50.0)
    assert [round(r[0], 4) for r in spark.createDataFrame([("good", 50 * 86400.0), ("bad", None), (None, 200 * 86400.0)], "s string, t double").select(vote).collect()] == [0.5, 0.5, 0.5]


# ---- near ----


def texts(seed, n=120):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        base = [r.choice(common) for _ in range(r.randint(25, 60))] + [f"rare{seed}_{i}", f"odd{i}"]
        out.append(base)
        if r.random() < 0.5:
            t = list(base)
            for _ in range(r.randint(0, 9)):
                k = r.randrange(len(t))
                t[k] = r.choice([f"x{r.randrange(9999)}", r.choice(common)])
            r.shuffle(t)
            out.append(t)
    return [(f"d{i:04}", " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("rare_df, share", [(None, 0.5), (3, 1.0)])
def test_near_equals_brute_force(spark, seed, rare_df, share):
    docs = texts(seed) + [("copy1", texts(seed)[0][1]), ("copy2", texts(seed)[0][1]), ("null", None), ("empty", ""), ("short", "a b c")]
    df = spark.createDataFrame(docs, "id string, text string").withColumn("cls", F.lit(0)).withColumn("toks", F.lit("x"))
    m, links = near.linked(near.word_sets(df, F.col("id"), [F.col("text")]), rare_df=rare_df, share_of_blocks=share)
    got = {(r["a_id"], r["b_id"]) for r in near.expand(m, links).collect()}
    sets = {i: set(WORD.findall((t or "").lower())) for i, t in docs}
    want = {(a, b) for a, b in combinations(sorted(i for i, s in sets.items() if len(s) >= 20), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got == want and want
    per = {r["id"]: r["copies"] for r in near.per_record(m, links).collect()}
    assert per["copy1"] == 3 and "short" not in per


def test_near_duplicates_of_common_words_are_certain(spark, tmp_path):
    """The registered query on records that share common words only and are as far apart as a link allows."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(1500):
        a = r.sample(vocab, 28)
        b = a[5:] + r.sample([w for w in vocab if w not in a], 4)
        rows += [(f"a{i}", None, " ".join(a)), (f"b{i}", None, " ".join(b))]
    spark.createDataFrame(rows, "id string, name string, content string").write.parquet(str(tmp_path / "nodes.parquet"))
    got = {(x["a_id"], x["b_id"]) for x in queries.p2_found(spark, str(tmp_path)).collect()}
    sets = [(i, set(t.split())) for i, _, t in rows]
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(sets, 2) if len(x & y) >= 0.7 * len(x | y)}
    assert len(want) >= 1500 and got == want, (len(want), len(got & want))


def test_near_empty_and_frequent_keys(spark):
    e = spark.createDataFrame([], "id string, text string")
    m, links = near.linked(near.word_sets(e, F.col("id"), [F.col("text")]))
    assert m.count() == 0 and links.count() == 0
    key = np.array([5] * 6 + [7] * 2, np.uint64)
    cls = np.arange(8)
    k, c, s, p = near.split_frequent(key, cls, cls.astype(np.uint64), cls.astype(np.uint64), np.array([5], np.uint64), np.array([3]))
    met = {tuple(sorted(x)) for g in np.unique(k) for x in combinations(c[k == g].tolist(), 2)}
    assert met >= set(combinations(range(6), 2)) and (6, 7) in met and not any(a < 6 <= b for a, b in met)


def test_frequent_keys_are_split_exactly(spark, monkeypatch):
    """A key that more records hold than one run compares: all of a third share their common words."""
    monkeypatch.setattr(near, "RUN", 40)
    r = random.Random(6)
    shared = [f"c{i}" for i in range(30)]
    docs = [(f"h{i:03}", " ".join([*shared, *(f"u{i}_{j}" for j in range(r.randint(1, 4)))])) for i in range(150)] + [(f"o{i:03}", " ".join(r.sample([f"v{j}" for j in range(90)], 30))) for i in range(300)]
    df = spark.createDataFrame(docs, "id string, text string").repartition(6)
    m, links = near.linked(near.word_sets(df, F.col("id"), [F.col("text")]), rare_df=20, share_of_blocks=1.0)
    got = {(x["a_id"], x["b_id"]) for x in near.expand(m, links).collect()}
    sets = [(i, set(t.split())) for i, t in docs]
    assert got == {(a, b) for (a, x), (b, y) in combinations(sets, 2) if len(x & y) >= 0.7 * len(x | y)} and len(got) > 10_000


def test_few_pairs_of_common_words_meet():
    """Work: of records of a small vocabulary few pairs are compared, and all similar ones are among them."""
    r = np.random.default_rng(2)
    often = 1 / np.arange(540, 20, -1)
    toks = [np.sort(r.choice(520, r.integers(25, 70), replace=False, p=often / often.sum())) for _ in range(1500)]
    toks += [np.sort(np.r_[t[3:], r.choice(np.setdiff1d(np.arange(520), t), 2, replace=False)]) for t in toks[:100]]
    names_of = np.sort(near.mix(np.arange(520, dtype=np.uint64), 5))
    offsets = np.r_[0, np.cumsum([len(t) for t in toks])]
    key, cls, _, pack = near.sketches(np.arange(len(toks)), offsets, names_of[np.concatenate(toks)].view(np.int64), names_of, np.arange(1, 521), 0.7, near.bands(20))
    side, met = (pack >> np.uint64(10)) & np.uint64(3), set()
    order = np.argsort(key)
    for g in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        met |= {(min(cls[x], cls[y]), max(cls[x], cls[y])) for x, y in combinations(g.tolist(), 2) if side[x] != side[y] or side[x] == 0}
    shared = {(i, 1500 + i): len(np.intersect1d(toks[i], toks[1500 + i])) for i in range(100)}
    similar = {(a, b) for (a, b), n in shared.items() if n >= 0.7 * (len(toks[a]) + len(toks[b]) - n)}
    assert len(similar) > 50 and similar <= met and len(met) < 0.2 * len(toks) ** 2 / 2, len(met)  # blocks of common words brought together 0.40 of all


def test_near_sizes_far_apart(spark):
    """Sets within other sets, at and beyond the threshold, up to sizes that sketches don't hold."""
    docs = [(f"s{n}", " ".join(f"w{i}" for i in range(n))) for n in (20, 25, 26, 28, 29, 31, 35, 36, 37, 40, 50, 51, 58, 716, 717, 1023, 1024, 1461, 1462, 2087)]
    df = spark.createDataFrame(docs, "id string, text string")
    for rare_df in (None, 3):
        m, links = near.linked(near.word_sets(df, F.col("id"), [F.col("text")]), rare_df=rare_df)
        got = {(x["a_id"], x["b_id"]) for x in near.expand(m, links).collect()}
        size = {i: len(t.split()) for i, t in docs}
        assert got == {tuple(sorted((a, b))) for a, b in combinations(size, 2) if min(size[a], size[b]) >= 0.7 * max(size[a], size[b])}


def test_sketch_is_a_lower_bound():
    r = np.random.default_rng(0)
    for _ in range(50):
        a = r.integers(0, 1 << 60, 40).astype(np.uint64)
        b = np.concatenate([a[:30], r.integers(0, 1 << 60, 12).astype(np.uint64)])
        h = np.concatenate([a, b])
        s1, s2 = near.parity_sketch(h, np.repeat([0, 1], [len(a), len(b)]), 2)
        assert np.bitwise_count(s1[0] ^ s1[1]) + np.bitwise_count(s2[0] ^ s2[1]) <= 22


# ---- personal information ----


@pytest.fixture(scope="module")
def weights():
    return pii.train(n=1500, rounds=4)


#: Sentences that share no wording with those the model is trained on.
OTHER_FRAMES = [
    "Yesterday evening {name} left a scarf in the hall.", "If it rains, phone us: {phone}.", "Her new flat is at {address}, third floor.", "For the visa they noted {idnum} on page two.", "Mails to {email} bounce since March.",
    "The choir thanked {name} for the flowers.", "Im Ordner liegt ein Zettel: {name}, {address}.", "On m'a donné ce numéro, {phone}, pour la clé.", "La carta vino de {address} sin sello.", "Whoever reads this should tell {name} that the boat is gone.", "His wallet held {idnum} and a stamp.", "Try {email}; the old one is dead.",
]
OTHER_PLAIN = ["Seat 44 in coach 7 was taken.", "The recipe needs 250 g of flour and 3 eggs.", "Chapter 12 ends on page 318.", "He ran 42 km in 3:58:12 last autumn.", "Der Zug um 17:42 fällt aus.", "Version 2.14.3 breaks the old plugin.", "We sold 1 200 tickets in 9 days.", "The Northern Line closes in May."]


def test_pii_held_out(weights):
    """Recall and precision on sentences of other wording, a third of them without items."""
    r = random.Random(77)
    tp = fp = fn = 0
    for _ in range(500):
        text, gold, at = "", [], 0
        frame = r.choice(OTHER_PLAIN) if r.random() < 0.34 else r.choice(OTHER_FRAMES)
        for m in re.finditer(r"\{(\w+)\}", frame):
            text += frame[at : m.start()]
            item = pii.MAKERS[m[1]](r)
            gold.append((len(text), len(text) + len(item), m[1]))
            text, at = text + item, m.end()
        text += frame[at:]
        found = {(s.start, s.end, s.kind) for s in pii.find(text, weights)}
        hit = {g for g in gold if any(k == g[2] and s < g[1] and e > g[0] for s, e, k in found)}
        tp, fn = tp + len(hit), fn + len(gold) - len(hit)
        fp += sum(not any(k == g[2] and s < g[1] and e > g[0] for g in gold) for s, e, k in found)
    assert tp / (tp + fn) > 0.93 and tp / (tp + fp) > 0.93, (tp, fn, fp)


def test_viterbi_is_best_subset(weights):
    for text, _ in pii.training_sentences(60, seed=3):
        c = pii.spans(text)
        if not 0 < len(c) <= 11:
            continue

        def value(chain):
            if any(a.end > b.start for a, b in zip(chain, chain[1:])):
                return -1e9
            return sum(pii.score(s, weights) for s in chain) + sum(weights.get(pii.step(a, b) or "", 0.0) for a, b in zip(chain, chain[1:]))

        best = max(value(list(x)) for n in range(len(c) + 1) for x in combinations(c, n))
        assert value(pii.decode(c, weights)) == pytest.approx(best)


def test_marginals_by_enumeration(weights):
    import math

    text = "Contact: Ann Berg, +44 20 7946 0326, a.berg@mail.example."
    c = pii.spans(text)[:9]
    z, p, _ = pii.marginals(c, weights)
    total, mass = 0.0, [0.0] * len(c)
    for n in range(len(c) + 1):
        for x in combinations(range(len(c)), n):
            s = [c[i] for i in x]
            if any(a.end > b.start for a, b in zip(s, s[1:])):
                continue
            w = math.exp(sum(pii.score(a, weights) for a in s) + sum(weights.get(pii.step(a, b) or "", 0.0) for a, b in zip(s, s[1:])))
            total += w
            for i in x:
                mass[i] += w
    assert z == pytest.approx(math.log(total)) and p == pytest.approx([m / total for m in mass])


def test_pii_redaction(spark):
    df = spark.createDataFrame([("1", "Call +44 20 7946 0326 or write to x@mail.example now."), ("2", None), ("3", ""), ("4", "Invoice 2025-29-8763 is still open."), ("5", "word " * 30_000 + "mail me: y@mail.example")], "id string, text string").withColumn("kind", F.lit("clash"))
    got = {r["id"]: r for r in pii.redact(df, "text").collect()}
    assert got["1"]["redacted"] == "Call [PHONE] or write to [EMAIL] now." and got["2"]["redacted"] is None and got["3"]["redacted"] == "" and got["4"]["n_items"] == 0 and got["5"]["redacted"].endswith("mail me: [EMAIL]") and got["1"]["kind"] == "clash"
    items = {(r["id"], r["item"]) for r in pii.detect(df.select("id", "text"), ["id"], "text").collect()}
    assert items == {("1", "+44 20 7946 0326"), ("1", "x@mail.example"), ("5", "y@mail.example")}
    assert pii.detect(df.where("false"), ["id"], "text").count() == 0


# ---- names ----

SAME = [("Robert Holtberg", "Bob Holtberg"), ("Robert Holtberg", "HOLTBERG, ROBERT"), ("Robert Holtberg", "R. Holtberg"), ("Robert Holtberg", "Dr. Robert Q. Holtberg"), ("Robert Holtberg", "Robert Holtbreg"), ("Jürgen Lindström", "Juergen Lindstroem"), ("Holtberg Research Institute", "Holtberg Res. Inst. Ltd."), ("Holtberg Research Institute", "The Holtberg Research Institute, e.V."), ("Savings Bank Nordfeld", "Nordfeld Svgs Bank")]
OTHER = [("Robert Holtberg", "Susan Holtberg"), ("Robert Holtberg", "S. Holtberg"), ("Robert Holtberg", "Robert Nordfeld"), ("Holtberg Research Institute", "Holtberg Medical Center"), ("Holtberg Research Institute", "Nordfeld Research Institute"), ("Robert T. Holtberg", "Robert T. Nordfeld"), ("Robert N. Holtberg", "Robert Nordfeld")]


@pytest.mark.parametrize("pair, want", [(p, True) for p in SAME] + [(p, False) for p in OTHER])
def test_names_verified(pair, want):
    kind = "organization" if any(w in pair[0] for w in ("Institute", "Bank")) else "person"
    a, b = (names.tokens(n, kind) for n in pair)
    w = {t: 6.0 if t[:4] in ("holt", "nord", "lind") else 2.0 for t in a + b}
    assert (names.same_person if kind == "person" else names.same_organisation)(a, b, w) is want


@pytest.mark.parametrize("a, b, d", [("abcd", "abdc", 1), ("abcd", "abcd", 0), ("abcd", "bcd", 1), ("holtberg", "hlotbegr", 2), ("abc", "xyz", 3)])
def test_edits(a, b, d):
    assert names.edits(a, b, 2) == d == names.edits(b, a, 2)


def test_names_of_common_tokens_meet(spark):
    """Every pair that verification accepts is found, with a hot family name and with tokens that all are common or short."""
    given = ["robert", "robbie", "bob", "richard", "rick", "r", "maria", "marta", "thomas", "tom", "stephen", "steven", "bogdan", "robertt", "tomas", "nartha"]
    persons = [f"{g} {m}smith" for g in given for m in ("", "j ", "q ")] + [f"{g} {f}" for g in given for f in ("smyth", "jones", "kowalski", "smitth")]
    persons += ["lee, max", "max lee", "xu smith", "smith xu", "li wei", "wei li", "robertson", "robert"]
    firms = [f"{a} {b} {c}".strip() for a in ("national", "natl", "general", "first") for b in ("bank", "trading", "tradng") for c in ("", "group", "grp", "services")] + ["abc mfg", "abc manufacturing", "first national bank trust", "national bank trust", "bank", "banks"]
    rows = [(f"{k}{i}", n, k) for k, every in (("person", persons), ("organization", firms)) for i, n in enumerate(every)]
    df = spark.createDataFrame(rows, "id string, name string, type string")
    _, links = names.linked(df, F.col("id"), F.col("name"), F.col("type"), common_df=3)
    got = {tuple(r) for r in links.collect()}
    toks = {(k, n): names.tokens(n, k) for _, n, k in rows}
    df_of = {}
    for (k, n), t in toks.items():
        for x in set(t):
            df_of[k, x] = df_of.get((k, x), 0) + 1
    want = set()
    for (k, a), (j, b) in combinations(sorted(toks), 2):
        if k == j:
            w = {x: math.log(1 + len(toks) / df_of[k, x]) for x in [*toks[k, a], *toks[k, b]]}
            if (names.same_person if k == "person" else names.same_organisation)(toks[k, a], toks[k, b], w):
                want.add((k, a, b))
    assert {("person", "robbie smith", "robert smith"), ("person", "lee, max", "max lee")} <= want and len(want) > 500
    assert got == want, (sorted(want - got)[:10], sorted(got - want)[:10])


def test_names_end_to_end(spark):
    people = [("1", "Robert Holtberg"), ("2", "Bob Holtbreg"), ("3", "Susan Holtberg"), ("4", "Robert Holtberg"), ("5", None), ("6", ""), ("7", "Zed")]
    df = spark.createDataFrame([(i, n, "person") for i, n in people] + [("8", "Robert Holtberg", "concept"), ("9", "Robert Holtberg", "organization")], "id string, name string, type string").withColumn("kind", F.lit("clash")).withColumn("a", F.lit(1))
    m, links = names.linked(df, F.col("id"), F.col("name"), F.col("type"))
    assert {(r["a_id"], r["b_id"]) for r in names.expand(m, links).collect()} == {("1", "2"), ("1", "4"), ("2", "4")}
    m, links = names.linked(df, F.col("id"), F.col("name"), F.col("type"), common_df=1)
    assert {(r["a_id"], r["b_id"]) for r in names.expand(m, links).collect()} >= {("1", "4")}
    m, links = names.linked(df.where("false"), F.col("id"), F.col("name"), F.col("type"))
    assert m.count() == 0 and links.count() == 0


def test_candidates_of_a_hot_name_are_few(spark):
    """One family name in a tenth of 20 000 names: of its pairs only those that share another token, or an initial, are candidates."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(n))
    people = [f"{word(4)} smith" for _ in range(2000)] + [f"{word(4)} {word(5)}" for _ in range(18_000)]
    df = spark.createDataFrame([(str(i), n, "person") for i, n in enumerate(people)], "id string, name string, type string")
    _, found = names.distinct_names(df, F.col("id"), F.col("name"), F.col("type"))
    from lodegraph.workspace import Workspace

    ws = Workspace(spark, "hot")
    found = ws.save(found)
    freq = found.select("kind", F.explode(F.array_distinct("toks")).alias("t")).groupBy("kind", "t").agg(F.count("*").alias("df"))
    pairs = freq.select("kind", "t", F.col("t").alias("u"))
    n = names.met_by_common(ws, found, freq, pairs, 50).count()
    assert n < 200_000  # all pairs of the name are two millions


def test_similar_tokens_equal_brute_force(spark):
    from lodegraph.workspace import Workspace

    r = random.Random(1)
    base = ["".join(r.choice("abcde") for _ in range(r.randint(3, 9))) for _ in range(60)]
    vocab = sorted(set(base) | {w[:1] + w[2:] for w in base} | {w[1:2] + w[:1] + w[2:] for w in base})
    df = spark.createDataFrame([("person", w) for w in vocab], "kind string, t string")
    got = {(x["t"], x["u"]) for x in names.similar_tokens(Workspace(spark, "t"), df).collect()}
    want = {(a, b) for a in vocab for b in vocab if a == b or names.edits(a, b, names.allowed(a, b)) <= names.allowed(a, b)}
    assert got == want


# ---- chunks ----


@pytest.mark.parametrize("text", ["a" * 9000, "word " * 3000, "Sentence one. " * 900, "\n\n".join("para %d " % i * 40 for i in range(60)), "# A\n" + "line\n" * 2000 + "# B\n" + "x" * 5000, "🙂 ü " * 3000])
def test_pieces(text):
    p = chunks.pieces(text, 4000, 200)
    assert all(len(x) <= 4000 and 0 <= k <= 200 for x, k in p)
    assert "".join(x[k:] for x, k in p) == text
    for (x, _), (y, k) in zip(p, p[1:]):
        assert x.endswith(y[:k])
    if " " in text or "\n" in text:
        long = max(map(len, re.split(r"\s+", text)))
        assert long > 3800 or all(x[-1].isspace() for x, _ in p[:-1])


def test_split_table(spark):
    df = spark.createDataFrame([("1", "w " * 2500), ("1", "w " * 2500), ("2", "w " * 2000), ("3", None), ("4", ""), ("5", "y" * 4001)], "id string, raw string").withColumn("piece", F.lit(1))
    got = chunks.split(df, F.col("id"), F.col("raw")).collect()
    assert {(r["log_id"], r["piece_no"]) for r in got} == {("1", 0), ("1", 1), ("5", 0), ("5", 1)} and len(got) == 4
    assert chunks.split(df.where("false"), F.col("id"), F.col("raw")).count() == 0
    with pytest.raises(ValueError):
        chunks.split(df, F.col("id"), F.col("raw"), 100, 100)


# ---- neighbours ----


def brute_neighbours(keys, x, k, least):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(keys)):
        order = sorted((-s[i, j], keys[j]) for j in range(len(keys)) if j != i and s[i, j] >= least)
        out |= {tuple(sorted((keys[i], b))) for _, b in order[:k]}
    return out


def test_neighbours_recall_and_copies(spark):
    r = np.random.default_rng(4)
    centre = r.normal(size=(150, 16))
    x = np.concatenate([centre + r.normal(size=centre.shape) * s for s in (0.0, 0.12, 0.2)] + [np.repeat(centre[:1], 9, axis=0)])
    keys = [f"k{i:04}" for i in range(len(x))]
    data = [(k, [float(a) for a in v]) for k, v in zip(keys, x.astype(np.float32))]
    bad = [("n", None), ("z", [0.0] * 16), ("short", [1.0] * 8), (None, [1.0] * 16), ("nan", [float("nan")] * 16)]
    df = spark.createDataFrame(data + bad + data[:3], "key string, e array<double>").withColumn("v", F.lit(1)).withColumn("cls", F.lit(1))
    v = neighbours.usable(df, F.col("key"), F.col("e"), 16)
    assert v.count() == len(keys)
    links = neighbours.links(v, 16, k=5, least=0.88, per_line=40)
    got = {(a["a_key"], a["b_key"]) for a in neighbours.pairs(links).collect()}
    want = brute_neighbours(keys, x.astype(np.float32).astype(float), 5, 0.88)
    assert len(got & want) / len(want) >= 0.9 and len(got - want) <= 0.02 * len(got)
    assert links.groupBy("key").count().where("count > 5").count() == 0
    assert neighbours.links(v.where("false"), 16).count() == 0 and neighbours.links(v.where("key = 'k0001'"), 16).count() == 0


@pytest.mark.parametrize("alike", [0.95, 0.9, 0.8])
def test_neighbours_in_a_crowd(spark, monkeypatch, alike):
    """A third of all vectors in one group, which many lines cut and which fills several blocks."""
    monkeypatch.setattr(neighbours, "BLOCK", 600)
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    crowd = alike**0.5 * unit(r.normal(size=(1, 64))) + (1 - alike) ** 0.5 * unit(r.normal(size=(1500, 64)))
    rest = unit(r.normal(size=(1500, 64)))
    x = unit(np.concatenate([crowd, rest, rest + 0.04 * r.normal(size=rest.shape)])).astype(np.float32)
    keys = [f"k{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in zip(keys, x)], "key string, e array<double>")
    got = {(a["a_key"], a["b_key"]) for a in neighbours.pairs(neighbours.links(neighbours.usable(df, F.col("key"), F.col("e"), 64), 64, k=5, least=0.88, per_line=30)).collect()}
    want = brute_neighbours(keys, x.astype(float), 5, 0.88)
    inside = lambda pairs: {p for p in pairs if p[1] < "k1500"}
    assert len(inside(got) & want) >= 0.99 * len(inside(want)) and len(got & want) >= 0.98 * len(want)
    assert len(got - want) <= 0.01 * len(want)


def test_recall_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    v = queries._vectors(spark, d).toPandas()
    want = brute_neighbours(list(v["key"]), np.array(v["v"].tolist(), float), 5, 0.88)
    got = {(a["a_key"], a["b_key"]) for a in queries.p7_found(spark, d).collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.01 * len(want)


# ---- leaks ----


def test_leaks_equal_brute_force(spark):
    r = random.Random(2)
    vocab = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(5, 40)))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(80):
        w = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        if d % 3 == 0:
            src = items[r.randrange(30)][1].split()
            a = r.randrange(max(1, len(src) - 13))
            w[5:5] = src[a : a + r.randint(10, 16)]
        docs.append((d, ", ".join(w).upper()))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leaks.find(df, F.col("doc_id"), F.col("text"), it, F.col("item_id"), F.col("text"), batch_words=500).collect()}

    def windows(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    assert got == {(d, i) for d, t in docs for i, u in items if windows(t) & windows(u)} and got
    assert leaks.find(df.where("false"), F.col("doc_id"), F.col("text"), it, F.col("item_id"), F.col("text")).count() == 0
    assert leaks.find(df, F.col("doc_id"), F.col("text"), it.where("false"), F.col("item_id"), F.col("text")).count() == 0


def test_leaks_with_changed_words_equal_brute_force(spark):
    """All passages with equal words at equal places that weigh enough are found, and one with a word put in."""
    r = random.Random(5)
    vocab = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab[: 60 if i % 3 else 400]) for _ in range(24))) for i in range(40)]
    docs = []
    for d in range(160):
        src = items[d % 40][1].split()
        for place in range(d % 11, 24, r.choice([4, 6, 11])):
            src[place] = r.choice(vocab)
        docs.append((d, " ".join(r.choice(vocab) for _ in range(20)) + " " + " ".join(src) + " end"))
    whole = items[0][1].split()[:12]
    docs.append((900, " ".join([*whole[:7], "inserted", *whole[7:]])))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["best"] for x in leaks.find(df, F.col("doc_id"), F.col("text"), it, F.col("item_id"), F.col("text"), similarity=0.8, batch_words=900).collect()}
    has = Counter(w for _, t in items for w in set(t.split()))
    want = {}
    for d, t in docs:
        w = t.split()
        for i, u in items:
            v = u.split()
            for a in range(len(v) - 11):
                weight = [math.log(1 + len(items) / has[x]) for x in v[a : a + 12]]
                for b in range(len(w) - 11):
                    share = sum(g for g, x, y in zip(weight, v[a : a + 12], w[b : b + 12]) if x == y) / sum(weight)
                    if share >= 0.8:
                        want[d, i] = max(want.get((d, i), 0), share)
    assert len(want) > 80 and set(want) <= set(got) and all(got[k] >= x - 1e-6 for k, x in want.items())
    assert (900, 0) in got and len(set(got) - set(want)) <= 0.1 * len(want)


@pytest.mark.parametrize("similarity", [1.0, 0.8])
def test_items_in_portions_give_the_same(spark, monkeypatch, similarity):
    r = random.Random(9)
    vocab = [f"t{i}" for i in range(90)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(25)]
    docs = [(d, " ".join(r.choice(vocab) for _ in range(9)) + " " + " ".join(items[d % 25][1].split()[d % 7 : d % 7 + 11 + d % 9])) for d in range(60)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    run = lambda: {tuple(x) for x in leaks.find(df, F.col("doc_id"), F.col("text"), it, F.col("item_id"), F.col("text"), similarity=similarity).collect()}
    one = run()
    monkeypatch.setattr(leaks, "PORTION", 800)
    assert run() == one and one


def test_fingerprints_of_rows():
    h = np.random.default_rng(1).integers(0, 1 << 63, 40).astype(np.uint64)
    assert (leaks.simhash_rows(np.lib.stride_tricks.sliding_window_view(h, 12)) == leaks.simhash(h, 12)).all()


def test_multi_index_guarantees_the_radius():
    r = np.random.default_rng(3)
    index = leaks.ItemIndex([(1, " ".join(f"a{i}" for i in range(60)))], 12, 3)
    p = index.prints.copy()
    for i in range(len(p)):
        for b in r.choice(64, 3, replace=False):
            p[i] ^= np.uint64(1) << np.uint64(b)
    a, c = index.near(p)
    assert set(zip(range(len(p)), range(len(p)))) <= set(zip(a.tolist(), c.tolist()))


def test_simhash_by_definition():
    h = np.random.default_rng(0).integers(0, 1 << 63, 30).astype(np.uint64)
    p = leaks.simhash(h, 5)
    for i in range(len(p)):
        for b in range(64):
            assert (int(p[i]) >> b) & 1 == (sum((int(x) >> b) & 1 for x in h[i : i + 5]) > 2)


# ---- mixing ----


def test_bisection():
    e, w = mixing.temperature([1000, 100, 10], [1, 4, 4], 1000.0)
    assert 0 < e < 1 and all(x * 1000 <= s * r + 1e-3 for x, s, r in zip(w, [1000, 100, 10], [1, 4, 4]))
    e2, w2 = mixing.temperature([1000, 100, 10], [100, 100, 1000], 500.0, target_entropy=0.8)
    assert mixing.entropy(w2) == pytest.approx(0.8, abs=1e-6)
    assert mixing.tempered([0.5, 0.5, 0.0], 0.3) == [0.5, 0.5, 0.0]


def test_mixture_of_budgets(spark):
    r = random.Random(0)
    docs = spark.createDataFrame([(i, "big" if i < 700 else "small", r.randint(1, 30)) for i in range(760)], "doc_id long, source string, n_tokens long").withColumn("uses", F.lit(9)).select("doc_id", "source", "n_tokens")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("none", 0.2, 3), ("none", 0.2, 3)], "source string, target_share double, max_repeats int").dropDuplicates()
    sizes = mixing.source_sizes(docs, t)
    plans = mixing.plan(sizes, budget=6000)
    used = mixing.realise(docs, plans)
    by = {x["source"]: x for x in mixing.report(spark, plans, used).collect()}
    assert by["none"]["short"] and by["none"]["reached_tokens"] == 0 and by["small"]["most_uses"] <= 4 and by["big"]["most_uses"] == 1
    for s in ("big", "small"):
        take = next(p["take"] for p in plans if p["source"] == s)
        assert abs(take - by[s]["reached_tokens"]) <= 2  # topped up by texts of the size that is missing
    small = {x["uses"] for x in used.where("source = 'small'").collect()}
    assert max(small) - min(small) <= 1
    assert {tuple(x) for x in used.collect()} == {tuple(x) for x in mixing.realise(docs.repartition(5), plans).collect()}


def test_weights_by_bisected_exponent():
    targets = [0.5, 0.3, 0.15, 0.05, 0.0]
    e, w = mixing.for_entropy(targets, mixing.entropy(targets))
    assert e == pytest.approx(1, abs=1e-6) and w == pytest.approx(targets, abs=1e-9)
    e, w = mixing.for_entropy(targets, 1.3)
    assert 0 < e < 1 and mixing.entropy(w) == pytest.approx(1.3, abs=1e-6) and w[4] == 0
    sizes = [{"source": s, "target_share": t, "max_repeats": 2, "texts": 5, "tokens": n} for s, t, n in (("a", 0.5, 100), ("b", 0.3, 400), ("c", 0.2, 50), ("d", 0.0, 10))]
    plans = {p["source"]: p for p in mixing.plan(sizes)}
    assert plans["a"]["short"] and plans["c"]["short"] and not plans["b"]["short"] and plans["a"]["want"] == pytest.approx(280)
    even = mixing.plan(sizes, budget=mixing.held_budget(sizes))
    assert not any(p["short"] for p in even) and sum(p["take"] for p in even) == pytest.approx(400)


def test_large_texts_fill_a_small_budget(spark):
    """A budget that whole texts meet badly: the nearest ones fill it up, and the mixture stays within one percent."""
    docs = spark.createDataFrame([(i, "s", n) for i, n in enumerate([400, 390, 380, *range(1, 90)] + [500] * 40)], "doc_id long, source string, n_tokens long")
    sizes = mixing.source_sizes(docs, spark.createDataFrame([("s", 1.0, 3)], "source string, target_share double, max_repeats int"))
    for budget in (1000, 1777, 23456, 60000):
        got = mixing.realise(docs, mixing.plan(sizes, budget=budget)).collect()
        assert abs(sum(r["n_tokens"] * r["uses"] for r in got) - budget) <= 0.01 * budget and max(r["uses"] for r in got) <= 3 and len(got) == len({r["doc_id"] for r in got})


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id int, t string")
    assert [r["n_tokens"] for r in mixing.with_tokens(df, "t").orderBy("doc_id").collect()] == [2, 0, 0]


# ---- cut-off texts ----

ENDINGS = {
    "It was done.": "closed", 'He said "stop."': "closed", "It was do": "open", "The rest is [truncated]": "mark", "The rest of the wor…": "mark", "All done. More later…": "trailing", "It is done. We shall see...": "trailing", "Text.\n\n#tag #other": "line", "Text.\n\ntopics/a-b.md": "line",
    "Text.\n- [ ] buy bread": "line", "Text.\n\nBest, the owner": "line", "```\nx = 1\n```": "line", "```\nx = 1": "open", "Total: 12 boxes": "line", "Text.\r\n\r\nViele Grüße  \n": "line", "  \n ": "none", "": "none", None: "none", "A\nT": "open", "(end of note)": "line", "Text.\n- Le projet relie le jardin et la note à la fin": "item",
}


def test_endings(spark):
    df = spark.createDataFrame([(t,) for t in ENDINGS], "t string")
    got = {r["t"]: r["e"] for r in cutoff.ends(df, F.col("t")).select("t", cutoff.ending().alias("e")).collect()}
    assert got == ENDINGS


def test_spikes_and_flags(spark):
    r = random.Random(0)
    rows_ = [(i, "cap", ("word " * 40)[:100]) for i in range(30)] + [(100 + i, "cap", "done " * r.randint(1, 18) + "end.") for i in range(40)] + [(200, None, "cut of"), (201, None, None), (202, "free", "fine."), (203, "cap", ("word " * 40)[:98] + "d."), (204, "cap", "x " * 45 + "\n\n#tag #hal")]
    df = spark.createDataFrame(rows_, "doc_id int, src string, text string").withColumn("ending", F.lit("clash")).withColumn("source", F.lit("other"))
    f = {x["rec_id"]: x for x in cutoff.flagged(df, F.col("doc_id"), F.col("text"), F.col("src")).collect()}
    assert len(f) == len(rows_) and all(f[i]["truncated"] and f[i]["at_limit"] for i in range(30)) and not any(f[100 + i]["truncated"] for i in range(40))
    assert f[200]["truncated"] and not f[201]["truncated"] and not f[202]["truncated"] and not f[203]["truncated"]
    assert {f[i]["cause"] for i in range(30)} == {"limit"} and f[200]["cause"] == "ending" and f[201]["cause"] is None
    rate = {x["source"]: (x["n_texts"], x["n_truncated"]) for x in cutoff.rates(cutoff.flagged(df, F.col("doc_id"), F.col("text"), F.col("src"))).collect()}
    assert rate["free"] == (1, 0) and rate[None] == (2, 1)
    assert cutoff.flagged(df.where("false"), F.col("doc_id"), F.col("text"), F.col("src")).count() == 0


def test_extra_columns_and_long_texts(spark):
    long = "steady words follow each other here " * 20_000
    df = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("rec_id", F.lit("x"))
    assert cutoff.flagged(df, F.col("doc_id"), F.col("text"), F.lit("s")).where("truncated").count() == 2
    m, links = near.linked(near.word_sets(df.withColumn("id", F.col("doc_id").cast("string")), F.col("id"), [F.col("text")], least=3))
    assert {(r["a_id"], r["b_id"]) for r in near.expand(m, links).collect()} == {("1", "2")}


def test_nothing_outside_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2] / "lodegraph"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("lodegraph.llm", "llm") or "import" not in "".join(x for x in p.read_text().splitlines() if "llm" in x)
    assert Counter(map(str, root.rglob("llm"))).total() >= 1
