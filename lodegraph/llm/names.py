"""Problem 5: variant spellings of names typed by people.

Distinct names are joined, not rows.  Their rare tokens (family names, proper parts of organisations) are joined by a prefix
filter on q-grams: tokens within e edits lose at most 3e of their bigrams, so the 3e + 1 rarest must hold a shared
one.  Names that meet over such tokens are verified by a soft token similarity in which rare tokens weigh more.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from itertools import combinations, product

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

# Given names and their short forms.
NICKNAMES = {
    "abigail": ["abby", "gail"], "alexander": ["alex", "sandy", "xander"], "alfred": ["alf", "alfie"], "andrew": ["andy", "drew"],
    "anthony": ["tony"], "arthur": ["art"], "barbara": ["barb", "babs"], "benjamin": ["ben", "benny"], "catherine": ["cathy"],
    "charles": ["charlie", "chuck"], "christopher": ["chris"], "daniel": ["dan", "danny"], "david": ["dave", "davy"],
    "deborah": ["deb", "debbie"], "dorothy": ["dot", "dottie", "dolly"], "edward": ["ed", "eddie", "ned", "ted"],
    "elizabeth": ["liz", "lizzie", "beth", "betty", "eliza"], "florence": ["flo", "florrie", "flossie"], "francis": ["frank"],
    "frederick": ["fred", "freddy", "freddie"], "gerald": ["gerry"], "gregory": ["greg"], "harold": ["hal", "harry"],
    "henry": ["hank"], "jacob": ["jake"], "james": ["jim", "jimmy", "jamie"], "jennifer": ["jen", "jenny"], "john": ["jack", "johnny"],
    "jonathan": ["jon", "jonny"], "joseph": ["joe", "joey"], "judith": ["judy"], "katherine": ["kate", "kathy", "katie", "kit"],
    "kenneth": ["ken"], "lawrence": ["larry", "laurie"], "leonard": ["len", "lenny", "leo"], "margaret": ["maggie", "meg", "peggy", "marge"],
    "matthew": ["matt"], "michael": ["mike", "mick", "mickey"], "nathaniel": ["nate", "nathan"], "nicholas": ["nick", "nicky"],
    "pamela": ["pam"], "patricia": ["pat", "patty", "trish"], "peter": ["pete"], "philip": ["phil"], "raymond": ["ray"],
    "rebecca": ["becca", "becky"], "richard": ["dick", "rick", "rich", "richie"], "robert": ["bob", "bobby", "rob", "robbie", "bert"],
    "ronald": ["ron"], "samuel": ["sam"], "stephen": ["steve", "stevie"], "steven": ["steve"], "susan": ["sue", "susie", "suzy"],
    "tabitha": ["tabby"], "theodora": ["dora", "thea", "theo"], "theodore": ["theo"], "thomas": ["tom", "tommy"], "timothy": ["tim", "timmy"],
    "victoria": ["vicky", "tori"], "vincent": ["vince"], "walter": ["walt", "wally"], "william": ["bill", "billy", "will", "willy"],
    "zachary": ["zach", "zack"],
}
# Titles, legal forms and filler words that tell nobody apart.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "herr", "frau", "dipl", "ing", "phd", "md", "jr", "sr", "monsieur", "madame", "señor", "señora"}
LEGAL = {"ltd", "limited", "llc", "llp", "lp", "inc", "incorporated", "corp", "corporation", "plc", "gmbh", "mbh", "ag", "kg", "ohg", "sa", "sas", "sarl", "srl", "spa", "bv", "nv", "ab", "oy", "as", "ev", "eg", "pty", "the", "of", "and", "und", "der", "die", "das"}
FOLDS = str.maketrans({"ß": "ss", "æ": "ae", "ø": "o", "œ": "oe", "ł": "l", "đ": "d", "ı": "i"})
FORMAL = {short: {full for full, s in NICKNAMES.items() if short in s} for s in NICKNAMES.values() for short in s}

KNOWN_GIVEN = set(NICKNAMES) | set(FORMAL)


def fold(name: str) -> str:
    """Lower case without accents; "oe" for "ö" is then one edit."""
    return "".join(c for c in unicodedata.normalize("NFKD", name.lower().translate(FOLDS)) if not unicodedata.combining(c))


def tokens(name: str, kind: str) -> list[str]:
    """Tokens of a folded name without titles, legal forms and dots in abbreviations; all of them if nothing else is left."""
    text = fold(name)
    text = regex.sub(r"\b(\p{L})\.\s?(\p{L})\.(?:\s?(\p{L})\.)?(?=\s|,|$)", lambda m: "".join(x for x in m.groups() if x), text) if kind == "organization" else text
    raw = regex.findall(r"[\p{L}\p{N}]+", text)
    drop = TITLES if kind == "person" else LEGAL
    return [t for t in raw if t not in drop] or raw


def edits(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours counting once; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            now[j] = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], two[j - 2] + 1)
        if min(now) > most and (two is None or min(one) > most):
            return most + 1
        two, one = one, now
    return min(one[-1], most + 1)


def allowed(a: str, b: str) -> int:
    """Edits that a typist may have made in two spellings of a token."""
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 6 else 2


def shortened(a: str, b: str) -> bool:
    """One is an abbreviation of the other: same first letter, letters in order, at least two and clearly fewer."""
    s, w = (a, b) if len(a) < len(b) else (b, a)
    if len(s) < 2 or s[0] != w[0] or len(s) > len(w) - 2:
        return False
    it = iter(w)
    return all(c in it for c in s)


def alike(a: str, b: str, kind: str) -> float:
    """Similarity of two tokens: 1 equal, less for short forms, abbreviations, initials and typing errors, 0 for others."""
    if a == b:
        return 1.0
    if kind == "person":
        fa, fb = FORMAL.get(a, {a}) | {a}, FORMAL.get(b, {b}) | {b}
        if fa & fb:
            return 0.95
        if len(a) == 1 or len(b) == 1:
            return 0.6 if a[0] == b[0] or (len(a) == 1 and any(x[0] == a for x in fb)) or (len(b) == 1 and any(x[0] == b for x in fa)) else 0.0
        d = edits(a, b, allowed(a, b))
        if d <= allowed(a, b):
            return 0.95 - 0.05 * d
        # a short form with a typing error of its own
        return 0.8 if any(edits(x, y, 1) <= 1 for x in fa for y in fb if min(len(x), len(y)) >= 5) else 0.0
    if shortened(a, b):
        return 0.9
    d = edits(a, b, allowed(a, b))
    if d <= allowed(a, b):
        return 0.95 - 0.05 * d
    # an abbreviation with a typing error: shorter words only
    s, w = (a, b) if len(a) < len(b) else (b, a)
    if 3 <= len(s) <= 5 < len(w) and any(shortened(s[:i] + s[i + 1 :], w) for i in range(1, len(s)) if len(s) > 3):
        return 0.7
    return 0.0


def soft_similarity(a: list[str], b: list[str], weight: dict[str, float], kind: str) -> tuple[float, float, list[tuple[str, str, float]]]:
    """Weighted share of matched tokens of the name that has less to match, of both names, and the matches, best first."""
    found = sorted(((alike(x, y, kind), -i - j, i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    used_a, used_b, match = set(), set(), []
    for s, _, i, j in found:
        if s > 0 and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            match.append((a[i], b[j], s))
    w = lambda t: weight.get(t, 1.0) * (0.2 if len(t) == 1 else 1.0)
    got = sum(s * min(w(x), w(y)) if len(x) > 1 and len(y) > 1 else s * 0.2 for x, y, s in match)
    wa, wb = sum(map(w, a)), sum(map(w, b))
    return got / max(1e-9, min(wa, wb)), 2 * got / max(1e-9, wa + wb), match


#: How much more the rarest token of a name may weigh than an ordinary one, and the least similarity of two names of one person.
HEAVIEST, LEAST_PERSON = 3.0, 0.74


def person_similarity(a: list[str], b: list[str], weight: dict[str, float]) -> tuple[float, int]:
    """Soft weighted similarity of two names of persons, and how many tokens match.

    The weight of matched tokens by how alike they are, as a share of the weight of the name that has less to match.  Rare
    tokens (family names) weigh up to three times as much as common ones (given names), initials as little as the commonest.
    Tokens of that name that nothing matches count as nothing.
    """
    _, _, match = soft_similarity(a, b, weight, "person")
    lightest = min(weight.get(t, 1.0) for t in (*a, *b))
    w = lambda t: 1.0 if len(t) == 1 else min(HEAVIEST, max(1.0, weight.get(t, 1.0) / lightest))
    short = lambda x, y: len(x) == 1 or len(y) == 1
    pair = lambda x, y: 1.0 if short(x, y) else max(w(x), w(y))
    got = sum(s * pair(x, y) for x, y, s in match)

    def whole(name: list[str], side: int) -> float:
        left, total = list(name), 0.0
        for m in match:
            left.remove(m[side])
            total += w(m[side]) if short(m[0], m[1]) else pair(m[0], m[1])
        return total + sum(w(t) if len(t) > 1 else 0.5 for t in left)

    return got / max(1e-9, min(whole(a, 0), whole(b, 1))), len(match)


def same_person(a: list[str], b: list[str], weight: dict[str, float]) -> bool:
    """The same tokens in any order, or two matches at least (a family name alone is nobody's) and enough similarity."""
    if sorted(a) == sorted(b):
        return True
    score, n = person_similarity(a, b, weight)
    return n >= 2 and score >= LEAST_PERSON


def same_organisation(a: list[str], b: list[str], weight: dict[str, float]) -> bool:
    """All tokens but little weight match, and the proper part is not all that does."""
    if sorted(a) == sorted(b):
        return True
    low, both, match = soft_similarity(a, b, weight, "organization")
    if len(match) < 2 and (len(a) > 1 or len(b) > 1):
        return False
    unmatched = max(len(a), len(b)) - len(match)
    return low >= 0.72 and both >= 0.68 and unmatched <= (1 if max(len(a), len(b)) > 3 else 0)


def distinct_names(df: DataFrame, rec_id: Column, name: Column, kind: Column) -> tuple[DataFrame, DataFrame]:
    """Membership (id, kind, name) and distinct names (kind, name, toks); null, empty and wordless names and kinds other than person and organization are left out."""
    members = df.select(rec_id.cast("string").alias("id"), kind.cast("string").alias("kind"), F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")).alias("name")).where("id is not null and name <> '' and kind in ('person', 'organization')").distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["toks"] = [tokens(n, k) for n, k in zip(b["name"], b["kind"])]
            yield b[b["toks"].map(len) > 0]

    return members, members.select("kind", "name").distinct().mapInPandas(split, "kind string, name string, toks array<string>")


def parts(df: DataFrame, rows: int = 20_000) -> int:
    """Parts for a stored table whose rows are few bytes but much work; a part that is chosen by bytes would be too large."""
    return max(df.sparkSession.sparkContext.defaultParallelism * 2, -(-df.count() // rows))


def similar_tokens(ws: Workspace, vocab: DataFrame) -> DataFrame:
    """(kind, t, u): tokens of a vocabulary (kind, t) within the allowed edits, both ways round and with themselves.

    Bigrams with padding; the 3e + 1 globally rarest of a token, for e allowed edits, are its prefix.  Places of shared bigrams
    differ by at most e.
    """
    gram = F.expr("transform(sequence(0, length(t)), i -> struct(substring(concat('^', t, '$'), i + 1, 2) as g, i as at))")
    v = vocab.withColumn("e", F.when(F.length("t") < 4, 0).when(F.length("t") < 6, 1).otherwise(2))
    grams = v.where("e > 0").select("kind", "t", "e", F.explode(gram).alias("x")).select("kind", "t", "e", "x.*")
    freq = grams.groupBy("kind", "g").agg(F.count("*").alias("df"))  # bounded by the square of the alphabet
    ranked = grams.join(freq, ["kind", "g"]).groupBy("kind", "t", "e").agg(F.array_sort(F.collect_list(F.struct("df", "g", "at"))).alias("gs"))  # as many as the token has letters
    prefix = ws.save(ranked.select("kind", "t", "e", F.explode(F.slice("gs", 1, F.col("e") * 3 + 1)).alias("x")).select("kind", "t", "e", "x.g", "x.at"))
    # Places are part of the key: one side stands at all places within reach.  The parts are numbered, as bytes say little of the work.
    n = parts(prefix)
    a = prefix.repartition(n, "kind", "g", "at")
    b = prefix.select("kind", "g", F.explode(F.sequence(F.col("at") - 2, F.col("at") + 2)).alias("at"), F.col("t").alias("u"), F.col("e").alias("e2")).repartition(n, "kind", "g", "at")
    near = a.join(b, ["kind", "g", "at"]).where((F.abs(F.length("t") - F.length("u")) <= F.least("e", "e2")) & (F.col("t") < F.col("u")))
    # Swaps count twice here and once below, so 2e in plain edits lets every allowed pair through.
    near = near.where(F.levenshtein("t", "u", 4) >= 0).select("kind", "t", "u").distinct()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[edits(x, y, allowed(x, y)) <= allowed(x, y) for x, y in zip(b["t"], b["u"])]]

    near = ws.save(near)
    ok = ws.save(near.repartition(parts(near)).mapInPandas(exact, "kind string, t string, u string"))
    return ok.unionByName(ok.select("kind", F.col("u").alias("t"), F.col("t").alias("u"))).unionByName(vocab.select("kind", "t", F.col("t").alias("u")))


def standing_for() -> list[tuple[str, str]]:
    """(c, key): the formal names of every known given name, those within one edit of them, and the name itself."""
    out = {(c, c) for c in KNOWN_GIVEN}
    for c in KNOWN_GIVEN:
        forms = FORMAL.get(c, set()) | {c}
        out |= {(c, f) for f in forms} | {(c, x) for x in NICKNAMES for f in forms if min(len(x), len(f)) >= 5 and edits(x, f, 1) <= 1}
    return sorted(out)


def keys_of(kind: str, toks: list[str], common: dict[str, set[str]]) -> set[tuple[str, bool]]:
    """(key, initial) of a name by which names meet that share no rare token.

    common: by token the common tokens and given names it is alike to.  Persons need two matches of tokens, the second of which may
    be an initial: of two names that share a key of an initial one must have the initial itself.  Organisations of up to three tokens
    need matches of all, longer ones of all but one, so three at least.  Equal sets of tokens always meet.
    """
    out = {("=|" + "|".join(sorted(toks)), False)}
    own = sorted(set(toks))
    known = [t for t in own if t in common and (len(t) > 1 or kind != "person")]
    size = 2 if kind == "person" else min(3, len(own))
    for some in combinations(known, size):
        out |= {(f"{size}|" + "|".join(sorted(x)), False) for x in product(*(common[t] for t in some))}
    if kind == "person":
        for t in known:
            for o in own:
                if o != t:
                    for first in {o[0], *(x[0] for x in FORMAL.get(o, ()))}:
                        out |= {(f"i|{x}|{first}", len(o) == 1) for x in common[t]}
    return out


def met_by_common(ws: Workspace, names: DataFrame, freq: DataFrame, pairs: DataFrame, common_df: int) -> DataFrame:
    """(kind, a, b), a < b: names whose common tokens agree, and names with equal sets of tokens.

    Two alike tokens are both rare, and bring their names together by themselves, or one is common, and then both are alike to
    that one.  Common tokens are few: at most tokens / common_df.
    """
    spark = names.sparkSession
    common = ws.save(freq.where(F.col("df") > common_df).select("kind", F.col("t").alias("c")).unionByName(spark.createDataFrame([("person", c) for c in sorted(KNOWN_GIVEN)], "kind string, c string")).distinct())
    near = pairs.withColumnRenamed("u", "c").join(common, ["kind", "c"])
    # Short forms of words open with the same letter.
    first = lambda x: F.substring(x, 1, 1)
    words = freq.where("kind = 'organization'").select("kind", "t", first("t").alias("f")).join(common.withColumn("f", first("c")), ["kind", "f"]).where("abs(length(t) - length(c)) >= 1").select("kind", "t", "c")

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[alike(t, c, k) > 0 for k, t, c in zip(b["kind"], b["t"], b["c"])]]

    near = near.select("kind", "t", "c").unionByName(words.mapInPandas(short, "kind string, t string, c string"))
    forms = spark.createDataFrame([("person", c, x) for c, x in standing_for()], "kind string, c string, form string")
    near = near.join(forms, ["kind", "c"], "left").select("kind", "t", F.coalesce("form", "c").alias("c")).distinct()
    of = names.select("kind", "name", "toks", F.explode(F.array_distinct("toks")).alias("t")).join(near, ["kind", "t"], "left")
    of = of.groupBy("kind", "name").agg(F.first("toks").alias("toks"), F.collect_list(F.struct("t", "c")).alias("cs"))  # a name's own tokens

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, name, toks, cs in zip(b["kind"], b["name"], b["toks"], b["cs"]):
                by: dict[str, set[str]] = {}
                for x in cs:
                    if x["c"] is not None:
                        by.setdefault(x["t"], set()).add(x["c"])
                out += [(kind, key, initial, name) for key, initial in keys_of(kind, list(toks), by)]
            yield pd.DataFrame(out, columns=["kind", "key", "initial", "name"])

    keys = ws.save(of.mapInPandas(keyed, "kind string, key string, initial boolean, name string"))
    x = keys.where("initial or not startswith(key, 'i|')").select("kind", "key", F.col("name").alias("x"))
    met = x.join(keys.withColumnRenamed("name", "y"), ["kind", "key"]).where("x < y or (x <> y and startswith(key, 'i|'))")
    return met.select("kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked(df: DataFrame, rec_id: Column, name: Column, kind: Column, common_df: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership (id, kind, name) and links (kind, a, b) between distinct names, a < b.

    common_df: tokens in more distinct names than this are common (given names, kinds of organisations) and bring names
    together only two by two, or with an initial (`met_by_common`).  The default is a four-hundredth of all names, between 20 and
    200, so no rare token brings more than 200 names together however many there are.
    Equal spellings are one name; nothing is capped; empty input gives empty tables.
    """
    ws = Workspace(df.sparkSession, "names")
    members, names = distinct_names(df, rec_id, name, kind)
    members, names = ws.save(members), ws.save(names)
    total = names.count()
    common_df = common_df or min(200, max(20, total // 400))
    rows = names.select("kind", "name", F.explode(F.array_distinct("toks")).alias("t"))
    freq = rows.groupBy("kind", "t").agg(F.count("*").alias("df"))
    with_df = ws.save(rows.join(freq, ["kind", "t"]))
    # A rare token is in at most common_df names, which bounds what meets over it.
    core = ws.save(with_df.where(((F.length("t") >= 2) | (F.col("kind") == "organization")) & (F.col("df") <= common_df)).select("kind", "name", "t"))
    given = df.sparkSession.createDataFrame([("person", t) for t in sorted(KNOWN_GIVEN)], "kind string, t string")
    pairs = ws.save(similar_tokens(ws, freq.select("kind", "t").unionByName(given).distinct()))
    n = float(max(1, total))
    heavy = with_df.groupBy("kind", "name").agg(F.collect_list(F.struct("t", F.log(1 + n / F.col("df")).alias("w"))).alias("weights"))  # a name's own tokens
    info = ws.save(names.join(heavy, ["kind", "name"]))
    left = core.join(pairs, ["kind", "t"]).select("kind", F.col("name").alias("a"), F.col("u").alias("key"))
    cand = left.join(core.select("kind", F.col("name").alias("b"), F.col("t").alias("key")), ["kind", "key"]).where("a < b").select("kind", "a", "b")
    cand = ws.save(cand.unionByName(met_by_common(ws, names, freq, pairs, common_df)).distinct())
    n_parts = parts(cand)
    cand = cand.join(info.select("kind", F.col("name").alias("a"), F.col("toks").alias("ta"), F.col("weights").alias("wa")), ["kind", "a"]).join(info.select("kind", F.col("name").alias("b"), F.col("toks").alias("tb"), F.col("weights").alias("wb")), ["kind", "b"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for k, ta, tb, wa, wb in zip(b["kind"], b["ta"], b["tb"], b["wa"], b["wb"]):
                w = {x["t"]: x["w"] for x in wa} | {x["t"]: x["w"] for x in wb}
                keep.append((same_person if k == "person" else same_organisation)(list(ta), list(tb), w))
            yield b.loc[keep, ["kind", "a", "b"]]

    return members, ws.save(cand.repartition(n_parts).mapInPandas(verify, "kind string, a string, b string"))


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a_id, b_id): pairs of records of linked or equal names."""
    x = members.select("kind", F.col("name").alias("a"), F.col("id").alias("x"))
    y = members.select("kind", F.col("name").alias("b"), F.col("id").alias("y"))
    across = links.join(x, ["kind", "a"]).join(y, ["kind", "b"]).select("x", "y")
    same = x.join(y.withColumnRenamed("b", "a"), ["kind", "a"]).where("x < y").select("x", "y")
    return across.unionByName(same).where("x <> y").select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).distinct()


def per_record(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, kind, spelling, copies, variants): every record with the number of records of its spelling and of linked other spellings."""
    ends = links.select("kind", F.col("a").alias("name")).unionByName(links.select("kind", F.col("b").alias("name"))).groupBy("kind", "name").agg(F.count("*").alias("variants"))
    size = members.groupBy("kind", "name").agg(F.count("*").alias("copies"))
    return members.join(size.join(ends, ["kind", "name"], "left"), ["kind", "name"]).select("id", "kind", F.col("name").alias("spelling"), "copies", F.coalesce("variants", F.lit(0)).alias("variants"))
