"""Problem 3: personal information inside free text.

A semi-Markov conditional random field over candidate segments.  Patterns and word lists only propose spans, overlapping ones
included; features of whole spans and of their surroundings score every (span, kind), and dynamic programming over spans of
bounded length chooses boundaries and kinds jointly.  Weights are trained here, by gradient ascent on the conditional
likelihood of generated sentences with known spans (`training_sentences`), written for this purpose; no text of any table is among them.
Persons' names are proposed around given names and their short forms, spelt with up to one error, around titles and around initials.
"""

from __future__ import annotations

import bisect
import json
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import NICKNAMES, TITLES

KINDS = ["email", "phone", "idnum", "address", "name"]
MAX_SPAN = 80  # characters of the longest segment

# Given names besides those with short forms, street words and words around numbers.
GIVEN = set(NICKNAMES) | set("""aisha alice amina amelia ana andrea angela anna anneliese antonio astrid beatriz bjorn björn brigitte bruno carla carlos carmen chiara chloe claire claudia diego dmitri elena elif emil emma erik
 eva fatima felix fernando françois francois françoise frieda fritz gabriel georg giulia günther gunther guenther hana hannah hans heidi heinrich helena helga hiroko hiroshi hugo ines ingrid ingvar isabel ivan jan javier jean jose josé juan julia
 jürgen jurgen juergen karl kenji klaus kwame lars laura leila lena louis lucia luis luise magda manuel marco maria marie marta martin mateo max mei mohammed nadia natalia noemi noémie olga oskar otto pablo paul paula paulina pedro pierre
 priya quentin rafael rosa samira sara sarah sofia sophie soren søren stefan sven tariq ursula viktor wei wilhelm ximena yuki yusuf yvonne zoë zoe zofia owen grace lucas oliver simon silvia theo""".split())
SHORT = {s for v in NICKNAMES.values() for s in v}
STREET_EN = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|way|court|ct|place|pl|square|sq|terrace|close|crescent|row)"
ID_WORDS = set("ssn id passport passeport pasaporte reisepass ausweis personalausweis card dni nie nino social security national steuer tax insurance identity identidad identité nif cpf license licence versicherungsnummer sozialversicherungsnummer steuernummer".split())
PHONE_WORDS = set("call tel telephone telefon phone mobile mobil cell fax number unter ring dial handy text teléfono teléphone llame appelez rufnummer".split())
THING_WORDS = set("invoice order release version total ratio margin ticket loop decision project phase page chapter room rechnung bestellung pedido facture commit issue build no nr moved isbn ref batch lot serial model part units sku took version".split())

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?|\d+|[,;]")
LETTERS = re.compile(r"[^\W\d_]+")
EMAIL = re.compile(r"<?[\w.+-]+@[\w-]+(?:\.[\w-]+)+>?")
HIDDEN_EMAIL = re.compile(r"[\w.+-]+\s?(?:\(at\)|\[at\]|\{at\}|\s(?:at|AT)\s)\s?[\w-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s(?:dot|DOT)\s)[\w-]+)+", re.I)
AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|\sat\s\S{1,40}\sdot\s", re.I)
NUMBER = re.compile(r"(?<![\w.@/])(?:[A-Z]{1,2}\s?)?[+(]?\d(?:[\d]|[ ()/.\-](?=[\d(]))*(?:\s?[A-Z](?!\w))?(?!\w)")
STREET = [
    re.compile(r"(?:No\.?\s)?\b\d{1,4}\s?[a-z]?,?\s(?:[^\W\d_]+\s){1,3}?" + STREET_EN + r"\b\.?(?:,?\s(?:apt|apartment|suite|unit|flat)\.?\s?\w+)?", re.I),
    re.compile(r"[^\W\d_]{3,}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm)\s\d{1,4}\s?[a-z]?\b(?:,\s\d{4,5}\s[^\W\d_]+)?", re.I),
    re.compile(r"\b(?:calle|avenida|plaza|paseo|camino|carrera|via|viale|piazza|rua)\s(?:de(?:l|\sla)?\s)?[^\W\d_]+(?:\s[^\W\d_]+)?,?\s\d{1,4}\b", re.I),
    re.compile(r"\b\d{1,4}\s?(?:bis|ter)?,?\s(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse)\s(?:de(?:s|\sla)?\s|du\s)?[^\W\d_]+", re.I),
]
HOUSE = re.compile(r"\d")


@dataclass(frozen=True, slots=True)
class Span:
    start: int
    end: int
    kind: str
    feats: tuple[str, ...]


def shape(s: str) -> str:
    """Runs of digits by length, letters and the signs between them."""
    return re.sub(r"\d+", lambda m: str(min(9, len(m[0]))), re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", s))


def before(text: str, at: int, n: int = 3) -> list[str]:
    return [w.lower() for w in LETTERS.findall(text[max(0, at - 40) : at])[-n:]][::-1]


def after(text: str, at: int, n: int = 2) -> list[str]:
    return [w.lower() for w in LETTERS.findall(text[at : at + 30])[:n]]


def group(words: list[str]) -> list[str]:
    """Which kinds of words stand here, nearest first."""
    out = []
    for i, w in enumerate(words):
        for name, known in (("id", ID_WORDS), ("phone", PHONE_WORDS), ("thing", THING_WORDS)):
            if w in known:
                out.append(f"{name}{min(i, 2)}")
    return out


def number_spans(text: str) -> Iterator[Span]:
    for m in NUMBER.finditer(text):
        s = m[0]
        digits = sum(c.isdigit() for c in s)
        if digits < 6 or len(s) > 30:
            continue
        b, sh = before(text, m.start()), shape(s)
        base = ["num", f"shape={sh}", f"digits={min(digits, 15)}", *(f"b:{x}" for x in group(b)), *(f"a:{x}" for x in group(after(text, m.end())))]
        base += ["plus"] * s.startswith("+") + ["zero2"] * s.startswith("00") + ["zero1"] * (s[0] == "0") + ["paren"] * ("(" in s) + ["letters"] * any(c.isalpha() for c in s)
        base += ["date"] * bool(re.fullmatch(r"(?:19|20)\d\d[-/.]\d\d?[-/.]\d\d?", s)) + ["year"] * bool(re.match(r"(?:19|20)\d\d[-/]", s)) + ["dots"] * bool(re.fullmatch(r"\d+(?:\.\d+)+", s)) + ["slash"] * ("/" in s)
        base += ["555"] * bool(re.search(r"\b555[- ]\d{4}$", s)) + [f"groups={min(6, len(re.findall(r'[0-9]+', s)))}"] + ["nocue"] * (not group(b))
        for kind in ("phone", "idnum"):
            yield Span(m.start(), m.end(), kind, tuple(f"{kind}|{f}" for f in base))


def email_spans(text: str) -> Iterator[Span]:
    for rx, f in ((EMAIL, "plain"), (HIDDEN_EMAIL, "hidden")):
        for m in rx.finditer(text):
            s = m[0]
            marks = ["marked"] * bool(re.search(r"[(\[{]at", s, re.I)) + ["wordat"] * bool(re.search(r"\sat\s", s, re.I)) + ["worddot"] * bool(re.search(r"\sdot\s|[(\[{]dot", s, re.I)) + ["realdot"] * bool(re.search(r"\w\.\w", s))
            yield Span(m.start(), m.end(), "email", tuple(f"email|{x}" for x in ("any", f, *marks)))


def address_spans(text: str) -> Iterator[Span]:
    for i, rx in enumerate(STREET):
        for m in rx.finditer(text):
            s = m[0]
            words = LETTERS.findall(s)
            f = ["any", f"form{i}", f"words={min(6, len(words))}", *(f"b:{x}" for x in group(before(text, m.start(), 1)))]
            f += ["short"] * (min(map(len, words)) < 3) + ["capital"] * any(w[0].isupper() for w in words) + ["comma"] * ("," in s)
            last = words[-1].lower() if i == 0 else ""
            f += [f"last={last}"] if last else []
            f += ["common"] * any(w.lower() in COMMON for w in words[:-1]) + ["long"] * any(len(w) >= 7 for w in words)
            yield Span(m.start(), m.end(), "address", tuple(f"address|{x}" for x in f))


#: Everyday words that stand beside names without being part of them.
COMMON = set("""the a an and or of to in on at by for with from that this if so why is was are were be not no it its every some any all one two first next last under over after before during about near old new
 asked said works went moved goes says took will can again once more than der die das den dem und oder ein eine mit von im am zum zur für bei nach auf ist war el la los las un una y o de del con en por para es le les du des et ou à pour avec dans
 minutes minute hours days week weeks month year years people friday monday tuesday wednesday thursday saturday sunday contact call mobile met thanks reply signed keep together treffen bitte an as they he she we you i""".split())


def name_spans(text: str, words: list[re.Match]) -> Iterator[Span]:
    """Runs of two to four word tokens around a given name, a short form, an initial or a title."""
    n = len(words)
    toks = [w[0] for w in words]
    low = [t.lower().rstrip(".") for t in toks]

    def role(i: int) -> str:
        t, w = toks[i], low[i]
        if t in ",;":
            return ","
        if w in TITLES and (t[0].isupper() or t.endswith(".")):
            return "T"
        if len(w) == 1 and t[0].isupper() and w.isalpha():
            return "I"
        if w in GIVEN:
            return "G"
        if w in SHORT:
            return "N"
        if t[0].isupper() and misspelt(w):
            return "M"
        if not w.isalpha() or w in COMMON or t[0].isdigit():
            return "x"
        if t.isupper() and len(w) > 3:
            return "U"
        if t[0].isupper() and len(w) > 2:
            return "C"
        return "l" if len(w) > 4 else "x"

    anchors = [i for i in range(n) if low[i] in GIVEN or low[i] in SHORT or (len(low[i]) == 1 and toks[i][0].isupper() and low[i].isalpha()) or low[i] in TITLES or (toks[i][0].isupper() and misspelt(low[i]))]
    seen = set()
    for a in anchors:
        if role(a) == "x":
            continue
        for i in range(max(0, a - 2), a + 1):
            for j in range(a + 2, min(n, a + 4) + 1) if i == a else range(a + 1, min(n, a + 2) + 1):
                if j - i < 2 or (i, j) in seen:
                    continue
                seen.add((i, j))
                s, e = words[i].start(), words[j - 1].end()
                if e - s > 60 or "\n" in text[s:e] or any(text[words[k].end() : words[k + 1].start()].strip(" ") or words[k + 1].start() - words[k].end() > 2 for k in range(i, j - 1)):
                    continue
                roles = [role(k) for k in range(i, j)]
                if roles[0] == "," or roles[-1] == "," or "x" in roles or roles.count(",") > 1:
                    continue
                if toks[j - 1].endswith(".") and len(low[j - 1]) > 1 and roles[-1] != "T":
                    e -= 1
                if any(toks[k].endswith(".") and len(low[k]) > 1 and roles[k - i] != "T" for k in range(i, j - 1)):
                    continue
                bare = ["G" if r == "G" else r for r in roles]
                f = ["any", "roles=" + "".join(bare), f"n={j - i}"]
                rest = [low[k] for k, r in zip(range(i, j), roles) if r in "UCl"]
                f += ["long"] * any(len(w) >= 7 for w in rest) + ["norest"] * (not rest) + [f"rests={len(rest)}"]
                f += ["lower"] * (toks[i].islower()) + ["upper"] * (toks[i].isupper() and len(toks[i]) > 1)
                p = low[i - 1] if i else "^"
                q = low[j] if j < n else "$"
                f += [f"p={'cue' if p in CUES else 'com' if p in COMMON else 'sep' if p in ',;^' else 'other'}", f"q={'com' if q in COMMON else 'sep' if q in ',;$' else 'other'}"]
                opens = bool(i == 0 or re.search(r"[.!?:;`\n]\s*$", text[max(0, s - 3) : s]))
                f += ["start"] * opens + [f"start={opens}&roles={''.join(bare)}"]
                yield Span(s, e, "name", tuple(f"name|{x}" for x in f))


#: Words that often stand before a person's name.
CUES = set("with to from for by contact mit von an for bei am ask tell thank thanks dear hi hello signed met see con para avec pour together meet zu".split())


def spans(text: str) -> list[Span]:
    """All candidate segments of a text, in order of their ends."""
    out: list[Span] = []
    low = text.lower()
    if AT.search(text):
        out += email_spans(text)
    if HOUSE.search(text):
        out += number_spans(text)
        out += address_spans(text)
    if anchored(low, text):
        for lo, hi in regions(text):
            part = text[lo:hi]
            out += [Span(s.start + lo, s.end + lo, s.kind, s.feats) for s in name_spans(part, list(WORD.finditer(part)))]
    return sorted((s for s in out if s.end - s.start <= MAX_SPAN), key=lambda s: (s.end, s.start, s.kind))


ANCHOR_WORDS = GIVEN | SHORT | TITLES


def _cuts(w: str) -> set[str]:
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


#: Given names of five letters and more with one letter taken out, by which those with one error are found.
NEARLY = {c for g in GIVEN if len(g) >= 5 for c in _cuts(g)}


@lru_cache(50_000)
def misspelt(w: str) -> bool:
    """A given name with one letter added, left out, changed or swapped with its neighbour; words of fewer than five letters and everyday words are none."""
    return len(w) >= 5 and w not in GIVEN and w not in COMMON and w.isalpha() and (w in NEARLY or not GIVEN.isdisjoint(_cuts(w)) or not NEARLY.isdisjoint(_cuts(w)))


ANCHOR = re.compile(r"[A-Z]\.?[ ,]|[^\W\d_]+")
INITIAL = re.compile(r"(?<![\w.])(?:[^\W\d_a-z]\.?\s(?=[^\W\d_a-z])|(?<=,\s)[A-Z]\b)")


def anchored(low: str, text: str) -> bool:
    return not ANCHOR_WORDS.isdisjoint(LETTERS.findall(low)) or INITIAL.search(text) is not None or any(w[0].isupper() and misspelt(w.lower()) for w in LETTERS.findall(text))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around possible anchors of names, merged."""
    out: list[tuple[int, int]] = []
    for m in LETTERS.finditer(text):
        w = m[0]
        if (len(w) == 1 and w.isupper()) or (w if w.islower() else w.lower()) in ANCHOR_WORDS or (w[0].isupper() and misspelt(w.lower())):
            lo, hi = max(0, m.start() - 60), min(len(text), m.end() + 60)
            while lo > 0 and not text[lo - 1].isspace():
                lo -= 1
            while hi < len(text) and not text[hi].isspace():
                hi += 1
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
    return out


def step(a: Span, b: Span) -> str | None:
    """The feature of two segments that follow each other closely."""
    return f"after|{a.kind}|{b.kind}" if b.start - a.end <= 12 else None


def score(s: Span, w: dict[str, float]) -> float:
    return sum(w.get(f, 0.0) for f in s.feats) + w.get(f"{s.kind}|bias", 0.0)


def decode(cands: list[Span], w: dict[str, float]) -> list[Span]:
    """The best set of segments that don't overlap: Viterbi over segments, bounded by their candidates."""
    if not cands:
        return []
    ends = [c.end for c in cands]
    best: list[float] = []
    back: list[int] = []
    upto: list[int] = []  # the best chain ending at or before each candidate
    for i, c in enumerate(cands):
        s = score(c, w)
        k = bisect.bisect_right(ends, c.start, 0, i) - 1
        top, prev = 0.0, -1
        if k >= 0:
            top, prev = (best[upto[k]], upto[k]) if best[upto[k]] > 0 else (0.0, -1)
            j = k
            while j >= 0 and c.start - cands[j].end <= 12:
                v = best[j] + w.get(step(cands[j], c) or "", 0.0)
                if v > top or j == prev:
                    top, prev = v, j
                j -= 1
        best.append(top + s)
        back.append(prev)
        upto.append(i if not upto or best[i] > best[upto[-1]] else upto[-1])
    i = upto[-1]
    if best[i] <= 0:
        return []
    out = []
    while i >= 0:
        out.append(cands[i])
        i = back[i]
    return out[::-1]


def marginals(cands: list[Span], w: dict[str, float]) -> tuple[float, list[float], dict[str, float]]:
    """Log partition function, probability of every candidate and expected counts of step features."""
    n = len(cands)
    s = [score(c, w) for c in cands]
    fwd, bwd = [0.0] * n, [0.0] * n
    pair = {(i, j): math.exp(w.get(step(cands[i], cands[j]) or "", 0.0)) for j in range(n) for i in range(j) if cands[i].end <= cands[j].start}
    for j in range(n):
        fwd[j] = math.exp(s[j]) * (1 + sum(fwd[i] * pair[i, j] for i in range(j) if (i, j) in pair))
    for i in range(n - 1, -1, -1):
        bwd[i] = 1 + sum(math.exp(s[j]) * pair[i, j] * bwd[j] for j in range(i + 1, n) if (i, j) in pair)
    z = 1 + sum(fwd)
    steps: dict[str, float] = {}
    for (i, j), p in pair.items():
        if f := step(cands[i], cands[j]):
            steps[f] = steps.get(f, 0.0) + fwd[i] * p * math.exp(s[j]) * bwd[j] / z
    return math.log(z), [f * b / z for f, b in zip(fwd, bwd)], steps


# ---- training -------------------------------------------------------------------------------------------------------


def _surname(r: random.Random) -> str:
    return "".join(r.choice("bdfghjklmnprstvwz") + r.choice("aeiou") for _ in range(r.randint(1, 3))) + r.choice(["son", "berg", "stein", "ford", "holt", "ley", "mann", "ström", "field", "ner", "sky", "ton", "dale", "wick"])


def _name(r: random.Random) -> str:
    given, sur = r.choice(sorted(GIVEN)), _surname(r).capitalize()
    g = given.capitalize()
    if r.random() < 0.2 and (s := [x for k, v in NICKNAMES.items() if k == given for x in v]):
        g = r.choice(s).capitalize()
    if len(g) >= 5 and r.random() < 0.12:  # a typing error
        i = r.randrange(1, len(g) - 1)
        g = r.choice([g[:i] + g[i + 1 :], g[:i] + g[i] + g[i:], g[:i] + g[i + 1] + g[i] + g[i + 2 :]])
    form = r.randint(0, 9)
    title = r.choice(["Dr.", "Dr", "Prof.", "Mr.", "Mrs.", "Ms.", "Frau", "Herr"])
    return [f"{g} {sur}", f"{g} {sur}", f"{g} {sur}", f"{sur}, {g}", f"{g[0]}. {sur}", f"{title} {sur}", f"{g} {sur}".upper(), f"{g} {sur}".lower(), f"{g} {r.choice('ABCDEFGHJKLM')}. {sur}", f"{title} {g} {sur}"][form]


def _digits(r: random.Random, pattern: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "9" else r.choice("ABCEGHJKLMNPRSTXY") if c == "A" else c for c in pattern)


def _phone(r: random.Random) -> str:
    return _digits(r, r.choice(["+1-999-555-9999", "+1 999 555 9999", "(999) 555-9999", "555-9999", "+44 20 9999 9999", "020 9999 9999", "+49 99 99999999", "+49 30 99999999", "0099999999999", "00493099999999", "099 99999 999", "030/99999-999", "+33 9 99 99 99 99", "09.99.99.99.99", "999-555-9999", "+34 999 999 999", "0999 999999", "+41 99 999 99 99"]))


def _idnum(r: random.Random) -> str:
    return r.choice([lambda: _digits(r, "999-99-9999"), lambda: "SSN " + _digits(r, r.choice(["999 99 9999", "999-99-9999", "999999999"])), lambda: r.choice(["Steuer-ID ", "tax id ", "Tax ID "]) + _digits(r, r.choice(["99999999999", "99 999 999 999"])), lambda: r.choice(["passport no. ", "Passport: ", "Reisepass "]) + _digits(r, r.choice(["A99999999", "A99 999 999", "AA9999999"])), lambda: r.choice(["identity card ", "Personalausweis ", "DNI "]) + _digits(r, r.choice(["A99999999", "99999999A"])), lambda: r.choice(["national id ", "national insurance ", "id "]) + _digits(r, r.choice(["999999-9999", "AA 99 99 99 A", "AA999999A"])), lambda: _digits(r, r.choice(["AA 99 99 99 A", "AA999999A"]))])()


def _address(r: random.Random) -> str:
    s = _surname(r).capitalize()
    n = r.randint(1, 190)
    tail = r.choice(["", "", "a", "b", "c"])
    return r.choice([f"{n}{tail} {s} {r.choice(['Street', 'Road', 'Lane', 'Ave.', 'Drive', 'Avenue'])}", f"{n} {s.lower()} st", f"No. {n}, {s} Road", f"{n} {s} Ave., Apt {r.randint(1, 20)}", f"{s}straße {n}", f"{s}str. {n}{tail}", f"{s}weg {n}, {_digits(r, '99999')} Neu{s.lower()}", f"calle {s} {n}", f"{n} rue {s}", f"Avenida {s} {n}"])


def _email(r: random.Random) -> str:
    user = r.choice([_surname(r) + str(r.randint(1, 99)), f"{r.choice(sorted(NICKNAMES))}.{_surname(r)}", f"{_surname(r)}_{r.choice(sorted(NICKNAMES))}", f"{r.choice(sorted(NICKNAMES))}-{_surname(r)}", "x" + _surname(r), f"{r.choice(sorted(NICKNAMES))}+list"])
    host, top = r.choice(["mail", "example", "lab", "uni-x", "post"]), r.choice(["com", "org", "net", "test", "invalid", "example"])
    return r.choice([f"{user}@{host}.{top}"] * 3 + [f"<{user}@{host}.{top}>", f"{user} [at] {host}.{top}", f"{user}(at){host} dot {top}", f"{user} (at) {host}.{top}", f"{user} at {host} dot {top}", f"{user}@{host}.{top}".upper()])


MAKERS = {"name": _name, "phone": _phone, "idnum": _idnum, "address": _address, "email": _email}
FRAMES = [
    "Offers reach us under {email} until the fair closes.", "Ask {name} about the report.", "My number is {phone}, thanks.", "Contact: {name}, {phone}, {email}.", "{name} called about the lease.", "We met {name} at {address}.", "Ring {phone} after lunch.",
    "The letter went to {address} by mistake.", "On file: {idnum}; {address}.", "Her papers: {idnum}.", "The form wants {idnum} again.", "tel {phone} / mail {email}", "Unterlagen gehen an {email}, Rückfragen beantwortet {phone}.", "Treffen mit {name} in der {address}.",
    "Signed together with {name} ({idnum}).", "Thanks to {name} the engine works again.", "{name} asked for the map, and the rest can wait.", "Keep the parcel for {name} at {address}, code in the note.", "The draft goes to {email} tonight.", "Met with {name} about the garden.",
    "Mobile {phone}, ask for the desk.", "Reply from {email} with the file attached; backup number {phone}.", "Llame a {name} al {phone}.", "Écrire à {name}, {address}.", "Dear {name}, see you on Friday.", "Whoever finds the cat may dial {phone} at any hour.", "According to {name} nothing changed.", "Rechnung an {name}, {address}.",
    "{name} and {name} share an office.", "The keys are with {name}.", "{name} ({email}) will join.",
]
PLAIN = [
    "Receipt {y}-{2}-{4} was booked twice.", "Order no. {5}-{3} shipped.", "Release {1}.{2}.{3} fixed the lamp.", "We counted {3} {3} bricks along {2} walls.", "Moved to 20{2}-0{1}-1{1} at {2}:{2}.", "Ratio {2}/{2}, margin {2}-{2} percent.", "Tag it @garden in the log.", "Ticket T-{3} blocks ticket T-{3} until spring.",
    "The recipe is kept in cook/soup-{2}.txt on the old disk.", "The map took {2} minutes, so the plain lamp waits.", "In the second week a new Museum opens.", "Project Harbour Phase {1} begins.", "We saw {2} people at the market and left at noon.", "Der Bericht Nordlicht ändert das Projekt.", "El informe Estrella mide la carta.", "Version {1}.{1}.{4} of the server is out.",
    "Ticket {6} was closed on 20{2}-1{1}-0{1}.", "The old drive way 12 days later was shut.", "Batch {4}-{4}-{2} passed.", "Total: {3} garden", "A second drive reads {2} pages.", "If the Lamp fits, the Table holds it.", "Meet at noon dot or dash, she said.", "They will draw the art and mark the sand.", "The frank reply was rich and kit was dear.", "Serial {8} was replaced.",
    "The sum of {3} {3} {3} rows is right.", "Page {3} of volume {2}, chapter {1}.", "Part number {3}-{4} is out of stock.", "Reference {y}/{6} was sent.", "Vitamin C Tablets and Plan B Files are kept.", "Section A. Overview of the work.", "Appendix B Table and Plan C Draft differ.", "Model T Engine and Type O Valve.", "The Marina Gate and the Marble Hall stay closed.", "A Clara Cellar sold out, so the Roman Bridge was next.", "Der Hering Markt und das Karli Theater sind offen.",
]


def training_sentences(n: int = 4000, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with the places of their items; a third hold none."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.34:
                frame = r.choice(PLAIN)
                part = re.sub(r"\{(\w)\}", lambda m: str(r.randint(2019, 2029)) if m[1] == "y" else _digits(r, "9" * int(m[1])), frame)
                text += part + " "
                continue
            pos = 0
            frame = r.choice(FRAMES)
            for m in re.finditer(r"\{(\w+)\}", frame):
                text += frame[pos : m.start()]
                item = MAKERS[m[1]](r)
                gold.append((len(text), len(text) + len(item), m[1]))
                text += item
                pos = m.end()
            text += frame[pos:] + " "
        out.append((text.strip(), gold))
    return out


def label(cands: list[Span], gold: list[tuple[int, int, str]]) -> list[int]:
    """For every true item the candidate of its kind that covers most of it."""
    out = []
    for s, e, k in gold:
        fit = [(min(c.end, e) - max(c.start, s) - 0.5 * max(0, s - c.start) - 0.5 * max(0, c.end - e), -i) for i, c in enumerate(cands) if c.kind == k and c.start < e and c.end > s and c.start >= s - 1 and c.end <= e + 1]
        if fit:
            out.append(-max(fit)[1])
    out.sort()
    return [i for n, i in enumerate(out) if n == 0 or cands[out[n - 1]].end <= cands[i].start]


def train(n: int = 4000, rounds: int = 5, seed: int = 5, rate: float = 0.25, decay: float = 1e-4) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional log likelihood, with adaptive rates."""
    data = [(c, label(c, g)) for t, g in training_sentences(n, seed) for c in [spans(t)] if c and len(c) <= 40]
    w: dict[str, float] = {}
    sq: dict[str, float] = {}
    r = random.Random(seed)
    for _ in range(rounds):
        r.shuffle(data)
        for cands, gold in data:
            _, p, steps = marginals(cands, w)
            g: dict[str, float] = {}
            for i, c in enumerate(cands):
                d = (i in gold) - p[i]
                if abs(d) > 1e-4:
                    for f in (*c.feats, f"{c.kind}|bias"):
                        g[f] = g.get(f, 0.0) + d
            for a, b in zip(gold, gold[1:]):
                if f := step(cands[a], cands[b]):
                    g[f] = g.get(f, 0.0) + 1
            for f, v in steps.items():
                g[f] = g.get(f, 0.0) - v
            for f, d in g.items():
                d -= decay * w.get(f, 0.0)
                sq[f] = sq.get(f, 0.0) + d * d
                w[f] = w.get(f, 0.0) + rate * d / math.sqrt(sq[f] + 1e-6)
    return {f: round(v, 4) for f, v in w.items()}


@cache
def model() -> str:
    """The trained weights, once per process; they travel to the tasks as text."""
    return json.dumps(train())


# ---- application ----------------------------------------------------------------------------------------------------


def find(text: str | None, w: dict[str, float]) -> list[Span]:
    return decode(spans(text), w) if text else []


def masked(text: str, found: list[Span]) -> str:
    """The text with every item replaced by [KIND]; all else is unchanged."""
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def detect(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., kind, start, length, item): every item found; places count code points from 0.  Null and empty texts have none; repeated rows give repeated items."""
    weights = model()
    cols = [*keys, "kind", "start", "length", "item"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = json.loads(weights)
        for b in batches:
            rows = [(*k, s.kind, s.start, s.end - s.start, t[s.start : s.end]) for *k, t in zip(*(b[c] for c in keys), b[text]) for s in find(t, w)]
            yield pd.DataFrame(rows, columns=cols)

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "kind string, start int, length int, item string"])
    return df.select(*keys, text).where(F.col(text) != "").mapInPandas(run, schema)


def redact(df: DataFrame, text: str, out: str = "redacted", counts: str = "n_items") -> DataFrame:
    """The rows with the text's masked copy and its number of items; null stays null and empty stays empty.  Other columns, whatever their names, are kept as long as they aren't the two new ones."""
    weights = model()
    keep = df.columns
    if out in keep or counts in keep:
        raise ValueError(f"{out} or {counts} is a column already")

    @F.pandas_udf("redacted string, n_items int")
    def run(col: pd.Series) -> pd.DataFrame:
        w = json.loads(weights)
        rows = [(None if t is None else masked(t, f), len(f)) for t in col for f in [find(t, w)]]
        return pd.DataFrame(rows, columns=["redacted", "n_items"])

    return df.withColumn("_pii", run(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in keep], F.col("_pii.redacted").alias(out), F.col("_pii.n_items").alias(counts))
