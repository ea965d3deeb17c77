"""Text expressions of retrieval, ledgers and ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search leaves out, and question words that it leaves out if others remain.
STOP = ["the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "with", "is", "are", "be", "about", "my", "i", "me", "this", "that", "it"]
QUESTION_STOP = """who whom whose what which when where why how does do did has have had been was were will would can could should shall there their they them he she his her him we our you your at as by from into than then up out
 all any some so far too very just also now still yet ever never each every much many more most such not no only same other own here""".split()
LEDGER_STOP = "the and for with that this from into about what when where which does did have has are was were not you your his her how why who will should could would owner owners".split()
# Patterns of names that name nothing, of periods, of secrets and of plans.
GENERIC = r"(?:projects?|tasks?|meetings?|events?|things?|items?|notes?|documents?|files?|person|people|places?|organi[sz]ations?|org|company|courses?|plans?|ideas?|topics?|updates?|stuff|misc|miscellaneous|unknown|untitled|n/a|tbd|none|null|entity|nodes?|others?)"
VAGUE = rf"(?i)^(?:(?:a|an|the|this|that|some|my|our|his|her|their|new|another|random|generic)\s+)*{GENERIC}(?:\s*\([^)]*\))?$"
PERIOD = r"(?i)^(?:(?:january|february|march|april|may|june|july|august|september|october|november|december)(?:\s+\d{1,2})?\s+\d{4}|(?:spring|summer|fall|autumn|winter)\s+\d{4}|\d{4}|q[1-4]\s+\d{4}|(?:week|w)\s?\d{1,2}(?:\s+\d{4})?)$"
COURSE = r"^(?:[A-Z]{2,5}\s\d{1,4}[A-Z]?|[A-Z]{3,5}\d{1,4}[A-Z]?|\d{1,2}\.[A-Z]?\d{3,4})(?:\s+(?i:course|class|module))?$"
SECRET = r"(?i)((?:api[_-]?key|token|secret|password|passwd|authorization|bearer)\s*[:=]\s*)(\S{6,})"
LONG_TOKEN = r"\b(?=[A-Za-z0-9_\-]{32,}\b)(?=[A-Za-z0-9_\-]*\d)[A-Za-z0-9_\-]{32,}\b"
PLAN = r"(?i)\b(plans? to|planning to|is currently|currently|intends? to|wants? to|is trying to|is considering|will (?:be|begin|start|move|join|attend|apply|submit|take|relocate|enroll|finish|graduate)|upcoming|soon)\b"
DATED = r"(?i)\bas of\b"
LOOP_REF = r"\bL-\d{3}\b"
# Openings of texts that a harness wrote, and marks of automated sessions.
HARNESS = ["<command-", "<local-command", "<system-reminder", "<task-notification", "<persisted-output", "This session is being continued from a previous conversation"]
AUTOMATION = ["<scheduled-task", "This is an automated run of a scheduled task", "---\nname:", "PushNotification", "<<autonomous-loop"]


def ascii_words(x: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; accented words split."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def search_tokens(x: Column) -> Column:
    """Distinct ASCII words of at least two characters without stop words."""
    stop = F.array(*[F.lit(s) for s in STOP])
    return F.filter(F.array_distinct(ascii_words(x)), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def query_tokens(x: Column) -> Column:
    """Search tokens of a query, itself if it has none, without question words unless nothing else is left."""
    q = F.lower(F.trim(x))
    t = search_tokens(q)
    t = F.when(F.size(t) > 0, t).when(q != "", F.array(q)).otherwise(F.array().cast("array<string>"))
    kept = F.array_except(t, F.array(*[F.lit(s) for s in QUESTION_STOP]))
    return F.when(F.size(kept) > 0, kept).otherwise(t)


def ledger_tokens(x: Column) -> Column:
    t = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9][a-z0-9.+-]{2,}"), F.lit(0)))
    return F.array_except(t, F.array(*[F.lit(s) for s in LEDGER_STOP]))


def stem_equal(a: Column, b: Column) -> Column:
    """Equal, or the shorter has at least four characters, opens the longer and lacks at most three."""
    gap = F.length(a) - F.length(b)
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (F.abs(gap) <= 3) & F.when(gap >= 0, a.startswith(b)).otherwise(b.startswith(a)))


def hits(query: Column, tokens: Column) -> Column:
    """How many query tokens have a match among the tokens."""
    return F.size(F.filter(query, lambda q: F.exists(tokens, lambda h: stem_equal(q, h))))


def norm_name(x: Column) -> Column:
    return F.array_join(ascii_words(x), " ")


def bare_name(x: Column) -> Column:
    """Without a closing bracket and closing years."""
    return norm_name(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*\([^()]*\)\s*$", ""), r"(?:\s+(?:19|20)\d\d)+\s*$", ""))


def integrity_name(x: Column, owner: str = "owner") -> Column:
    """Without possessives of the owner and signs, single-spaced."""
    s = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), rf"\b(?:{owner}'?s?|my|the)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), " +", " "))


def compact_name(x: Column, owner: str = "owner") -> Column:
    return F.replace(integrity_name(x, owner), F.lit(" "), F.lit(""))


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("unnamed"))


# The folders that decide a file's kind.
SHELVES = {"profile": "profile", "courses": "course", "applications": "application", "orgs": "org", "projects": "project", "people": "person", "apps": "app", "topics": "topic", "docs": "doc", "areas": "area", "log": "log"}


def file_kind(path: Column, declared: Column | None = None) -> Column:
    """Kind of a file: root files by their declared type, README files, then the first folder, then the declared type, else note."""
    from .vocab import lookup

    told = F.nullif(F.lower(F.trim(declared)), F.lit("")) if declared is not None else F.lit(None).cast("string")
    parts = F.split(path, "/")
    shelf = F.nullif(lookup(SHELVES, parts[0], ""), F.lit(""))
    return F.when(F.size(parts) == 1, F.when(parts[0] == "IDENTITY.md", "identity").otherwise(F.coalesce(told, F.lit("note")))).when(F.element_at(parts, -1) == "README.md", "readme").otherwise(F.coalesce(shelf, told, F.lit("note")))


def is_vague(x: Column) -> Column:
    s = F.trim(F.coalesce(x, F.lit("")))
    return s.rlike(VAGUE) | s.rlike(PERIOD)


def course_type(name: Column, kind: Column, pattern: str = COURSE) -> Column:
    """Events that are nothing but a course code are concepts."""
    return F.when((kind == "event") & F.coalesce(F.trim(name).rlike(pattern), F.lit(False)), "concept").otherwise(kind)


def redact_secrets(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), SECRET, "$1[redacted]"), LONG_TOKEN, "[redacted]")


def chunks(x: Column, size: int = 4000) -> Column:
    """Pieces of at most `size` characters on blank lines; a larger paragraph is cut hard.  A fold over the paragraphs."""
    text = F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, para: Column) -> Column:
        hard = F.transform(F.sequence(F.lit(0), F.floor((F.length(para) - 1) / size).cast("int")), lambda i: strip(F.substring(para, i * size + 1, F.lit(size))))
        flushed = F.when(strip(acc["cur"]) != "", F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"])
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(para) + 2 > size)
        return (
            F.when(F.length(para) > size, F.struct(F.concat(flushed, hard).alias("out"), F.lit("").alias("cur")))
            .when(full, F.struct(F.concat(acc["out"], F.array(strip(acc["cur"]))).alias("out"), F.concat(para, F.lit("\n\n")).alias("cur")))
            .otherwise(F.struct(acc["out"].alias("out"), F.concat(acc["cur"], para, F.lit("\n\n")).alias("cur")))
        )

    folded = F.aggregate(F.split(text, "\n\n"), zero, step, lambda a: F.when(strip(a["cur"]) != "", F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"]))
    return F.filter(F.when(F.length(text) <= size, F.array(text)).otherwise(folded), lambda c: c != "")


def novel(old: Column, new: Column) -> Column:
    """The new text has two or more words the old lacks and isn't a mere fragment of it."""
    stop = F.array(*[F.lit(s) for s in STOP])
    a, b = F.array_except(ascii_words(old), stop), F.array_except(ascii_words(new), stop)
    return (F.size(F.array_except(b, a)) >= 2) & (F.length(F.coalesce(new, F.lit(""))) >= 0.6 * F.length(F.coalesce(old, F.lit(""))))


def absorbed(old: Column, new: Column, most: int = 600) -> Column:
    """Old text with a novel new one appended; its oldest sentences go while it is longer than `most`."""
    o, n = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    joined = F.when(o == "", n).otherwise(F.concat(F.regexp_replace(F.concat(F.regexp_replace(o, r"[. ]+$", ""), F.lit(". "), n), r"^[. ]+|[. ]+$", ""), F.lit(".")))
    parts = F.split(joined, r"\. ")
    # the first suffix of sentences that fits, else the last sentence
    sizes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ". "))
    fit = F.coalesce(F.get(F.filter(sizes, lambda s: F.length(s) <= most), 0), F.element_at(parts, -1))
    return F.when((n == "") | (F.lower(n) == F.lower(o)) | ~novel(old, new), F.coalesce(old, F.lit(""))).otherwise(F.when(F.length(joined) <= most, joined).otherwise(fit))


def cut(x: Column, limit: Column | int) -> Column:
    """At most `limit` characters, ending at the last line, sentence, clause or word end past 60 % of it, and marked."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    head = F.substring(x, F.lit(1), F.greatest(limit - 2, F.lit(1)).cast("int"))
    least = F.floor(limit * 6 / 10)
    out = None
    for sep in ("\n", ". ", "; ", ", ", " "):
        at = F.length(head) - F.length(F.substring_index(head, sep, -1)) - len(sep)  # place of the last one, from 0
        has = F.contains(head, F.lit(sep)) & (at >= least)
        kept = F.substring(head, F.lit(1), (at + (1 if sep == ". " else 0)).cast("int"))
        out = F.when(has, kept) if out is None else out.when(has, kept)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(out.otherwise(head), r"\s+$", ""), F.lit(" …")))


def window(line: Column, tokens: Column, room: Column | int) -> Column:
    """A slice of at most `room` characters around the first token found, marked where it is cut."""
    room = room if isinstance(room, Column) else F.lit(room)
    low = F.lower(line)
    places = F.filter(F.transform(tokens, lambda t: F.position(t, low)), lambda p: p > 0)
    pos = F.coalesce(F.array_min(places), F.lit(1)) - 1
    start0 = F.greatest(F.lit(0), pos - F.floor(room / 3).cast("int"))
    end = F.least(F.length(line), start0 + room - 4)
    start = F.greatest(F.lit(0), end - (room - 4))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(line, (start + 1).cast("int"), (end - start).cast("int"))), F.when(end < F.length(line), "…").otherwise(""))


def clipped(x: Column, limit: Column | int) -> Column:
    """At most `limit` characters, the last of them an ellipsis if something is left out."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substring(x, F.lit(1), (limit - 1).cast("int"))), F.lit("…")))


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def inbox_key(x: Column) -> Column:
    """Identity of a task text: white space, middle dots, case and closing punctuation don't matter."""
    n = F.lower(F.replace(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("·"), F.lit("-")))
    return F.substring(F.sha2(F.regexp_replace(n, r"[.!?,;: ]+$", ""), 256), 1, 16)


def fact_key(x: Column) -> Column:
    n = F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), r"[.!]+$", "")
    return F.substring(F.sha1(n), 1, 16)


def is_automation(x: Column, marks: list[str] = AUTOMATION) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | x.contains(m)
    return F.coalesce(out, F.lit(False))


def tolerant_json(x: Column, schema: str) -> Column:
    """The outermost braces of a text that may have fences or prose around them; null if they hold no JSON."""
    return F.from_json(F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?s)(\{.*\})", 1), F.lit("")), schema)


def first_heading(body: Column, fallback: Column) -> Column:
    h = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?m)^# ([^\r\n]*)", 1)
    return F.when(F.coalesce(body, F.lit("")).rlike(r"(?m)^# "), F.trim(h)).otherwise(fallback)


def summary(body: Column, limit: int = 400) -> Column:
    """Lines that are no headings, joined."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), r"\r\n|\n|\r"), lambda s: (F.trim(s) != "") & ~s.startswith("#"))
    return F.substring(F.array_join(F.transform(lines, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), " "), 1, limit)


def now_block(body: Column) -> Column:
    """Lines between `## Now` and the next heading."""
    got = F.regexp_extract(F.concat(F.lit("\n"), F.coalesce(body, F.lit("")), F.lit("\n# ")), r"(?s)\n## Now[ \t]*\r?\n(.*?)\n#{1,6} ", 1)
    return F.filter(F.transform(F.split(got, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")


def paths_in(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?:/[\w.-]+){2,}"), F.lit(0))


def file_links(x: Column) -> Column:
    """Paths of other files named in a text, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"((?:profile|courses|applications|orgs|projects|people|apps|topics|docs|areas|log)/[\w.\-]+\.md)"), F.lit(1)))
