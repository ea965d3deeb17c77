"""Markdown directories and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

SKIP_FOLDERS = [".git", "graph", "__pycache__"]
SKIP_ROOT = ["NOW.md", "DIGEST.md", "LOOPS.md", "LOOPS-INBOX.md", "DECISIONS.md", "README.md"]
ALIAS_KEYS = ["person", "app", "area", "code", "project", "org"]
MOST_TOKENS = 3000


def indexable(path: Column) -> Column:
    """Markdown files outside skipped folders that are no generated root file."""
    parts = F.split(path, "/")
    inside = F.exists(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: p.isin(SKIP_FOLDERS))
    return path.endswith(".md") & ~inside & ~((F.size(parts) == 1) & path.isin(SKIP_ROOT))


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the indexable files below a folder; whole files, so line ends stay."""
    base = root.rstrip("/")
    raw = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.element_at(F.split(F.col("_metadata.file_path"), F.lit(base.removeprefix("file://") + "/")), -1)
    return raw.select(path.alias("path"), F.col("value").alias("text")).where(indexable(F.col("path")))


def front_matter(text: Column) -> tuple[Column, Column, Column]:
    """(map of scalar and list fields as text, body, error): the block between the first two `---` lines, if the text opens with one."""
    rx = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?\z"
    has = text.rlike(r"(?s)\A---[ \t]*\r?\n.*?\r?\n---")
    block = F.regexp_extract(text, rx, 1)
    rows = F.filter(F.split(block, r"\r?\n"), lambda s: (F.trim(s) != "") & ~F.trim(s).startswith("#"))
    bad = F.exists(rows, lambda s: ~s.contains(":"))
    pairs = F.transform(F.filter(rows, lambda s: s.contains(":")), lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.substring(s, F.length(F.substring_index(s, ":", 1)) + 2, F.length(s))), "^[\"']|[\"']$", "").alias("value")))
    # of a repeated key the last value stays
    m = F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])))
    ok = has & ~bad
    return F.when(ok, m), F.when(ok, F.coalesce(F.regexp_extract(text, rx, 2), F.lit(""))).otherwise(text), F.when(has & bad, F.lit("a line of the front matter has no colon"))


def list_value(x: Column) -> Column:
    """`[a, b]` or a scalar as an array."""
    inner = F.regexp_extract(x, r"^\[(.*)\]$", 1)
    items = F.transform(F.split(inner, ","), lambda s: F.regexp_replace(F.trim(s), "^[\"']|[\"']$", ""))
    return F.when(x.rlike(r"^\[.*\]$"), F.filter(items, lambda s: s != "")).when(F.coalesce(x, F.lit("")) != "", F.array(x)).otherwise(F.array().cast("array<string>"))


def records(files: DataFrame) -> DataFrame:
    """Index records of (path, text): kind, title, aliases, summary, tokens, updated, size, sha, links, has_frontmatter, problem.

    A bad header isn't fatal: the whole text is then the body.  Tokens are the first 3 000 in alphabetical order.
    """
    fm, body, problem = front_matter(F.col("text"))
    x = files.where("text is not null").select("path", "text", fm.alias("_m"), body.alias("_body"), problem.alias("problem"))
    get = lambda k: F.try_element_at("_m", F.lit(k))
    stem = F.replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), F.lit("-"), F.lit(" "))
    x = x.withColumn("title", F.coalesce(F.nullif(F.trim(get("name")), F.lit("")), X.first_heading(F.col("_body"), stem)))
    more = F.filter(F.array(*[F.trim(get(k)) for k in ALIAS_KEYS]), lambda a: F.coalesce(a, F.lit("")) != "")
    x = x.withColumn("aliases", F.filter(F.array_distinct(F.concat(list_value(get("aliases")), more)), lambda a: F.lower(a) != F.lower("title")))
    toks = X.search_tokens(F.concat_ws(" ", "title", F.array_join("aliases", " "), "_body"))
    return x.select("path", X.file_kind(F.col("path"), get("type")).alias("kind"), "title", "aliases", X.summary(F.col("_body")).alias("summary"), F.slice(F.array_sort(toks), 1, MOST_TOKENS).alias("tokens"), F.coalesce(get("updated"), F.lit("")).alias("updated"), F.octet_length("text").alias("size"), F.substring(F.sha2("text", 256), 1, 16).alias("sha"), F.filter(X.file_links(F.col("_body")), lambda t: t != F.col("path")).alias("links"), F.col("_m").isNotNull().alias("has_frontmatter"), "problem")
