"""Problem 6: pieces of oversized texts, cut at natural boundaries.

A text over the limit is split by the first separator of a hierarchy (section, paragraph, line, sentence, word,
character) that yields parts under the limit; a part that is still too large is split by the next one.  Parts are then packed
greedily, each piece opening with the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of parts, coarse to fine: section heading ahead, blank line, line, sentence, word.
BOUNDARIES = [re.compile(p) for p in (r"\n(?=#{1,6}\s)", r"(?:\r?\n)[ \t]*(?:\r?\n)+", r"\r?\n", r"(?<=[.!?…])[\"')\]]*\s+", r"\s+")]


def parts(text: str, limit: int, level: int = 0) -> Iterator[str]:
    """Consecutive parts whose concatenation is the text, none longer than the limit."""
    if len(text) <= limit:
        if text:
            yield text
        return
    if level == len(BOUNDARIES):
        for i in range(0, len(text), limit):
            yield text[i : i + limit]
        return
    last = 0
    for m in BOUNDARIES[level].finditer(text):
        if m.end() > last:
            yield from parts(text[last : m.end()], limit, level + 1)
            last = m.end()
    yield from parts(text[last:], limit, level + 1)


def tail(piece: str, overlap: int) -> str:
    """The last characters of a piece, at most `overlap`, opening at a word where there is one."""
    if overlap <= 0:
        return ""
    end = piece[-overlap:]
    if len(piece) > overlap and not piece[-overlap - 1].isspace() and (m := re.search(r"\s+", end)) and m.end() < len(end):
        end = end[m.end() :]
    return end


def pieces(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[str, int]]:
    """Ordered (piece, length of the repeated start); dropping the repeated starts gives the text back."""
    if len(text) <= limit:
        return [(text, 0)]
    out: list[tuple[str, int]] = []
    repeat, own = "", ""
    for part in parts(text, limit - overlap):
        if own and len(repeat) + len(own) + len(part) > limit:
            out.append((repeat + own, len(repeat)))
            repeat, own = tail(repeat + own, overlap), ""
        own += part
    out.append((repeat + own, len(repeat)))
    return out


def split(df: DataFrame, rec_id: Column, text: Column, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(log_id, piece_no, n_pieces, overlap, piece) of all texts longer than `limit` code points.

    Null, empty and short texts give no rows.  A record delivered twice with the same id and text gives its pieces
    once; the same id with two texts gives both, told apart by `text_sha`.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    long = df.select(rec_id.cast("string").alias("log_id"), text.cast("string").alias("_text")).where(F.length("_text") > limit)
    # Deduplicate by key: the texts themselves are moved once, to the task that cuts them, which also spreads them evenly.
    long = long.withColumn("text_sha", F.substring(F.sha2("_text", 256), 1, 16)).groupBy("log_id", "text_sha").agg(F.first("_text").alias("_text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, h, n, len(p), k, x) for i, h, t in zip(b["log_id"], b["text_sha"], b["_text"]) for p in [pieces(t, limit, overlap)] for n, (x, k) in enumerate(p)]
            yield pd.DataFrame(rows, columns=["log_id", "text_sha", "piece_no", "n_pieces", "overlap", "piece"])

    return long.mapInPandas(cut, "log_id string, text_sha string, piece_no int, n_pieces int, overlap int, piece string")
