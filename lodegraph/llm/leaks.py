"""Problem 8: evaluation passages inside training texts.

Every item is cut into windows of as many words as the shortest passage that counts as a leak.  Windows of items and documents
get SimHash fingerprints; the fingerprint is cut into radius + 1 blocks, so that any two within the radius agree in a
block; candidates that agree are compared in full and then verified on their words.  Equal passages have equal fingerprints, so none
is lost, and where only those are asked for, windows with a word that no item has get no fingerprint.  Passages with changed words have fingerprints far apart; their candidates are windows that share one of the item window's
heaviest words (`Anchors`).  Items travel to the executors in portions of bounded size, as many as there are; documents are read whole, once
for each portion, and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import WORD_PY, words
from ..workspace import Workspace

WORD = re.compile(WORD_PY)
#: Characters of the items that travel at once: what a driver and a task can hold.  More items go in several portions.
PORTION = 20_000_000


class Hasher(dict):
    """word -> 64-bit hash, remembered per task and reset before it grows beyond its bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def hashes(text: str, known: Hasher) -> np.ndarray:
    return np.array([known[w] for w in WORD.findall(text.lower())], dtype=np.uint64)


def listed(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """As `hashes`, with 0 for words outside the vocabulary."""
    get = vocabulary.get
    return np.array([get(w, 0) for w in WORD.findall(text.lower())], dtype=np.uint64)


def simhash(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of `width` words: bit b is the majority of bit b over the window's words."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int16)
    total = np.cumsum(bits, axis=0, dtype=np.int16)  # wraps; differences over a window do not
    total[width:] -= total[:-width].copy()
    up = total[width - 1 :] * 2 > width
    return np.packbits(up, axis=1, bitorder="little").view("<u8").ravel()


def simhash_rows(h: np.ndarray) -> np.ndarray:
    """Fingerprints of windows that are given as rows of word hashes."""
    out = np.empty(len(h), np.uint64)
    for i in range(0, len(h), 50_000):
        part = np.ascontiguousarray(h[i : i + 50_000])
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), part.shape[1], 8), axis=2, bitorder="little")
        out[i : i + 50_000] = np.packbits(bits.sum(axis=1, dtype=np.int16) * 2 > part.shape[1], axis=1, bitorder="little").view("<u8").ravel()
    return out


class ItemIndex:
    """Fingerprints of item windows in one sorted table per block."""

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int):
        self.vocabulary = known = Hasher()
        self.width, self.radius, self.blocks = width, radius, radius + 1
        self.edges = np.linspace(0, 64, self.blocks + 1).astype(int)
        prints, owner, at, words = [], [], [], []
        for i, t in items:
            h = hashes(t or "", known)
            p = simhash(h, width)
            prints.append(p)
            owner.append(np.full(len(p), i, np.int64))
            at.append(np.arange(len(p)))
            words.append(np.lib.stride_tricks.sliding_window_view(h, width) if len(p) else np.empty((0, width), np.uint64))
        self.prints = np.concatenate([np.empty(0, np.uint64), *prints])
        self.owner = np.concatenate([np.empty(0, np.int64), *owner])
        self.at = np.concatenate([np.empty(0, np.int64), *at])
        self.words = np.concatenate([np.empty((0, width), np.uint64), *words])
        self.tables = []
        for b in range(self.blocks):
            key = self.block(self.prints, b)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << min(20, int(self.edges[b + 1] - self.edges[b])), bool)
            seen[(key & np.uint64(len(seen) - 1)).astype(np.int64)] = True
            self.tables.append((order, key[order], seen))

    def block(self, p: np.ndarray, b: int) -> np.ndarray:
        lo, n = int(self.edges[b]), int(self.edges[b + 1] - self.edges[b])
        return (p >> np.uint64(lo)) & np.uint64((1 << n) - 1 if n < 64 else 0xFFFFFFFFFFFFFFFF)

    def near(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window of p, window of the items) within the radius, each once."""
        left, right = [], []
        for b, (order, key, seen) in enumerate(self.tables):
            k = self.block(p, b)
            w = np.flatnonzero(seen[(k & np.uint64(len(seen) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(key, k[w], "left"), np.searchsorted(key, k[w], "right")
            n = hi - lo
            if not n.sum():
                continue
            a = np.repeat(w, n)
            c = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            ok = np.bitwise_count(p[a] ^ self.prints[c]) <= self.radius
            left.append(a[ok])
            right.append(c[ok])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return both[0], both[1]


class Anchors:
    """Item windows by their heaviest words, of which a similar passage must have one.

    Words of a window that differ weigh at most 1 - similarity of it; its heaviest words that together weigh more can't all differ.
    """

    def __init__(self, words: np.ndarray, weights: np.ndarray, similarity: float):
        self.words, self.weights, self.least = words, weights, similarity * weights.sum(axis=1) - 1e-9
        order = np.argsort(-weights, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(weights, order, 1), axis=1) - np.take_along_axis(weights, order, 1)
        c, rank = np.nonzero(before <= (weights.sum(axis=1) - self.least)[:, None])
        at = order[c, rank]
        by = np.argsort(words[c, at], kind="stable")
        self.key, self.window, self.at = words[c, at][by], c[by], at[by]
        self.vocabulary = np.unique(words)
        self.bit = words & np.uint64(63)

    def near(self, h: np.ndarray, owner: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in h, window of the items, similarity) in portions: the item's words that a document's window holds in the same order, by weight."""
        width = self.words.shape[1]
        windows = np.lib.stride_tricks.sliding_window_view(h, width)
        # A bit for every word that items have: what a window's bits lack, it lacks.
        known = self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)] == h
        bits = np.where(known, np.uint64(1) << (h & np.uint64(63)), np.uint64(0))
        held = np.bitwise_or.reduce(np.lib.stride_tricks.sliding_window_view(bits, width), axis=1)
        lo, hi = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
        ends = np.cumsum(hi - lo)
        for first in range(0, int(ends[-1]), most):
            k = np.arange(first, min(first + most, int(ends[-1])))
            j = np.searchsorted(ends, k, "right")
            entry = hi[j] - (ends[j] - k)
            a, c = j - self.at[entry], self.window[entry]
            ok = (a >= 0) & (a < len(windows))
            a, c = a[ok], c[ok]
            ok = owner[a] == owner[a + width - 1]
            a, c = a[ok], c[ok]
            ok = (((held[a][:, None] >> self.bit[c]) & np.uint64(1)) * self.weights[c]).sum(axis=1) >= self.least[c]
            a, c = a[ok], c[ok]
            equal = self.words[c][:, :, None] == windows[a][:, None, :]
            ok = (equal.any(axis=2) * self.weights[c]).sum(axis=1) >= self.least[c]  # whatever the order
            a, c, equal = a[ok], c[ok], equal[ok]
            best = np.zeros((width + 1, len(a)))
            for i in range(width):
                now = np.zeros_like(best)
                for x in range(width):
                    now[x + 1] = np.maximum(np.maximum(best[x + 1], now[x]), np.where(equal[:, i, x], best[x] + self.weights[c, i], 0))
                best = now
            ok = best[width] >= self.least[c]
            yield a[ok], c[ok], best[width][ok] / self.weights[c[ok]].sum(axis=1)


def find(docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, width: int = 12, radius: int = 3, similarity: float = 1.0, batch_words: int = 200_000) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, best): documents with windows of an item.

    similarity: least weighted share of an item window's words that a document's window of as many words holds in the same order (words
    weigh more the fewer items have them); 1.0 asks for equal passages.  Below 1.0 all passages with changed words are found, and those with words
    put in or left out where the windows, laid over each other at one of the item window's heaviest words, are similar enough; `radius` is then not used.  windows counts the item's windows found, best is the largest similarity.
    Items of fewer than `width` words have no windows; null and empty texts give none; a document id that occurs twice
    gives its rows once, with the larger figures.
    """
    spark = docs.sparkSession
    clean = items.select(item_id.cast("long").alias("i"), item_text.alias("t")).where("i is not null and t is not null").dropDuplicates()
    size = clean.agg(F.sum(F.length("t")).alias("chars"), F.count("*").alias("n"), F.max(F.length("t")).alias("top")).first()
    if not size["n"]:
        return spark.createDataFrame([], "doc_id long, item_id long, windows long, item_windows long, best double")
    # Weights of words are those of all items, whatever the portions.
    n_items = size["n"]
    portions = 1 if size["chars"] <= PORTION else -(-2 * size["chars"] // PORTION)
    part = clean.withColumn("_p", F.pmod(F.xxhash64("i"), F.lit(portions)))
    of_word = clean.select(F.explode(F.array_distinct(words(F.col("t")))).alias("w")).groupBy("w").agg(F.count("*").alias("df")) if portions > 1 and similarity < 1 else None
    ws = Workspace(spark, "leaks")
    out = None
    for p in range(portions):
        own = part.where(F.col("_p") == p)
        rows = own.select("i", "t").collect()  # about half of PORTION characters, or one item
        df = None
        if of_word is not None:
            mine = own.select(F.explode(F.array_distinct(words(F.col("t")))).alias("w")).distinct()
            df = {xxhash.xxh64_intdigest(r["w"]): r["df"] for r in of_word.join(mine, "w", "left_semi").collect()}  # no more than the portion has words
        got = _scanned(docs, doc_id, text, [(r["i"], r["t"]) for r in rows], n_items, df, width, radius, similarity, batch_words)
        if portions > 1:
            got = ws.save(got)
        out = got if out is None else out.unionByName(got)
    return out


def _scanned(docs: DataFrame, doc_id: Column, text: Column, items: list[tuple[int, str]], n_items: int, df: dict[int, int] | None, width: int, radius: int, similarity: float, batch_words: int) -> DataFrame:
    """`find` for one portion of the items; df: how many of all items have a word, by its hash, if these aren't all."""
    spark = docs.sparkSession
    index = ItemIndex(items, width, radius)
    if df is None:
        of_word: dict[int, set[int]] = {}
        for w, o in zip(index.words, index.owner):
            for x in w:
                of_word.setdefault(int(x), set()).add(int(o))
        df = {x: len(o) for x, o in of_word.items()}
    weights = np.vectorize(lambda x: np.log(1 + n_items / df.get(int(x), 1)), otypes=[float])(index.words) if len(index.words) else np.empty((0, width))
    anchors = Anchors(index.words, weights, similarity) if similarity < 1 else None
    vocabulary = dict(index.vocabulary)
    index.vocabulary = None
    shared = spark.sparkContext.broadcast((index, weights, anchors, vocabulary if anchors is None else None))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights, anchors, vocabulary = shared.value
        known = Hasher()
        out: list[tuple[int, int, int, float]] = []

        def flush(ids: list[int], hs: list[np.ndarray]) -> None:
            if not ids or not len(index.prints):
                return
            h = np.concatenate(hs)
            owner = np.repeat(np.arange(len(ids)), [len(x) for x in hs])
            if len(h) < width:
                return
            if anchors is None:
                # Windows within one document all of whose words some item has.
                unknown = np.cumsum(h == 0)
                inside = np.r_[unknown[width - 1], unknown[width:] - unknown[:-width]] == 0
                whole = np.flatnonzero(inside & (owner[: len(inside)] == owner[width - 1 :]))
                if not len(whole):
                    return
                spread = whole[:, None] + np.arange(width)
                a, c = index.near(simhash_rows(h[spread]))
                if not len(a):
                    return
                a = whole[a]
                same = np.lib.stride_tricks.sliding_window_view(h, width)[a] == index.words[c]
                sim = (same * weights[c]).sum(axis=1) / weights[c].sum(axis=1)
                ok = sim >= similarity - 1e-9
                portions = [(a[ok], c[ok], sim[ok])]
            else:
                portions = anchors.near(h, owner)
            found: dict[tuple[int, int], tuple[set[int], float]] = {}
            for a, c, sim in portions:
                for d, o, w, s in zip(owner[a], index.owner[c], index.at[c], sim):
                    seen, best = found.get((int(d), int(o)), (set(), 0.0))
                    seen.add(int(w))
                    found[int(d), int(o)] = (seen, max(best, float(s)))
            out.extend((ids[d], o, len(w), s) for (d, o), (w, s) in found.items())

        ids: list[int] = []
        hs: list[np.ndarray] = []
        n = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                hs.append(hashes(t, known) if vocabulary is None else listed(t, vocabulary))
                n += len(hs[-1])
                if n >= batch_words:
                    flush(ids, hs)
                    ids, hs, n = [], [], 0
        flush(ids, hs)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "windows", "best"])

    hits = docs.select(doc_id.cast("long").alias("d"), text.alias("t")).where("d is not null and t is not null").mapInArrow(scan, "doc_id long, item_id long, windows long, best double")
    once = hits.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("best").alias("best"))
    n_windows = {int(o): int(n) for o, n in zip(*np.unique(index.owner, return_counts=True))}
    sizes = spark.createDataFrame(sorted(n_windows.items()) or [(-1, 0)], "item_id long, item_windows long")
    return once.join(F.broadcast(sizes), "item_id").select("doc_id", "item_id", "windows", "item_windows", F.round("best", 6).alias("best"))  # sizes: one row per item, checked above
