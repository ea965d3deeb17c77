"""Problem 2: records whose word sets are almost the same.

Prefix-filtered join with parity sketches.  All words have one order, rarest first: words in at most `rare_df` records by hash, then
the others by the number of records they are in.  A Jaccard threshold bounds from below how many words two sets of given sizes share; sets of n and m
words that share c have one of their first n - c + 1 and m - c + 1 words in common.

Sizes are divided into bands, and every pair of bands that a pair of records can be in is a cell with keys of its own: the closer the
sizes are known, the fewer words open a set.  So every pair over the threshold meets at a word of a cell, whatever the data are.

Pairs that meet are filtered by sketches: every word flips one bit of a record's sketch, so two sketches differ in at most as many bits as
the sets differ in words, and the threshold bounds that from above.  The exact word sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import words
from ..workspace import Workspace

#: Sizes of a band, the largest to the smallest.  Narrow bands bound the shared words closely, which makes prefixes short, but a record is in more cells.
BAND = 1.25
#: Rows and columns of a piece of a table of distances, which fits a core's cache.
TILE = 128, 2048
#: Rows of one key that are compared in one run; a key that has more is cut into blocks.
RUN = 32_768
#: Counters that keys are first counted by; only keys of full ones are counted themselves.
COUNTERS = 1 << 18


def word_sets(df: DataFrame, rec_id: Column, parts: list[Column], least: int = 20) -> DataFrame:
    """(id, toks): the sorted hashes of a record's distinct words; null parts count as empty, small records are left out, repeated rows of an id once (the smallest set stays if they differ)."""
    text = F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
    toks = F.array_sort(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))))
    x = df.select(rec_id.cast("string").alias("id"), toks.alias("toks")).where("id is not null").where(F.size("toks") >= least)
    return x


def bands(least: int) -> np.ndarray:
    """Upper sizes of the size bands: a record meets records of its own band and of the next ones up to its size / threshold."""
    ups, n = [], least
    while n < 1e8:
        n = max(n, int(n * BAND))
        ups.append(n)
        n += 1
    return np.array(ups)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A second hash of 64-bit hashes."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def packed(sketch: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """52 bits of sketch, 2 of the side in its cell (0 a cell of one band, 1 the smaller, 2 the larger band) and 10 of size in one number; sizes from 1023 on are written as 1023 and not compared by sketch."""
    return (sketch << np.uint64(12)) | (side.astype(np.uint64) << np.uint64(10)) | np.minimum(size, 1023).astype(np.uint64)


def parity_sketch(h: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """116 bits a record, one of them flipped by each of its words, as words of 64 and 52 bits."""
    bit = mix(h, 0) % np.uint64(116)
    low = bit < np.uint64(64)
    a, b = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    np.bitwise_xor.at(a, owner[low], np.uint64(1) << bit[low])
    np.bitwise_xor.at(b, owner[~low], np.uint64(1) << (bit[~low] - np.uint64(64)))
    return a, b


def ordered(owner: np.ndarray, h: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The words of every record (flat, by owner and by hash), rarest first."""
    if not len(common):
        return h
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    place = np.where(common[at] == h, rank[at], 0)
    return h[np.argsort(owner * (len(common) + 1) + place, kind="stable")]


def sketches(cls: np.ndarray, offsets: np.ndarray, toks: np.ndarray, common: np.ndarray, rank: np.ndarray, threshold: float, ups: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (key, cls, sketch, sketch, side and size) of the words that open a record in each of its cells, for records given as flat arrays; rank: places of common words from 1 on."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    h = toks.view(np.uint64)
    sk, rest = parity_sketch(h, owner, len(n))
    h = ordered(owner, h, common, rank)
    least_of = np.r_[0, ups[:-1] + 1]
    share = threshold / (1 + threshold)
    smallest, largest = np.ceil(threshold * n - 1e-9).astype(np.int64), np.floor(n / threshold + 1e-9).astype(np.int64)
    band, low, top = np.searchsorted(ups, n), np.searchsorted(ups, smallest), np.searchsorted(ups, largest)
    keys, owners, sides = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(int((low - band).min()) if len(n) else 0, int((top - band).max()) + 1 if len(n) else 0):
        other = band + step  # the other record's band
        inside = np.flatnonzero((low <= other) & (other <= top))
        if not len(inside):
            continue
        size, other = n[inside], other[inside]
        overlap = np.ceil(share * (size + np.maximum(least_of[other], smallest[inside])) - 1e-9).astype(np.int64)
        first = np.minimum(size - overlap + 1, size)
        o = np.repeat(inside, first)
        at = offsets[o] + np.arange(len(o)) - np.repeat(np.cumsum(first) - first, first)
        cell = (np.maximum(band[inside], other) << 32) + np.minimum(band[inside], other)
        keys.append(mix(h[at] ^ mix(np.repeat(cell, first).astype(np.uint64), 3), 4))
        owners.append(o)
        sides.append(np.full(len(o), 0 if step == 0 else 1 if step > 0 else 2))
    key, o = np.concatenate(keys), np.concatenate(owners)
    return key, cls[o], sk[o], packed(rest[o], np.concatenate(sides), n[o])


def split_frequent(key: np.ndarray, cls: np.ndarray, sk: np.ndarray, pack: np.ndarray, frequent: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of frequent keys go to all pairs of blocks that hold theirs, so that no task gets a whole frequent key."""
    if not len(frequent):
        return key, cls, sk, pack
    at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
    hot = np.flatnonzero(frequent[at] == key)
    if not len(hot):
        return key, cls, sk, pack
    s = blocks[at[hot]]
    own = (mix(cls[hot].view(np.uint64), 7) % s.astype(np.uint64)).astype(np.int64)
    r = np.repeat(np.arange(len(hot)), s - 1)
    other = np.arange(len(r)) - np.repeat(np.cumsum(s - 1) - (s - 1), s - 1)
    other += other >= own[r]
    lo, hi = np.minimum(own[r], other), np.maximum(own[r], other)
    new = mix(key[hot][r] ^ mix((lo * s[r] + hi).astype(np.uint64), 8), 9)
    cold = np.ones(len(key), bool)
    cold[hot] = False
    return np.concatenate([key[cold], new]), *(np.concatenate([x[cold], x[hot][r]]) for x in (cls, sk, pack))


def close_pairs(key: np.ndarray, cls: np.ndarray, sk: np.ndarray, pack: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of rows of equal keys (sorted) whose sides, sketches and sizes allow the threshold, as a 2 x n array of classes."""
    alpha = (1 - threshold) / (1 + threshold)
    size, side, rest = (pack & np.uint64(1023)).astype(np.float32), (pack >> np.uint64(10)) & np.uint64(3), pack >> np.uint64(12)
    reach = np.where(size >= 1023, np.float32(127), np.minimum(np.float32(alpha) * size + np.float32(1e-4), np.float32(127)))  # 116 bits are all there are
    out: list[np.ndarray] = []

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        lo, hi = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        ok = ((lo >= np.float32(threshold) * hi - 1e-3) | (hi >= 1023)) & (cls[x] != cls[y])
        x, y = x[ok], y[ok]
        if len(x):
            out.append(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])]))

    def table(left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """All pairs of two sets of rows, both by size; of one set with itself each once."""
        l1, l2, ls, lr = sk[left], rest[left], size[left], reach[left]
        r1, r2, rs, rr = sk[right], rest[right], size[right], reach[right]
        rows, cols = TILE
        for i in range(0, len(left), rows):
            j = min(len(left), i + rows)
            # Sorted by size: columns of sizes beyond the threshold can be left out.
            first = i if same else int(np.searchsorted(rs, threshold * ls[i] - 1))
            last = int(np.searchsorted(rs, ls[j - 1] / threshold + 1)) if ls[j - 1] < 700 else len(right)
            for k in range(first, last, cols):
                m = min(last, k + cols)
                most = (lr[j - 1] + rr[k:m]).astype(np.uint8)[None, :]  # of all rows here
                d = np.bitwise_count(l1[i:j, None] ^ r1[None, k:m])
                if most[0, -1] > 20:  # half of the bits don't tell enough
                    d += np.bitwise_count(l2[i:j, None] ^ r2[None, k:m])
                at = np.flatnonzero(d <= most)
                if not len(at):
                    continue
                a, b = i + at // (m - k), k + at % (m - k)
                ok = np.bitwise_count(l1[a] ^ r1[b]) + np.bitwise_count(l2[a] ^ r2[b]) <= lr[a] + rr[b]
                if same:
                    ok &= b > a
                keep(left[a[ok]], right[b[ok]])

    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[starts, len(key)])
    small = np.repeat(length <= 24, length)
    for d in range(1, 24):
        if d >= len(key):
            break
        x = np.flatnonzero(small[:-d] & (key[d:] == key[:-d]))
        if not len(x):
            break
        y = x + d
        ok = ((side[x] != side[y]) | (side[x] == 0)) & (np.bitwise_count(sk[x] ^ sk[y]) + np.bitwise_count(rest[x] ^ rest[y]) <= reach[x] + reach[y])
        keep(x[ok], y[ok])
    for lo, n in zip(starts[length > 24], length[length > 24]):
        order = lo + np.argsort(size[lo : lo + n], kind="stable")
        if side[lo] == 0:
            table(order, order, True)
        else:
            table(order[side[order] == 1], order[side[order] == 2], False)
    return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)


def class_pairs(ws: Workspace, classes: DataFrame, threshold: float, rare_df: int | None, least: int) -> DataFrame:
    """(a, b, jaccard): pairs of different classes (cls, toks) of equal word sets over the threshold, a < b."""
    spark = classes.sparkSession
    # Sums over all records: how many there are and the average size bound the list of common words, which travels.
    total = classes.agg(F.count("*").alias("n"), F.sum(F.size("toks")).alias("w")).first()
    if not total["n"]:
        return spark.createDataFrame([], "a long, b long, jaccard double")
    rare_df = rare_df or max(64, total["n"] // 4000)
    freq = classes.select(F.explode("toks").alias("t")).groupBy("t").count().where(F.col("count") > rare_df)
    rows = freq.toArrow()  # at most words / rare_df: 4000 times the mean size of a record
    order = np.argsort(rows["t"].to_numpy().view(np.uint64))
    rank = np.empty(len(order), np.int64)
    rank[np.argsort(rows["count"].to_numpy()[order], kind="stable")] = np.arange(1, len(order) + 1)
    common = spark.sparkContext.broadcast((rows["t"].to_numpy().view(np.uint64)[order], rank))
    ups = bands(least)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            if b.num_rows:
                off = b.column("toks").offsets.to_numpy()
                yield sketches(b.column("cls").to_numpy(), off - off[0], b.column("toks").flatten().to_numpy(), *common.value, threshold, ups)

    # Keys that are too frequent for one run, exactly: counters first, which tasks add up, then the keys of full counters.
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for k, *_ in keyed(batches):
            total += np.bincount((k % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    at = classes.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") > RUN).toArrow()["at"].to_numpy()  # no more than rows / RUN
    full = spark.sparkContext.broadcast(np.sort(at))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, *_ in keyed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(k[np.isin((k % np.uint64(COUNTERS)).astype(np.int64), full.value)].view(np.int64))], names=["key"])

    seen, blocks = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(at):
        rows = classes.mapInArrow(suspected, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > RUN).toArrow()  # no more than rows / RUN
        order = np.argsort(rows["key"].to_numpy().view(np.uint64))
        seen, blocks = rows["key"].to_numpy().view(np.uint64)[order], np.ceil(rows["n"].to_numpy()[order] / (RUN / 2)).astype(np.int64)
    frequent = spark.sparkContext.broadcast((seen, blocks))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in keyed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in split_frequent(*rows, *frequent.value)], names=["key", "cls", "sk", "pack"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def run(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            if cut:
                both = close_pairs(key[:cut], t["cls"].to_numpy()[:cut], t["sk"].to_numpy()[:cut].view(np.uint64), t["pack"].to_numpy()[:cut].view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
            held[:] = t.slice(cut).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= 400_000:
                yield from run(False)
                n = sum(x.num_rows for x in held)
        if held:
            yield from run(True)

    rows = classes.mapInArrow(emit, "key long, cls long, sk long, pack long").repartition("key").sortWithinPartitions("key")
    cand = rows.mapInArrow(compare, "a long, b long").distinct()
    cand = ws.save(cand)
    ta = cand.join(classes.select(F.col("cls").alias("a"), F.col("toks").alias("ta")), "a")
    tb = ta.join(classes.select(F.col("cls").alias("b"), F.col("toks").alias("tb")), "b")
    inter = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - inter
    return tb.select("a", "b", (inter / union).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def linked(sets: DataFrame, threshold: float = 0.7, rare_df: int | None = None, least: int = 20, share_of_blocks: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Membership (id, cls) and class links (a, b, jaccard).

    sets: (id, toks) as `word_sets` gives them.  Records of equal word sets are one class, and links are between classes, so
    copies are never expanded; `expand` does that where a result asks for it.  Nothing is capped or sampled; an empty
    input gives empty tables.  `share_of_blocks` is taken for older callers only: every pair over the threshold is found whatever it is.
    """
    ws = Workspace(sets.sparkSession, "near")
    own = ws.save(sets.withColumn("cls", F.xxhash64("toks")))
    members = own.groupBy("id").agg(F.min("cls").alias("cls"))
    classes = ws.save(own.groupBy("cls").agg(F.first("toks").alias("toks")))
    links = ws.save(class_pairs(ws, classes, threshold, rare_df, least))
    return ws.save(members), links


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a_id, b_id): links between records, the smaller id first, copies included."""
    x = members.select(F.col("id").alias("x"), F.col("cls").alias("cx"))
    y = members.select(F.col("id").alias("y"), F.col("cls").alias("cy"))
    across = links.join(x, F.col("a") == F.col("cx")).join(y, F.col("b") == F.col("cy")).select("x", "y")
    same = x.join(y, (F.col("cx") == F.col("cy")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(same).select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).distinct()


def per_record(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, copies, links): every record with its class and how many other classes that one is linked to."""
    ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    size = members.groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("class_id"))
    return members.join(size.join(ends, "cls", "left"), "cls").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
