"""Problem 7: the most similar vectors of every vector.

Hashing by lines: every line (a direction fitted on a bounded sample) orders all vectors by their projection, and the vectors
that project furthest along it form its bucket.  Lines that stand close together share a bucket, so a crowd, which many
lines cut at random, is compared as a whole.  A query's window is its own bucket and is widened, by virtual
rehashing, to the next lines in its own order until the rest are too far for a vector that is similar enough.  Pairs that collide in at least one window are verified: first in
dense blocks at half precision, then exactly.  The README says how and why this departs from windows on single random
projections.

Equal vectors are handled as one class and opened at the end, buckets are cut into blocks of bounded size, and every
block is read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Rows on which the lines are fitted; every row is indexed.
SAMPLE = 20_000
#: Stored vectors of one block; a larger bucket is cut into several.
BLOCK = 4096
#: Lines with at least this cosine share a bucket.
CROWD = 0.8
#: More than half precision can shift a cosine of unit vectors: 2 ** -11 for either side, and the sum.
HALF = 0.0011


def usable(df: DataFrame, key: Column, vector: Column, dim: int) -> DataFrame:
    """(key, v): one unit vector per key.  Null keys and vectors, other lengths, vectors of zeros and vectors with NaN or infinite numbers are left out; of a key with several vectors the first in array order stays."""
    x = df.select(key.cast("string").alias("key"), vector.cast("array<double>").alias("raw")).where(F.col("key").isNotNull() & (F.size("raw") == dim))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, b: a + b * b))
    x = x.withColumn("n", norm).where((F.col("n") > 0) & ~F.isnan("n") & (F.col("n") < float("inf")))
    x = x.groupBy("key").agg(F.min("raw").alias("raw"), F.min_by("n", "raw").alias("n"))
    return x.select("key", F.transform("raw", lambda a: (a / F.col("n")).cast("float")).alias("v"))


def fit_lines(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """`count` unit directions: rows of the sample, moved to the mean of the rows that project furthest along them."""
    lines = sample[:count].copy()
    for _ in range(rounds):
        best = (sample @ lines.T).argmax(axis=1)
        total = np.zeros_like(lines)
        np.add.at(total, best, sample)
        norm = np.linalg.norm(total, axis=1)
        lines[norm > 0] = total[norm > 0] / norm[norm > 0][:, None]
    return lines


def regions(lines: np.ndarray) -> np.ndarray:
    """The number of each line's bucket: lines are in one if a chain of lines with cosines of at least CROWD joins them."""
    label = np.arange(len(lines))
    while True:
        new = np.concatenate([np.where(lines[i : i + 256] @ lines.T >= CROWD, label, len(lines)).min(axis=1) for i in range(0, len(lines), 256)])
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1].astype(np.int32)
        label = new


def windows(x: np.ndarray, lines: np.ndarray, region: np.ndarray, least: float, widen: float) -> list[np.ndarray]:
    """The buckets of every row's window, its own first.

    A vector with cosine `least` to the row projects `least` times as far and, across that, by chance: by
    sqrt(1 - least ** 2) / sqrt(dim) times the distance of two lines.  A line is left out if it is behind the row's own by more
    than `widen` such deviations.
    """
    out = []
    for i in range(0, len(x), 512):
        p = x[i : i + 512] @ lines.T
        top = p.argmax(axis=1)
        apart = np.sqrt(np.maximum(2 - 2 * (lines[top] @ lines.T), 0))
        behind = least * (np.take_along_axis(p, top[:, None], 1) - p)
        row, line = np.nonzero(behind <= widen * np.sqrt(max(0.0, 1 - least**2) / x.shape[1]) * apart + 1e-6)
        own = region[top]
        row, bucket = np.unique(np.stack([row, region[line]]), axis=1)
        row, bucket = row[bucket != own[row]], bucket[bucket != own[row]]
        out += [np.r_[o, b].astype(np.int32) for o, b in zip(own, np.split(bucket, np.searchsorted(row, np.arange(1, len(p)))))]
    return out


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def links(vectors: DataFrame, dim: int, k: int = 5, least: float = 0.88, widen: float = 1.0, per_line: int = 200, most_lines: int = 8192) -> DataFrame:
    """(key, other, cosine, rank): for every vector the k most similar others with cosine of at least `least`.

    vectors: (key, v) as `usable` gives them.  Equal cosines (to 9 digits) are ranked by the smaller key.  An empty
    input or a single vector gives no rows.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "neighbours")
    # Classes of equal vectors; only the k + 1 smallest keys of a class can be among anyone's nearest.
    members = ws.save(vectors.withColumn("cls", F.xxhash64("v")))
    reps = ws.save(members.groupBy("cls").agg(F.first("v").alias("v"), F.count("*").alias("n")))
    total = reps.count()
    if total == 0:
        return spark.createDataFrame([], "key string, other string, cosine double, rank int")
    # By a threshold on a hash, so that tasks send no more than the sample.
    chosen = reps.where(F.pmod(F.xxhash64(F.lit(7), "cls"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / total))).select("v").toArrow()["v"].combine_chunks()
    sample = _matrix(chosen, dim) if len(chosen) else _matrix(reps.select("v").limit(1).toArrow()["v"].combine_chunks(), dim)
    count = int(min(max(1, total // per_line), most_lines, len(sample)))
    fitted = fit_lines(sample, count)
    region = regions(fitted)
    lines = spark.sparkContext.broadcast((fitted, region))

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dim)
            if not len(x):
                continue
            near = windows(x, *lines.value, least, widen)
            half = x.astype(np.float16)
            raw = half.view(np.uint8).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(near, pa.list_(pa.int32())), pa.array([r.tobytes() for r in raw], pa.binary())], names=["cls", "lines", "half"])

    hashed = ws.save(reps.select("cls", "v").mapInArrow(hash_rows, "cls long, lines array<int>, half binary"))
    # One row per bucket, at most as many as lines, whose number is a parameter: how many blocks it needs.
    sizes = {r["line"]: r["n"] for r in hashed.groupBy(F.col("lines")[0].alias("line")).agg(F.count("*").alias("n")).collect()}
    blocks = np.ones(region.max() + 1, np.int64)
    for line, n in sizes.items():
        blocks[line] = -(-n // BLOCK)
    n_blocks = F.array(*[F.lit(int(b)) for b in blocks]) if blocks.max() > 1 else None

    def of(line: Column) -> Column:
        return F.lit(1) if n_blocks is None else F.element_at(n_blocks, line + 1)

    own = hashed.select(F.col("lines")[0].alias("line"), F.pmod(F.xxhash64(F.lit(3), "cls"), of(F.col("lines")[0])).cast("int").alias("block"), F.lit(0).alias("role"), "cls", "half")
    asks = hashed.select(F.posexplode("lines").alias("probe", "line"), "cls", "half")
    # In the own bucket the stored rows of a block ask themselves, and the blocks after theirs.
    first = F.when(F.col("probe") == 0, F.pmod(F.xxhash64(F.lit(3), "cls"), of(F.col("line"))).cast("int") + 1).otherwise(0)
    last = (of(F.col("line")) - 1).cast("int")
    asks = asks.withColumn("first", first).where(F.col("first") <= last).withColumn("block", F.explode(F.sequence("first", last))).select("line", "block", F.lit(1).alias("role"), "cls", "half")

    def pick(sim: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of at least `least`; of a crowd only what can be among the k nearest of either side.  best: the k + 1 largest of every column so far."""
        enough = sim >= least - HALF
        if np.count_nonzero(enough) > 16 * k * len(sim) and min(sim.shape) > k + 1:
            best[:] = np.partition(np.concatenate([best, np.partition(sim, -k - 1, axis=0)[-k - 1 :]]), -k - 1, axis=0)[-k - 1 :]
            rows = np.partition(sim, -k - 1, axis=1)[:, -k - 1]
            enough &= (sim >= rows[:, None] - 2 * HALF) | (sim >= best.min(axis=0) - 2 * HALF)
        return np.nonzero(enough)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, stored, stored_keys, pend, pend_keys, best = None, [], [], [], [], None
        out: list[tuple[np.ndarray, ...]] = []

        def flushed() -> pa.RecordBatch:
            cols = [pa.array(np.concatenate(c)) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "s"])

        def pairs(keys_a: np.ndarray, a: np.ndarray, self_join: bool) -> None:
            nonlocal best
            if not stored or not len(a):
                return
            b, keys_b = np.concatenate(stored), np.concatenate(stored_keys)
            if best is None or best.shape[1] != len(b):
                best = np.full((k + 1, len(b)), -2, np.float32)
            for i in range(0, len(a), 1024):
                sim = a[i : i + 1024] @ b.T
                x, y = pick(sim, best)
                ka, kb = keys_a[i : i + 1024][x], keys_b[y]
                keep = ka < kb if self_join else ka != kb
                out.append((ka[keep], kb[keep], sim[x, y][keep]))

        def close() -> None:
            if stored:
                pairs(np.concatenate(stored_keys), np.concatenate(stored), True)
                if pend:
                    pairs(np.concatenate(pend_keys), np.concatenate(pend), False)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            place = np.stack([t["line"].to_numpy(), t["block"].to_numpy()], axis=1)
            role, keys = t["role"].to_numpy(), t["cls"].to_numpy()
            x = np.frombuffer(b"".join(t["half"].to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(x)]):
                if bucket != tuple(place[lo]):
                    close()
                    bucket, stored, stored_keys, pend, pend_keys, best = tuple(place[lo]), [], [], [], [], None
                r = role[lo:hi]
                if (r == 0).any():
                    stored.append(x[lo:hi][r == 0])
                    stored_keys.append(keys[lo:hi][r == 0])
                if (r == 1).any():
                    pend.append(x[lo:hi][r == 1])
                    pend_keys.append(keys[lo:hi][r == 1])
                    if sum(map(len, pend_keys)) >= 4 * BLOCK:
                        pairs(np.concatenate(pend_keys), np.concatenate(pend), False)
                        pend, pend_keys = [], []
            if out:
                yield flushed()
        close()
        if out:
            yield flushed()

    grouped = own.unionByName(asks).repartition("line", "block").sortWithinPartitions("line", "block", "role")
    found = ws.save(grouped.mapInArrow(compare, "a long, b long, s float").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s")))
    if found.count() > 4 * k * total:  # crowds: every block gave its own nearest; only the nearest of all are verified
        ends = found.select(F.col("a").alias("cls"), "s").unionByName(found.select(F.col("b").alias("cls"), "s"))
        ends = ends.withColumn("r", F.row_number().over(W.partitionBy("cls").orderBy(F.desc("s")))).where(F.col("r") <= k + 1)
        kth = ws.save(ends.groupBy("cls").agg(F.when(F.count("*") > k, F.min("s") - 2 * HALF).otherwise(-2.0).alias("t")))
        found = found.join(kth.select(F.col("cls").alias("a"), F.col("t").alias("ta")), "a").join(kth.select(F.col("cls").alias("b"), F.col("t").alias("tb")), "b").where("s >= least(ta, tb)").select("a", "b")
    # Exact cosines of the few pairs left.
    exact = found.join(reps.select(F.col("cls").alias("a"), F.col("v").alias("va")), "a").join(reps.select(F.col("cls").alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = ws.save(exact.select("a", "b", F.round(dot, 9).alias("cosine")).where(F.col("cosine") >= least))
    both = exact.select(F.col("a").alias("cls"), F.col("b").alias("to"), "cosine").unionByName(exact.select(F.col("b").alias("cls"), F.col("a").alias("to"), "cosine")).unionByName(reps.where("n > 1").select("cls", F.col("cls").alias("to"), F.lit(1.0).alias("cosine")))
    # Per class the k + 1 nearest classes by (cosine, smallest key): the class itself may be one of them.
    lowest = members.groupBy("cls").agg(F.min("key").alias("low"))
    near = both.join(lowest.select(F.col("cls").alias("to"), "low"), "to").withColumn("r", F.row_number().over(W.partitionBy("cls").orderBy(F.desc("cosine"), "low"))).where(F.col("r") <= k + 1)
    # Only the k + 1 smallest keys of a class can be answers.  row_number under a limit is cut before its shuffle.
    answers = members.withColumn("r", F.row_number().over(W.partitionBy("cls").orderBy("key"))).where(F.col("r") <= k + 1).select(F.col("cls").alias("to"), F.col("key").alias("other"))
    listed = near.select("cls", "to", "cosine").join(answers, "to")
    rows = members.select("cls", "key").join(listed, "cls").where("key <> other")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k)
    return ranked.select("key", "other", "cosine", "rank")


def pairs(linked: DataFrame) -> DataFrame:
    """(a_key, b_key): each linked pair once, the smaller key first."""
    return linked.select(F.least("key", "other").alias("a_key"), F.greatest("key", "other").alias("b_key")).distinct()
