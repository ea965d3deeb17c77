"""Capture of sessions as streams: offsets, replay-proof facts, suppression, incremental indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_key, is_automation, sentences


def offsets(pieces: DataFrame, marks: DataFrame, least: int = 80) -> DataFrame:
    """Batch form of the offset watermark: (session, total, from_char, new_chars, mine).

    pieces: (session, seq, text, stale); every piece counts towards the offset, stale ones too.  A mark beyond the total starts over.
    A session is mined if it has at least `least` new characters and no automation mark.
    """
    t = pieces.groupBy("session").agg(F.sum(F.length("text")).alias("total"), F.max(is_automation(F.col("text"))).alias("auto"))
    j = t.join(marks, "session", "left").withColumn("from_char", F.when(F.coalesce("chars", F.lit(0)) > F.col("total"), 0).otherwise(F.coalesce("chars", F.lit(0))))
    return j.select("session", "total", "from_char", (F.col("total") - F.col("from_char")).alias("new_chars"), ((F.col("total") - F.col("from_char") >= least) & ~F.col("auto")).alias("mine"))


STATE = "chars long, ts double"
OUT = "session string, from_char long, to_char long, text string"


def watermarked(stream: DataFrame, least: int = 80) -> DataFrame:
    """Streaming form: new text of a session past its stored offset, once `least` characters are waiting; state ends after 45 idle days."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, waiting = state.get if state.exists else (0, "")
        for b in batches:
            for text, stale in zip(b.sort_values("seq")["text"], b.sort_values("seq")["stale"]):
                done += len(text)
                waiting += "" if stale else text
        if len(waiting) >= least:
            yield pd.DataFrame({"session": [key[0]], "from_char": [done - len(waiting)], "to_char": [done], "text": [waiting]})
            waiting = ""
        state.update((done, waiting))
        state.setTimeoutDuration(45 * 86_400_000)

    return stream.groupBy("session").applyInPandasWithState(step, OUT, "chars long, waiting string", "append", "ProcessingTimeTimeout")


def facts(stream: DataFrame, text: str = "text") -> DataFrame:
    """Sentences of a stream, each identity once."""
    return stream.select(F.explode(sentences(F.col(text))).alias("fact")).withColumn("k", fact_key(F.col("fact"))).dropDuplicates(["k"])


def suppressed(pushes: DataFrame, hours: float = 6.0) -> DataFrame:
    """Batch form of push suppression: pushes (recipient, text, ts) without those that repeat one sent less than `hours` before.

    Only sent pushes start a new silence.  A key's times pass a task in order as a stream, of which one number is
    remembered, so a key of any length needs no memory; repeated times count once, nulls take no part.
    """
    gap = hours * 3600

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sent = None, 0.0
        for b in batches:
            keep = []
            for i, (r, t, ts) in enumerate(zip(*(b.column(c).to_pylist() for c in ("recipient", "text", "ts")))):
                if (r, t) != key or ts - sent >= gap:
                    key, sent = (r, t), ts
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    x = pushes.select(F.col("recipient").cast("string").alias("recipient"), F.col("text").cast("string").alias("text"), F.col("ts").cast("double").alias("ts")).dropna().distinct()
    return x.repartition("recipient", "text").sortWithinPartitions("recipient", "text", "ts").mapInArrow(run, "recipient string, text string, ts double")


def is_quiet(ts, start: int = 23, end: int = 7):
    h = F.hour(F.timestamp_seconds(ts))
    return (h >= start) | (h < end)


def held(pushes: DataFrame) -> DataFrame:
    """(recipient, n, message): pushes of quiet hours as one message per recipient, distinct texts in order of time."""
    q = pushes.where(is_quiet(F.col("ts"))).groupBy("recipient", "text").agg(F.min("ts").alias("ts"))
    return q.groupBy("recipient").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "text"))), lambda s: s["text"]), "\n").alias("message"))


def windows(df: DataFrame, text: str, size: int = 15_000) -> DataFrame:
    """Texts in consecutive windows of `size` characters: the row's other columns, window_no and piece."""
    n = F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)
    keep = [c for c in df.columns if c != text]
    return df.where(F.length(text) > 0).select(*keep, text, F.explode(F.sequence(F.lit(0), n)).alias("window_no")).select(*keep, "window_no", F.substring(F.col(text), F.col("window_no") * size + 1, F.lit(size)).alias("piece"))


def batch_sink(out: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the number of a batch with its rows: below `out` every batch has a folder of its own, so one that is applied again, after a restart too, replaces its rows and adds none."""

    def run(df: DataFrame, batch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")

    return run


def each_batch(apply: Callable[[DataFrame, int], None], done: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for effects that can't be replaced: a mark in the folder `done`, which all drivers share, is set only after success.  A batch with a mark is never applied again, whoever restarts; one that failed is tried again."""

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{done.rstrip('/')}/{batch}")
        fs = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(mark):
            apply(df, batch)
            fs.create(mark, True).close()

    return run
