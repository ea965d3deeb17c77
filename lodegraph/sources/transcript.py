"""Session transcripts as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HARNESS


def user_pieces(rows: DataFrame, as_of: float, hours: float = 36.0, most: int = 20_000, line: str = "line") -> DataFrame:
    """Pieces a person typed, of rows with a JSON line (other columns are kept): piece_no, ts, text, stale.

    Entries that aren't the user's, are meta or hold harness text are left out; content is a string or an array of blocks, read as a VARIANT.
    stale: older than `hours` before `as_of`; entries without a time never are.  Bad lines are skipped.
    """
    keep = [c for c in rows.columns if c != line]
    v = rows.select(*keep, F.try_parse_json(line).alias("v")).where(F.col("v").isNotNull())
    v = v.where((F.try_variant_get("v", "$.type", "string") == "user") & ~F.coalesce(F.try_variant_get("v", "$.isMeta", "boolean"), F.lit(False)))
    kind = F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant"))
    as_text = F.array(F.struct(F.lit("text").alias("type"), F.try_variant_get("v", "$.message.content", "string").alias("text")))
    as_blocks = F.try_variant_get("v", "$.message.content", "array<struct<type:string,text:string>>")
    blocks = F.when(kind == "STRING", as_text).when(kind.startswith("ARRAY"), as_blocks)
    raw = F.try_variant_get("v", "$.timestamp", "string")
    ts = F.unix_micros(F.try_to_timestamp(raw)) / 1e6
    x = v.select(*keep, ts.alias("ts"), F.posexplode(blocks).alias("piece_no", "b")).where("b.type = 'text'")
    text = F.regexp_replace(F.coalesce("b.text", F.lit("")), r"^\s+|\s+$", "")
    x = x.select(*keep, "piece_no", "ts", text.alias("text")).where("text <> ''")
    for h in HARNESS:
        x = x.where(~F.col("text").startswith(h))
    return x.withColumn("text", F.substring("text", 1, most)).withColumn("stale", F.coalesce(F.col("ts") < F.lit(as_of - hours * 3600), F.lit(False)))
