"""JSON documents, HTML, snapshots: ways in and out of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_rows(df: DataFrame, vectors: bool = True, leave_out: tuple[str, ...] = ("path",)) -> DataFrame:
    """One JSON text per row; infinite numbers become null, as JSON has none."""
    cols = [c for c in df.columns if c not in leave_out and (vectors or c != "embedding")]
    clean = [F.when(~F.col(c).isin(float("inf"), float("-inf")) & ~F.isnan(c), F.col(c)).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in cols]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def import_rows(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON texts; Infinity is read."""
    return rows.select(F.from_json("json", schema, {"allowNonNumericNumbers": "true"}).alias("j")).select("j.*")


def html_text(html: Column) -> Column:
    """Visible text of a page, single-spaced: scripts, styles, comments and tags go, common entities are read."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def snapshot(df: DataFrame, root: str, version: str, keep: int = 5) -> str:
    """Write a version of a table below a folder and delete all but the newest `keep`; returns its path."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    found = sorted((s.getPath().getName() for s in fs.listStatus(base) if s.getPath().getName().startswith("v=")), reverse=True)
    for old in found[keep:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, old), True)
    return path


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest version."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base)]
    return spark.read.parquet(f"{root.rstrip('/')}/{max(n for n in names if n.startswith('v='))}")
