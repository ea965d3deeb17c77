"""Parquet tables of a data folder, one file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Evaluation time of the test tables (2026-06-01 00:00 UTC), given with them.
AS_OF = 1780272000.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters reach the scan because nothing is cached or copied here."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
