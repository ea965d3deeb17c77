"""Vectors as arrays."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is null, empty, zero or of another length."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def decode(packed: Column) -> Column:
    """Packed little-endian floats, or JSON text of older stores; null for what is neither."""

    def one(b: bytes | None) -> list[float] | None:
        if b is None:
            return None
        if b[:1] == b"[" and b[-1:] == b"]":  # packed floats may begin alike, but then are no JSON
            try:
                return [float(x) for x in json.loads(bytes(b))]
            except (ValueError, TypeError):
                pass
        return np.frombuffer(b, "<f4").tolist() if len(b) % 4 == 0 else None

    def run(col: pd.Series) -> pd.Series:
        return col.map(one)

    return F.pandas_udf("array<float>")(run)(packed)


def encode(v: Column) -> Column:
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf("binary")(run)(v)
