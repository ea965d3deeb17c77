"""Makes this package importable in Python workers of any cluster: it travels with the job."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the job once per application."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lodegraph-ship-")) / "lodegraph_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _DONE.add(app)
