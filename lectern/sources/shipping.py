"""Code for the executors: the package itself, where they cannot import it already."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers as a zip file, once a session, unless PYTHONPATH names its folder."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark, "_lectern_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="lectern-zip-")) / "lectern_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "lectern").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(out))
    spark._lectern_shipped = True
