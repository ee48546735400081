"""Makes this package importable on executors that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    _done.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="codonflow-")) / "codonflow.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("codonflow") / f.relative_to(root))
    sc.addPyFile(str(path))
