"""The package on the executors: Spark's file server hands them a zip of it, so nothing has to be installed there."""

from __future__ import annotations

import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Once for each Spark application."""
    context = spark.sparkContext
    if _shipped.setdefault(context.applicationId, False):
        return
    folder = Path(tempfile.mkdtemp(prefix="keystrata-"))  # the driver's own: executors fetch what Spark serves
    archive = folder / "keystrata.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f.relative_to(HERE.parent))
    context.addPyFile(str(archive))
    weakref.finalize(context, shutil.rmtree, folder, True)
    _shipped[context.applicationId] = True
