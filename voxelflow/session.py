"""Makes the package importable on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package's source to every executor, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_voxelflow_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="voxelflow-"))
    archive = folder / "voxelflow_source.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, str(Path(PACKAGE.name) / path.relative_to(PACKAGE)))
    context.addPyFile(str(archive))
    context._voxelflow_shipped = True
