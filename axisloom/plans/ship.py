"""The package's own code for Python workers, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """Hand the package to the workers once for each Spark context, as --py-files does; Spark gives it to new executors too."""
    context = spark.sparkContext
    if getattr(context, "_axisloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    if root.parent.is_dir():
        archive = f"{tempfile.mkdtemp(prefix='axisloom-')}/axisloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(archive)
    context._axisloom_shipped = True
