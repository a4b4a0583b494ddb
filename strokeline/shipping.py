"""Makes the package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Adds the package's modules to the Spark context as a zip file, once."""
    context = spark.sparkContext
    if getattr(context, "_strokeline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "strokeline.zip"))
    with zipfile.ZipFile(path, "w") as file:
        for module in sorted(root.rglob("*.py")):
            file.write(module, str(module.relative_to(root.parent)))
    context.addPyFile(path)
    context._strokeline_shipped = True
