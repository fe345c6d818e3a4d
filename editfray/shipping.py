"""Make this package importable by Spark's Python workers, wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once a context. A few hundred kB."""
    context = spark.sparkContext
    if getattr(context, "_editfray_shipped", False):
        return
    package = Path(__file__).resolve().parent
    stage = Path(tempfile.mkdtemp(prefix="editfray-"))
    shutil.copytree(package, stage / "editfray", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(stage / "editfray_package"), "zip", stage, "editfray"))
    context._editfray_shipped = True
