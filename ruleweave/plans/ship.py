"""This package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session; Spark serves the archive from the driver."""
    context = spark.sparkContext
    if getattr(context, "_ruleweave_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="ruleweave-package-")
    shutil.copytree(package, os.path.join(folder, "in", "ruleweave"), ignore=shutil.ignore_patterns("__pycache__", "llm"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "ruleweave_package"), "zip", os.path.join(folder, "in")))
    context._ruleweave_shipped = True
