"""Gets the package to executors that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once, unless the workers find it on their path."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top in on_path or context.applicationId in _SHIPPED:
        return
    made = os.path.join(tempfile.mkdtemp(prefix="turnloom-"), "turnloom.zip")
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, files in os.walk(os.path.join(top, "turnloom")):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, top))
    context.addPyFile(made)
    _SHIPPED.add(context.applicationId)
