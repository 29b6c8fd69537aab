"""Sends the package to Python workers whose path does not hold it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(), "docketry.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "docketry")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
