"""Sends this package to the executors, as `--py-files` would."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python path, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    top = Path(__file__).resolve().parent
    held = tempfile.mkdtemp(prefix="seqsweep-code-")  # tasks fetch the file later, so it stays until the driver ends
    atexit.register(shutil.rmtree, held, ignore_errors=True)
    name = os.path.join(held, "seqsweep.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(name)
