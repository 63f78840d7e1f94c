"""Makes this package importable in Python workers, wherever the driver was started from."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestrata-")  # on the driver, which serves the archive to executors until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "lodestrata_sources.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
