"""Makes this package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_folders: list[tempfile.TemporaryDirectory] = []
#: Arrow batches to and from Python workers: whole texts travel in them, so they are kept far smaller than the defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the workers, once for each application (they then need no install), and bounds Arrow batches."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory() as folder:
            shutil.copytree(root, f"{folder}/src/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
            # the archive's folder has to outlive this call: workers fetch it when they begin
            _folders.append(tempfile.TemporaryDirectory())
            spark.sparkContext.addPyFile(shutil.make_archive(f"{_folders[-1].name}/{root.name}", "zip", f"{folder}/src"))
        _shipped.add(app)
    for key, (usual, ours) in BATCHES.items():
        if spark.conf.get(key) == usual:  # a value that was chosen stays
            spark.conf.set(key, ours)
    return spark
