"""Where intermediate tables go: the folder the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode without one, a fresh folder."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="plumbline-")
    return _local_folders[application]


def work_path(spark: SparkSession, name: str) -> str:
    """A path for a table this application writes for itself and may overwrite."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}"
