"""Session plumbing: the path for Python workers and the folder that a cluster shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from ..errors import SetupError

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's path; a cluster without it ships the package."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *(p for p in paths if p)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset and
    everything runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise SetupError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strataport-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
