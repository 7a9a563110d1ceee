"""rollcall: a PySpark-native engine for credit rolls and careers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import the package from where it lies, whatever the working folder.

    On a cluster ship it with ``--py-files`` or install it; a path that a machine
    lacks does no harm. Numeric libraries get one thread a worker, as a task has one core.
    """
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    env.setdefault("OMP_NUM_THREADS", "1")
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])
