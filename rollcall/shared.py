"""Tables that several plans read, written once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a local session (tests) takes a folder that goes with it; a cluster has to name one."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="rollcall-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return context.getCheckpointDir().get()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: later plans begin there, with its columns and its size known."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table_{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
