"""What the corpus operators share: reading tables, checkpoints, words as bytes."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import on_workers

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else, unlike ``F.lower``."""
    return F.translate(col, UPPER, UPPER.lower())


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, by its full path.

    Where that setting is absent a local session (tests) takes a temporary folder; a cluster has to name one.
    """
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="rollcall-"))
    return jsc.getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which later plans read by column; it stays there until the folder is cleared."""
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/rollcall_{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: list[str] = []


def stage_begins(spark: SparkSession) -> None:
    """Removes tables that earlier stages of a pipeline wrote: what they returned has been written and read again since."""
    while _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a table that :func:`written` gave and no later plan reads."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names that none of the columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpointed(df: DataFrame, thin: bool = False) -> DataFrame:
    """Cut the lineage in the shared folder.

    ``thin`` tables (a few numbers for a document or less) take an eighth of the
    shuffle's partitions, which are sized for texts: fewer, larger files.
    """
    spark = df.sparkSession
    scratch(spark)
    if thin:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches near 8 MB, so that very long texts don't meet in one; workers find the package."""
    on_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` touches ASCII letters only and ``bytes.split`` splits on
    exactly these six bytes, so both work on whole texts at C speed.
    """
    return (text or "").encode("utf-8", "replace").lower().split()
