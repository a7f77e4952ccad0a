"""Tables written in the folder that all machines of a cluster share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without that setting, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            folder = set_before.get()
        elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfmark-"))
            folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str, make: bool = False) -> str:
    """A path of its own in the shared folder, deleted when the application ends; make: as an empty folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop)
    if make:
        files.mkdirs(hadoop)
    return path


#: The tables of each open block of temporary_tables, the innermost last.
_open: ContextVar[tuple[list, ...]] = ContextVar("open", default=())


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for lasting ones: those belong to the block around this one, if any."""
    own: list = []
    token = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(token)
        for files, path in own:
            files.delete(path, True)


def staged(df: DataFrame, name: str = "stage", lasting: bool = False) -> DataFrame:
    """The rows of df, computed once and read back from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    blocks = _open.get()[:-1] if lasting else _open.get()
    if blocks:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        blocks[-1].append((hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
