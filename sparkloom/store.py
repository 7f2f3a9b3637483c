"""Tables and small files in the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's; where both are unset, in local mode only, one of this process."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="tables-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return f"file://{shared_dir.own}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join by sort and merge: parsed or decoded rows are far more than Spark's estimate from a file's size, so it could send them to the driver for a broadcast."""
    return df.hint("merge")


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system that Spark knows; None if there is none."""
    jvm, fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file: written beside it, then renamed."""
    jvm, fs, p = _file(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, p):  # some file systems don't rename onto a file
        fs.delete(p, False)
        fs.rename(part, p)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    _, fs, p = _file(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    _, fs, p = _file(spark, path)
    fs.delete(p, True)
