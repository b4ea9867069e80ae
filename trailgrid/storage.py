"""Tables in the folder that driver and executors share, and directories that take another's place as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is
    unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_folders.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_folders[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="trailgrid-")
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/trailgrid/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to a new Parquet table in the shared folder and reads it: the lineage is cut, and what is decided
    in it stays as it is if an executor is lost."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    files, target = _files(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder with what it holds; nothing happens if it is not there."""
    files, target = _files(spark, path)
    files.delete(target, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """``new`` takes the place of ``path`` by renaming; the old one is deleted once it has."""
    files, target = _files(spark, path)
    _, source = _files(spark, new)
    files.mkdirs(target.getParent())
    aside = None
    if files.exists(target):
        _, aside = _files(spark, f"{path}.old-{uuid.uuid4().hex}")
        files.rename(target, aside)
    if not files.rename(source, target):
        if aside is not None:
            files.rename(aside, target)
        raise OSError(f"{new} could not take the place of {path}")
    if aside is not None:
        files.delete(aside, True)
