"""Folders of any file system that Spark reads: names, moves and removals from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def local_path(spark: SparkSession, name: str) -> str | None:
    """The path as the operating system knows it; none on a file system of another kind."""
    files, path = _at(spark, name)
    return files.makeQualified(path).toUri().getPath() if files.getScheme() == "file" else None


def exists(spark: SparkSession, name: str) -> bool:
    files, path = _at(spark, name)
    return files.exists(path)


def names(spark: SparkSession, name: str) -> list[str]:
    """Names of what lies directly below a folder; none if it is not there."""
    files, path = _at(spark, name)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def move(spark: SparkSession, old: str, new: str) -> None:
    files, target = _at(spark, new)
    files.mkdirs(target.getParent())
    if not files.rename(_at(spark, old)[1], target):
        raise OSError(f"could not move {old}")


def remove(spark: SparkSession, name: str) -> None:
    files, path = _at(spark, name)
    files.delete(path, True)


def set_time(spark: SparkSession, name: str, seconds: int) -> None:
    files, path = _at(spark, name)
    files.setTimes(path, int(seconds) * 1000, -1)
