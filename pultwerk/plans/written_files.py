"""Files of given names for the queries that read files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from pultwerk.session import shared_dir
from pultwerk.sources import folders


def new_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


def write_named(rows: DataFrame) -> str:
    """rows(n, path, value[, modified]) → a folder with one text file per row.

    On a file system that every machine mounts, tasks write the files under their names. On
    any other Spark writes them and the driver gives them their names and times.
    """
    spark = rows.sparkSession
    folder = new_folder(spark)
    local = folders.local_path(spark, folder)
    if local is None:
        _write_and_move(rows, folder)
    else:
        _write_in_tasks(rows, local)
    return folder


def _write_in_tasks(rows: DataFrame, folder: str) -> None:
    """A task that runs again writes the same files; one name for two rows is an error."""
    def write(part: Iterator[Row]) -> None:
        before = None
        for row in part:
            if row["path"] is None or row["path"] == before:
                raise ValueError(f"no name of its own for a file: {row['path']}")
            before, target = row["path"], os.path.join(folder, row["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8", newline="") as file:
                file.write(f"{'' if row['value'] is None else row['value']}\n")
            if "modified" in row:
                os.utime(target, (row["modified"], row["modified"]))

    os.makedirs(folder, exist_ok=True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "path").sortWithinPartitions("path").foreachPartition(write)


def _write_and_move(rows: DataFrame, folder: str) -> None:
    spark = rows.sparkSession
    made = new_folder(spark)
    rows.select("n", "value").write.partitionBy("n").text(made)
    timed = "modified" in rows.columns
    for row in rows.drop("value").toLocalIterator():
        here = f"{made}/n={row['n']}"
        part = next(name for name in folders.names(spark, here) if name.startswith("part-"))
        folders.move(spark, f"{here}/{part}", f"{folder}/{row['path']}")
        if timed:
            folders.set_time(spark, f"{folder}/{row['path']}", row["modified"])
