"""State of a stream by key, in buckets, for jobs that run as parallel batches.

A batch reads and writes only the buckets its own keys lie in. Each write of a bucket is a
snapshot of the whole bucket under the batch's number, so a bucket is read from one folder
however many batches there were, and a batch that runs again reads what lay there before
it and writes the same once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.sources import folders


@dataclass(frozen=True)
class KeyedState:
    """A row per key below ``path``; ``schema`` begins with the key."""

    path: str
    key: str
    schema: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of some rows: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _newest(self, spark: SparkSession, bucket: int, before: int | None) -> str | None:
        folder = f"{self.path}/bucket={bucket}"
        batches = [int(n.removeprefix("batch=")) for n in folders.names(spark, folder) if n.startswith("batch=")]
        fit = [b for b in batches if before is None or b < before]
        return f"{folder}/batch={max(fit)}" if fit else None

    def read(self, spark: SparkSession, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of some buckets (all, if none are named) as they were before a batch."""
        wanted = range(self.buckets) if buckets is None else buckets
        found = [p for p in (self._newest(spark, b, before) for b in wanted) if p]
        return spark.read.schema(self.schema).parquet(*found) if found else spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, buckets: list[int], batch_id: int) -> None:
        """Snapshots of the named buckets; the one before is kept for a batch that runs again."""
        spark = rows.sparkSession
        staged = f"{self.path}/_staged"
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(staged)
        for bucket in buckets:
            new, here = f"{staged}/bucket={bucket}", f"{self.path}/bucket={bucket}"
            if not folders.exists(spark, new):
                continue
            if folders.exists(spark, f"{here}/batch={batch_id}"):
                folders.remove(spark, f"{here}/batch={batch_id}")
            folders.move(spark, new, f"{here}/batch={batch_id}")
            older = sorted(int(n.removeprefix("batch=")) for n in folders.names(spark, here) if n.startswith("batch="))
            for batch in older[:-2]:
                folders.remove(spark, f"{here}/batch={batch}")
        folders.remove(spark, staged)
