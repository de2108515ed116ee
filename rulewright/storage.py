"""Materialised intermediate tables.

Iterative jobs cut their lineage by writing a Parquet table to the shared
folder that the cluster names in ``spark.checkpoint.dir``. Executors may be
lost at any time; a written table survives that, a local checkpoint does not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch that holds whole texts or shingle sets.
TEXT_ROWS = 1000


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session.

    Taken from ``spark.checkpoint.dir``. Where that is unset, a local session
    (tests) gets a temporary folder; any other session is an error, because its
    executors would not see a folder of the driver's machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="rulewright-"))
    return "file://" + _LOCAL_ROOT[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table; one that is not there is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Workspace:
    """A folder of named tables that one job writes and reads again."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """Write ``df`` and return the table read back, with the same columns.

        The table replaces the shuffle files of the job that made it, so Spark is
        told to delete those when the write ends; else they stay until the driver
        happens to collect its garbage. ``batch_rows`` bounds the Arrow batches
        that the job hands to Python, for rows that hold whole texts.
        """
        wanted = {_CLEANUP: "true"} | ({_BATCH_ROWS: str(batch_rows)} if batch_rows else {})
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            delete(self.spark, self.path(name))
