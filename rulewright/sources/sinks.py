"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str) -> None:
    """JSON records partitioned by dataset and split."""
    df.repartition("dataset", "split").write.mode("overwrite").partitionBy("dataset", "split").json(path)


def write_csv(df: DataFrame, path: str, places: int = 4, run: str | None = None) -> str:
    """CSV with a header, floats rounded, nulls empty; returns the folder, stamped with the run if one is named.

    Files begin with the byte-order mark that spreadsheets look for. Spark has no
    option for it, so the first column's name begins with it; readers that are given a schema do not see the name.
    """
    rounded = [F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    to = path if run is None else f"{path.rstrip('/')}_{run}"
    df.select(*rounded).withColumnRenamed(df.columns[0], f"\ufeff{df.columns[0]}").write.mode("overwrite").csv(to, header=True, nullValue="")
    return to


def write_entity_files(df: DataFrame, path: str, rows: int) -> None:
    """``(run, id, fields map<string,string>)`` as files of one JSON object ``{id: fields}`` each, of about ``rows`` entities; a later run sorts behind.

    The number of files follows that of the entities, so no file and no row outgrows a task. Ids must be unique in a run.
    """
    parts = max(1, -(-df.count() // rows))
    name = F.format_string("F_%02d_%06d", "run", F.pmod(F.xxhash64("id"), F.lit(parts)))
    files = df.groupBy(name.alias("name")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "fields")))).alias("value"))
    files.repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def append_run(df: DataFrame, path: str, run_ts: str) -> None:
    """Add the result of a run as a partition; earlier runs stay."""
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs.join(F.broadcast(runs.agg(F.max("run_ts").alias("run_ts"))), "run_ts")


def only_new(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not yet written."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def rewrite_path(path: Column, moves: dict[str, str]) -> Column:
    """Path parts replaced, in order."""
    for old, new in moves.items():
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
