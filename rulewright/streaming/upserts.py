"""Streams that keep the keyed corpus up to date, and drop repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulewright.operators.corpus import fold_sightings, merge_folds
from rulewright.storage import delete, exists


class CorpusSink:
    """Folds every micro-batch into the stored corpus, of which it rewrites the touched buckets only.

    A key lies in one of ``buckets`` hash buckets. Batch b writes the merged rows of
    the buckets that it touches under ``version=b/bucket=..``, and then a manifest of
    b: for each bucket, the version that holds it. Readers go by a manifest, so a
    batch is seen whole or not at all; one that runs again after a failure starts
    from the manifest before it and overwrites its own files. What neither of the two
    latest manifests names is deleted. What a batch writes follows its keys as long
    as they are fewer than the buckets, so their number should grow with the corpus; it is fixed for a path.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, ts: str, tie: str, fill: list[str], query: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.fields = {"ts": ts, "tie": tie, "fill": fill, "query": query}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, batch_id: int) -> dict[int, int]:
        """Version of each bucket that has rows, as of a batch: at most ``buckets`` entries. Before the first batch there are none."""
        where = f"{self.path}/manifest/batch={batch_id}"
        if batch_id < 0 or not exists(self.spark, f"{where}/_SUCCESS"):
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").json(where).collect()}

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/version={version}/bucket={bucket}"

    def version(self, batch_id: int) -> DataFrame:
        """The corpus as of a batch."""
        return self._read([self._folder(b, v) for b, v in self.manifest(batch_id).items()])

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*folders)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            fold = fold_sightings(batch, self.key, **self.fields)
            before = self.manifest(batch_id - 1)
            touched = [r[0] for r in batch.where(F.col(self.key).isNotNull()).select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
            old = [self._folder(b, before[b]) for b in touched if b in before]
            if old:
                fold = merge_folds(self._read(old), fold, self.key, self.fields["fill"])
            rows = fold.withColumn("bucket", self._bucket()).repartition("bucket")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={batch_id}")
            after = before | dict.fromkeys(touched, batch_id)
            self.spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/batch={batch_id}")
        finally:
            batch.unpersist()
        self._clean(batch_id)

    def _clean(self, batch_id: int) -> None:
        """Delete the buckets that the last but one manifest has superseded, and the manifest before it."""
        older, newer = self.manifest(batch_id - 2), self.manifest(batch_id - 1)
        for bucket, version in older.items():
            if newer.get(bucket, version) != version:
                delete(self.spark, self._folder(bucket, version))
        if older:
            delete(self.spark, f"{self.path}/manifest/batch={batch_id - 2}")


def run_upserts(stream: DataFrame, sink: CorpusSink, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_repeats(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each id once within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
