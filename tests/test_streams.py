"""Streams whose state grows, is rewritten in part, and ends."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from rulewright.operators import corpus, sessions
from rulewright.streaming.sessions import end_sessions, fold_sessions
from rulewright.streaming.upserts import CorpusSink

SIGHTINGS = "pmid long, ts long, event_id long, title string, props string, query string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def rows_of(df):
    return sorted(map(str, df.select(sorted(c for c in df.columns if c != "bucket")).collect()))


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    made = [(i, i, i, f"t{i}" if i % 3 else "", None, f"q{i % 4}") for i in range(200)]
    later = [(5, 500, 500, "new", "p", "q9"), (5, 501, 501, "newer", "", "q1"), (None, 1, 1, "x", "x", "x"), (900, 502, 502, None, None, None)]
    last = [(900, 600, 600, "named", None, "q")]
    sink = CorpusSink(spark, str(tmp_path), "pmid", "ts", "event_id", ["title", "props"], "query", buckets=16)
    frames = [spark.createDataFrame(r, SIGHTINGS) for r in (made, later, last)]
    fold = lambda df: corpus.fold_sightings(df, "pmid", "ts", "event_id", ["title", "props"], "query")
    for i, frame in enumerate(frames):
        sink(frame, i)
        whole = frames[0]
        for f in frames[1 : i + 1]:
            whole = whole.unionByName(f)
        assert rows_of(sink.version(i)) == rows_of(fold(whole))
        if i == 1:
            touched = {r[0] for r in later_buckets(spark, later)}
            assert {p.name for p in (tmp_path / "version=1").glob("bucket=*")} == {f"bucket={b}" for b in touched}
            sink(frame, i)  # the batch runs again
            assert rows_of(sink.version(i)) == rows_of(fold(whole))
            assert rows_of(sink.version(0)) == rows_of(fold(frames[0]))
    held = {(v, b) for b, v in sink.manifest(2).items()} | {(v, b) for b, v in sink.manifest(1).items()}
    there = {(int(p.parent.name[8:]), int(p.name[7:])) for p in tmp_path.glob("version=*/bucket=*")}
    assert there == held


def later_buckets(spark, rows):
    keys = spark.createDataFrame([(r[0],) for r in rows if r[0] is not None], "pmid long")
    return keys.select(F.pmod(F.xxhash64("pmid"), F.lit(16)).cast("int")).distinct().collect()


@pytest.fixture
def rocks(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(provider)


def run(df, tmp_path, mode):
    q = df.writeStream.format("parquet" if mode == "append" else "noop").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_sessions_end_by_event_time(spark, tmp_path, rocks):
    schema = "conv_id long, ts timestamp, turn long, role string, text string"
    first = [(1, at(0), 0, "user", "hello"), (1, at(5), 1, "assistant", "yes"), (2, at(1), 0, "system", "s"), (3, at(0), 0, "user", None)]
    second = [(2, at(20), 1, "user", "still here"), (9, at(25), 0, "user", "clock")]
    third = [(2, at(50), 2, "assistant", "on"), (1, at(60), 2, "user", "back")]
    fourth = [(9, at(300), 1, "user", "clock"), (3, at(299), 5, "user", "again")]
    outs = []
    for i, rows in enumerate((first, second, third, fourth)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(end_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "30 minutes"), tmp_path, "append")
        outs.append({(r["conv_id"], r["started"], r["ended"], r["n_rows"], r["n_user"], r["goal"], r["last_role"]) for r in spark.read.schema(end_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).schema).parquet(str(tmp_path / "out")).collect()})
    assert outs[0] == outs[1] == set()
    assert outs[2] == {(1, at(0), at(5), 2, 1, "hello", "assistant"), (3, at(0), at(0), 1, 1, None, "user"), (9, at(25), at(25), 1, 1, "clock", "user")}, "conversation 2 goes on"
    whole = spark.createDataFrame(first + second + third + fourth, schema)
    twin = {(r["conv_id"], r["started"], r["ended"], r["n_rows"], r["n_user"], r["goal"], r["last_role"]) for r in sessions.gap_sessions(whole, "conv_id", "ts", "turn", "role", "text", "30 minutes").collect()}
    still_open = {s for s in twin if s[2] >= at(299)}
    assert outs[-1] == twin - still_open
    assert len(still_open) == 2


def test_silent_state_is_forgotten_after_its_time(spark, tmp_path, rocks):
    schema = "conv_id long, turn long, role string, text string"
    seen = []

    def add(batch, batch_id):
        seen.extend((r["conv_id"], r["n_rows"]) for r in batch.collect())

    def send(rows, upto):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(120):
            if len(seen) >= upto:
                return
            time.sleep(0.5)

    (tmp_path / "in").mkdir()
    stream = fold_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ttl_ms=3000)
    q = stream.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        send([(1, 0, "user", "a"), (1, 1, "user", "b")], 1)
        time.sleep(5)
        send([(1, 2, "user", "c")], 2)
    finally:
        q.stop()
    assert seen == [(1, 2), (1, 1)]
