"""Conversation state in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import sessions
from rulewright.plans.registry import query, table
from rulewright.storage import Workspace
from rulewright.streaming.sessions import fold_sessions
from rulewright.streaming.upserts import drop_repeats


@query("SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE m IS NULL OR turn > m")
def session_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.tail_after_last(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "role")


@query("""WITH i AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
    SELECT conv_id, turn, least(row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - CASE WHEN island > 0 THEN 1 ELSE 0 END, 6)::INT AS iteration FROM i""")  # fmt: skip
def turn_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.turn_counter(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", 6).select("conv_id", "turn", "iteration")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last_len FROM conversations")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    length = F.when(F.col("role") == "user", F.length("text").cast("long"))
    return sessions.carry_forward(c, "conv_id", "turn", length, "last_len").select("conv_id", "turn", "last_len")


@query("""SELECT conv_id, arg_min(substr(text, 1, 200), turn) FILTER (role = 'user') AS goal, arg_max(text, turn) FILTER (role = 'user') AS latest_user,
    arg_max(text, turn) FILTER (role = 'assistant' AND text <> '') AS latest_answer, count(*) AS n_rows, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id""")  # fmt: skip
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.summary(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS position FROM conversations) WHERE position > 2")
def actions_after_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.after_offset(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 2).select("conv_id", "turn", "position")


@query("SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id)::INT AS rank FROM events) WHERE rank <= 3")
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.keep_best(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", 3).select("user_id", "event_id", "rank")


def _memory(stream: DataFrame, mode: str, ws: Workspace, name: str) -> None:
    """Run a stream over what is there, appending every batch's rows to a table."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{ws.path(name)}/b={batch_id}")

    q = stream.writeStream.foreachBatch(add).outputMode(mode).option("checkpointLocation", ws.path(f"{name}-ck")).trigger(availableNow=True).start()
    q.awaitTermination()


@query("""WITH i AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS m FROM conversations)
    SELECT conv_id, count(*) AS n_rows, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (m IS NULL OR turn > m) AS iteration, arg_min(substr(text, 1, 200), turn) FILTER (role = 'user') AS goal, arg_max(role, turn) AS last_role FROM i GROUP BY conv_id""")  # fmt: skip
def session_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rows of a stream in two steps of turns; the last row of a conversation has the most rows."""
    ws = Workspace(spark, "session-stream")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # One run for each step on the same checkpoint: all early turns come in one batch, whatever their files.
        for step in ("turn < 2", "turn >= 2"):
            c.where(step).write.mode("append").parquet(ws.path("in"))
            _memory(fold_sessions(spark.readStream.schema(c.schema).parquet(ws.path("in"))), "update", ws, "out")
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    states = spark.read.parquet(ws.path("out"))
    return states.groupBy("conv_id").agg(F.max_by(F.struct("n_rows", "n_user", "iteration", "goal", "last_role"), "n_rows").alias("s")).select("conv_id", "s.*")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event sent twice; each comes out once."""
    ws = Workspace(spark, "dedup-stream")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.unionByName(e).write.parquet(ws.path("in"))
    stream = spark.readStream.schema(e.schema).parquet(ws.path("in"))
    _memory(drop_repeats(stream, "event_id", "ts", "30 days"), "append", ws, "out")
    return spark.read.parquet(ws.path("out")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
