"""The streaming jobs drained over the events table, each held against its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.registry import query
from tidewell.sources.shared import shared_folder
from tidewell.streaming import jobs


def folder(spark: SparkSession) -> str:
    """A new folder for a stream's state and output, shared by driver and executors."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if [f.rpartition("/")[2] for f in table.inputFiles()] == ["events.parquet"]:  # one file: a stream reads its folder
        e = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        e = reader.parquet(path)
    thread = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    return e.select(
        "event_id", thread.alias("thread_id"), F.concat(thread, F.lit("-"), F.col("ts").cast("date").cast("string")).alias("run_id"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("user_id"), "event_type", "value",
        F.when(F.col("event_type") == "error", "trace").otherwise("message").alias("category"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def newest(df: DataFrame, *keys: str) -> DataFrame:
    """Each key's row of the latest batch, by a grouped maximum that is combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__last")).select(*keys, "__last.*")


BASE = "WITH b AS (SELECT event_id, 't' || user_id AS thread_id, 't' || user_id || '-' || ts::DATE AS run_id, 'u' || user_id % 7 AS user_id, event_type, value, CASE WHEN event_type = 'error' THEN 'trace' ELSE 'message' END AS category, regexp_extract(props, '([0-9]+)', 1)::INT AS k, ts AS created_at FROM events)"


@query("s1_stream_events", BASE + " SELECT thread_id, event_id AS seq, left(repeat('x', k), CASE WHEN category = 'trace' THEN 50 ELSE 1000 END) AS content, CASE WHEN category = 'trace' AND k > 50 THEN k END AS original_byte_length FROM b")
def stream_events(spark, sf_dir):
    e = live_events(spark, sf_dir).withColumns({"seq": F.col("event_id"), "content": F.repeat(F.lit("x"), F.col("k"))})
    return jobs.drain(jobs.stream_events(e, 50), folder(spark)).select("thread_id", "seq", "content", "original_byte_length")


@query("s1_append_with_seq", BASE + " SELECT thread_id, event_id, row_number() OVER (PARTITION BY thread_id ORDER BY event_id) AS seq FROM b")
def append_with_seq(spark, sf_dir):
    e = live_events(spark, sf_dir).select("thread_id", "event_id", F.col("event_id").alias("pos"), F.lit(0).alias("seq"))
    return jobs.drain(jobs.stream_numbered(e), folder(spark)).select("thread_id", "event_id", "seq")


def live_responses(spark, sf_dir):
    return live_events(spark, sf_dir).select("thread_id", "run_id", F.col("event_id").cast("string").alias("call_id"), F.when(F.col("k") % 4 != 3, F.concat(F.lit("m"), (F.col("k") % 3).cast("string"))).alias("model_name"), F.floor("value").cast("long").alias("total_tokens"), "created_at")


RESPONSES = BASE + ", r AS (SELECT thread_id, run_id, CASE WHEN k % 4 <> 3 THEN 'm' || k % 3 END AS model_name, floor(value)::BIGINT AS total_tokens, created_at FROM b)"


@query("s2_stream_token_usage", RESPONSES + " SELECT thread_id, coalesce(model_name, 'unknown') AS model, sum(total_tokens)::BIGINT AS tokens, count(*) AS calls FROM r WHERE total_tokens > 0 GROUP BY 1, 2")
def stream_token_usage(spark, sf_dir):
    r = live_responses(spark, sf_dir)
    return newest(jobs.drain(jobs.stream_token_usage(r.unionByName(r)), folder(spark), "update"), "thread_id", "model")


@query("s3_stream_progress", RESPONSES + " SELECT run_id, time_bucket(INTERVAL 5 SECOND, created_at) AS start, max_by(total_tokens, created_at) AS total_tokens FROM r GROUP BY 1, 2")
def stream_progress(spark, sf_dir):
    return newest(jobs.drain(jobs.stream_progress(live_responses(spark, sf_dir)), folder(spark), "update"), "run_id", "start")


@query(
    "s4_stream_memory_debounce",
    BASE
    + """, a AS (SELECT *, CASE WHEN k % 3 > 0 THEN 'agent' || k % 2 ELSE '' END AS agent FROM b), g AS (SELECT *, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY thread_id, user_id, agent ORDER BY created_at)), i AS (SELECT *, sum(new) OVER (PARTITION BY thread_id, user_id, agent ORDER BY created_at) AS island FROM g)
SELECT thread_id, user_id, agent, min(created_at) AS start, max_by(event_id::VARCHAR, created_at) AS transcript, bool_or(k % 9 = 0) AS correction, bool_or(k % 7 = 0) AS reinforcement, count(*) AS updates FROM i GROUP BY thread_id, user_id, agent, island
HAVING max(created_at) + INTERVAL 7200 SECOND <= (SELECT date_trunc('millisecond', max(created_at)) FROM b) - INTERVAL 7200 SECOND""",
)
def stream_memory_debounce(spark, sf_dir):
    agent = F.when(F.col("k") % 3 > 0, F.concat(F.lit("agent"), (F.col("k") % 2).cast("string")))
    u = live_events(spark, sf_dir).select("thread_id", "user_id", agent.alias("agent"), F.col("event_id").cast("string").alias("content"), (F.col("k") % 9 == 0).alias("correction"), (F.col("k") % 7 == 0).alias("reinforcement"), "created_at")
    return jobs.drain(jobs.stream_memory_debounce(u, "7200 seconds"), folder(spark)).drop("batch_id")


@query(
    "s5_stream_loop_guard",
    BASE
    + """, c AS (SELECT thread_id, event_id AS turn, event_type || k % 7 AS hash, event_type AS name, row_number() OVER (PARTITION BY thread_id, event_type ORDER BY event_id) AS f, list(event_type || k % 7) OVER (PARTITION BY thread_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS now,
list(event_type || k % 7) OVER (PARTITION BY thread_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS before FROM b), d AS (SELECT *, len(list_filter(now, lambda x: x = hash)) AS n, coalesce(len(list_filter(before, lambda x: x = hash)), 0) AS m FROM c)
SELECT thread_id, turn, hash, name, CASE WHEN n >= 5 THEN 'hard' WHEN n >= 3 AND m < 3 THEN 'warn' ELSE 'ok' END AS call_state, CASE WHEN f >= 50 THEN 'hard' WHEN f = 30 THEN 'warn' ELSE 'ok' END AS tool_state FROM d""",
)
def stream_loop_guard(spark, sf_dir):
    c = live_events(spark, sf_dir).select("thread_id", F.col("event_id").alias("turn"), F.col("event_type").alias("name"), F.concat("event_type", (F.col("k") % 7).cast("string")).alias("hash"), "created_at")
    return jobs.drain(jobs.stream_loop_guard(c), folder(spark)).drop("batch_id")


@query(
    "s6_stream_budget_guard",
    BASE
    + """, u AS (SELECT run_id, thread_id || k % 3 AS message_id, floor(value)::BIGINT AS total_tokens, event_id AS pos FROM b), g AS (SELECT *, greatest(total_tokens - coalesce(lag(total_tokens) OVER (PARTITION BY run_id, message_id ORDER BY pos), 0), 0) AS growth FROM u),
r AS (SELECT *, sum(growth) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM g) SELECT run_id, message_id, pos, used, CASE WHEN used >= 400 THEN 'hard' WHEN used >= 0.8 * 400 AND used - growth < 0.8 * 400 THEN 'warn' ELSE 'ok' END AS state FROM r""",
)
def stream_budget_guard(spark, sf_dir):
    u = live_events(spark, sf_dir).select("run_id", F.concat("thread_id", (F.col("k") % 3).cast("string")).alias("message_id"), F.floor("value").cast("long").alias("total_tokens"), F.col("event_id").alias("pos"), "created_at")
    return jobs.drain(jobs.stream_budget_guard(u, 400), folder(spark)).drop("batch_id")
