"""Queries over run events, runs, feedback and threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import events as ops
from tidewell.plans.registry import query
from tidewell.plans.standins import frame, over

EVENTS = ("thread_id", "run_id", "event_type", "seq")


@query(
    "b4_list_events",
    over("run_events", "SELECT thread_id, run_id, event_type, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM run_events WHERE event_type IN ('view', 'click') AND k = 7 AND seq > 3) WHERE n <= 500"),
)
def list_events(spark, sf_dir):
    return ops.list_events(frame(spark, sf_dir, "run_events"), ["view", "click"], "k", "7", 3).select(*EVENTS)


@query("b5_waiting_runs", over("runs", "SELECT run_id, status, created_at FROM runs WHERE status IN ('pending', 'running') AND created_at <= TIMESTAMP '2024-01-20 00:00:00'"))
def waiting_runs(spark, sf_dir):
    import datetime as dt

    return ops.waiting_runs(frame(spark, sf_dir, "runs"), dt.datetime(2024, 1, 20), ("pending", "running")).select("run_id", "status", F.col("created_at"))


@query(
    "b6_search_threads",
    over("threads", "SELECT thread_id, status, updated_at FROM threads WHERE status = 'idle' AND json_type(metadata::JSON, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(metadata::JSON, '$.k') AS BIGINT) = 7 ORDER BY updated_at DESC, thread_id DESC LIMIT 100"),
)
def search_threads(spark, sf_dir):
    return ops.search_threads(frame(spark, sf_dir, "threads"), {"k": 7, "bad key": 1}, "idle").select("thread_id", "status", "updated_at")


@query("b6_latest_threads", over("threads", "SELECT thread_id, updated_at FROM threads ORDER BY updated_at DESC, thread_id DESC LIMIT 20 OFFSET 5"))
def latest_threads(spark, sf_dir):
    return ops.search_threads(frame(spark, sf_dir, "threads"), limit=20, offset=5).select("thread_id", "updated_at")


@query(
    "b7_thread_access",
    over("run_events threads", "WITH req AS (SELECT DISTINCT CASE WHEN seq % 5 = 0 THEN 'x' || thread_id ELSE thread_id END AS thread_id, 'u' || (seq % 7) AS user_id FROM run_events) SELECT req.thread_id, req.user_id, CASE WHEN t.thread_id IS NULL THEN true ELSE t.user_id IS NULL OR t.user_id = req.user_id END AS allowed FROM req LEFT JOIN threads t ON t.thread_id = req.thread_id"),
)
def thread_access(spark, sf_dir):
    e = frame(spark, sf_dir, "run_events")
    req = e.select(F.when(F.col("seq") % 5 == 0, F.concat(F.lit("x"), "thread_id")).otherwise(F.col("thread_id")).alias("thread_id"), F.concat(F.lit("u"), (F.col("seq") % 7).cast("string")).alias("user_id")).distinct()
    return ops.thread_access(req, frame(spark, sf_dir, "threads"))


@query("f2_assign_seq", over("run_events", "SELECT thread_id, event_id, CASE WHEN event_id % 2 = 1 THEN (SELECT coalesce(max(seq), 0) FROM run_events o WHERE o.thread_id = e.thread_id AND o.event_id % 2 = 0) + row_number() OVER (PARTITION BY thread_id ORDER BY event_id) END AS seq FROM run_events e WHERE event_id % 2 = 1"))
def assign_seq(spark, sf_dir):
    e = frame(spark, sf_dir, "run_events")
    new = e.where("event_id % 2 = 1").select("thread_id", F.col("event_id").alias("pos"))
    return ops.assign_seq(new, e.where("event_id % 2 = 0")).select("thread_id", F.col("pos").alias("event_id"), "seq")


@query("f7_run_message_page", over("run_events", "SELECT run_id, seq, total > 3 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS n, count(*) OVER (PARTITION BY run_id) AS total FROM run_events WHERE category = 'message') WHERE n <= 3"))
def run_message_page(spark, sf_dir):
    return ops.run_message_page(frame(spark, sf_dir, "run_events"), 3).select("run_id", "seq", "has_more")


@query("g4_message_page", over("run_events", "SELECT thread_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS n FROM run_events WHERE category = 'message' AND seq < 100) WHERE n <= 50"))
def message_page(spark, sf_dir):
    return ops.message_page(frame(spark, sf_dir, "run_events"), before=100).select("thread_id", "seq")


@query("e13_count_messages", over("run_events", "SELECT thread_id, count(*) AS n FROM run_events WHERE category = 'message' GROUP BY 1"))
def count_messages(spark, sf_dir):
    return ops.count_messages(frame(spark, sf_dir, "run_events"))


@query("d7_delete_events", over("run_events runs", "SELECT run_id, count(*) AS kept FROM run_events WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'error') GROUP BY 1"))
def delete_events(spark, sf_dir):
    kept, _ = ops.delete_events(frame(spark, sf_dir, "run_events"), frame(spark, sf_dir, "runs").where("status = 'error'"))
    return kept.groupBy("run_id").agg(F.count("*").alias("kept"))


@query("d7_deleted_counts", over("run_events runs", "SELECT run_id, count(*) AS removed FROM run_events WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'error') GROUP BY 1"))
def deleted_counts(spark, sf_dir):
    return ops.delete_events(frame(spark, sf_dir, "run_events"), frame(spark, sf_dir, "runs").where("status = 'error'"))[1]


COUNTED = """WITH c AS (SELECT *, coalesce(CASE WHEN total_tokens > 0 THEN total_tokens END, coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS total FROM responses),
r AS (SELECT run_id, call_id, caller, coalesce(model_name, 'unknown') AS model, input_tokens, output_tokens, total FROM (SELECT *, row_number() OVER (PARTITION BY run_id, call_id ORDER BY pos) AS n FROM c WHERE total > 0) WHERE n = 1)"""


@query(
    "e6_run_token_rollup",
    over(
        "responses",
        COUNTED
        + """, m AS (SELECT run_id, string_agg(model || '=' || t, ',' ORDER BY model) AS by_model FROM (SELECT run_id, model, sum(total)::BIGINT AS t FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT run_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total)::BIGINT AS total_tokens, count(*) AS calls, coalesce(sum(total) FILTER (caller = 'lead_agent'), 0)::BIGINT AS lead_agent_tokens,
coalesce(sum(total) FILTER (caller LIKE 'subagent:%'), 0)::BIGINT AS subagent_tokens, coalesce(sum(total) FILTER (caller LIKE 'middleware:%'), 0)::BIGINT AS middleware_tokens, any_value(by_model) AS by_model FROM r JOIN m USING (run_id) GROUP BY 1""",
    ),
)
def run_token_rollup(spark, sf_dir):
    r = ops.run_token_rollup(frame(spark, sf_dir, "responses"))
    pairs = F.transform(F.map_entries("by_model"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return r.withColumn("by_model", F.array_join(pairs, ","))


@query(
    "e7_external_usage",
    over("responses", "SELECT caller, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS records FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pos) AS n FROM responses WHERE total_tokens > 0 AND call_id <> '') WHERE n = 1 GROUP BY 1"),
)
def external_usage(spark, sf_dir):
    return ops.external_usage_rollup(frame(spark, sf_dir, "responses").withColumnRenamed("call_id", "source_run_id"))


@query(
    "e8_thread_token_usage",
    over("runs", "SELECT thread_id, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("total_input_tokens", "total_output_tokens", "total_tokens", "lead_agent_tokens", "subagent_tokens", "middleware_tokens")) + ", count(*) AS runs FROM runs WHERE status IN ('success', 'error', 'running') GROUP BY 1"),
)
def thread_token_usage(spark, sf_dir):
    return ops.thread_token_usage(frame(spark, sf_dir, "runs"), include_active=True)


@query(
    "e9_tokens_by_model",
    over(
        "runs",
        """WITH u AS (SELECT thread_id, m.model, CAST(json_extract(token_usage_by_model::JSON, '$.' || m.model || '.total_tokens') AS BIGINT) AS tokens FROM runs, (VALUES ('m0'), ('m1')) AS m(model) WHERE token_usage_by_model <> '{}'
UNION ALL SELECT thread_id, coalesce(nullif(trim(model_name), ''), 'unknown'), total_tokens FROM runs WHERE token_usage_by_model = '{}') SELECT thread_id, model, sum(tokens)::BIGINT AS tokens, count(*) AS runs FROM u GROUP BY 1, 2""",
    ),
)
def tokens_by_model(spark, sf_dir):
    return ops.tokens_by_model(frame(spark, sf_dir, "runs"))


CALLER = "CASE event_id % 4 WHEN 0 THEN 'lead_agent' WHEN 1 THEN 'subagent:a' WHEN 2 THEN NULL ELSE 'middleware:b' END"


@query("e12_run_message_summary", over("run_events", f"SELECT run_id, count(*) AS message_count, min_by(content, seq) FILTER (event_type <> 'click' AND caller = 'lead_agent') AS first_human, max_by(content, seq) FILTER (event_type = 'click' AND coalesce(caller, 'lead_agent') = 'lead_agent') AS last_ai FROM (SELECT *, {CALLER} AS caller FROM run_events) WHERE category = 'message' GROUP BY 1"))
def run_message_summary(spark, sf_dir):
    return ops.run_message_summary(frame(spark, sf_dir, "run_events").withColumns({"is_ai": F.col("event_type") == "click", "caller": F.expr(CALLER)}))


@query("e14_feedback_by_run", over("feedback", "SELECT run_id, count(*) AS total, count(*) FILTER (rating = 1) AS positive, count(*) FILTER (rating = -1) AS negative FROM feedback GROUP BY 1"))
def feedback_by_run(spark, sf_dir):
    return ops.feedback_by_run(frame(spark, sf_dir, "feedback"))


@query("e15_run_durations", over("runs", "SELECT run_id, (date_diff('microsecond', created_at, updated_at) // 1000000)::BIGINT AS seconds FROM runs"))
def run_durations(spark, sf_dir):
    return ops.run_durations(frame(spark, sf_dir, "runs"))


BUDGET = 4000


@query(
    "f5_token_budget",
    over(
        "responses",
        f"""WITH u AS (SELECT run_id, call_id AS message_id, coalesce(total_tokens, 0) AS total_tokens, pos FROM responses), g AS (SELECT *, greatest(total_tokens - coalesce(lag(total_tokens) OVER (PARTITION BY run_id, message_id ORDER BY pos), 0), 0) AS growth FROM u),
r AS (SELECT *, sum(growth) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM g)
SELECT run_id, message_id, pos, used, CASE WHEN used >= {BUDGET} THEN 'hard' WHEN used / {BUDGET} >= 0.8 AND (used - growth) / {BUDGET} < 0.8 THEN 'warn' ELSE 'ok' END AS state FROM r""",
    ),
)
def token_budget(spark, sf_dir):
    u = frame(spark, sf_dir, "responses").select("run_id", F.col("call_id").alias("message_id"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), "pos")
    return ops.token_budget(u, BUDGET).select("run_id", "message_id", "pos", "used", "state")


def _changes(runs):
    return runs.where("total_tokens % 3 = 0").withColumns({"status": F.lit("success"), "total_tokens": F.col("total_tokens") + 1, "model_name": F.lit("  new model "), "created_at": F.col("updated_at"), "pos": F.lit(1)})


@query(
    "i1_upsert_runs",
    over("runs", "SELECT run_id, created_at, CASE WHEN total_tokens % 3 = 0 THEN 'success' ELSE status END AS status, CASE WHEN total_tokens % 3 = 0 THEN total_tokens + 1 ELSE total_tokens END AS total_tokens, CASE WHEN total_tokens % 3 = 0 THEN 'new model' ELSE trim(model_name) END AS model_name FROM runs"),
)
def upsert_runs(spark, sf_dir):
    runs = frame(spark, sf_dir, "runs")
    return ops.upsert_runs(runs, _changes(runs)).select("run_id", "created_at", "status", "total_tokens", "model_name")


@query("i2_apply_progress", over("runs", "SELECT run_id, status, CASE WHEN status = 'running' AND total_input_tokens % 2 = 0 THEN total_tokens + 5 ELSE total_tokens END AS total_tokens FROM runs"))
def apply_progress(spark, sf_dir):
    runs = frame(spark, sf_dir, "runs")
    p = runs.select("run_id", F.when(F.col("total_input_tokens") % 2 == 0, F.col("total_tokens") + 5).alias("total_tokens"))
    return ops.apply_progress(runs, p, ["total_tokens"]).select("run_id", "status", "total_tokens")


@query("i2_apply_completion", over("runs", "SELECT run_id, CASE WHEN status = 'running' THEN 'success' ELSE status END AS status, CASE WHEN status = 'running' THEN 0 ELSE total_tokens END AS total_tokens, model_name FROM runs"))
def apply_completion(spark, sf_dir):
    runs = frame(spark, sf_dir, "runs")
    done = runs.where("status = 'running'").select("run_id", F.lit("success").alias("status"), F.lit(None).cast("long").alias("total_tokens"), F.lit(None).cast("string").alias("model_name"))
    return ops.apply_completion(runs, done, ["total_tokens"], ["model_name"]).select("run_id", "status", "total_tokens", "model_name")


@query(
    "d5_llm_latency",
    over(
        "responses",
        """WITH e AS (SELECT *, row_number() OVER (PARTITION BY run_id, call_id ORDER BY created_at + pos % 3 * INTERVAL 1 SECOND) AS n FROM responses)
SELECT run_id, call_id, n::INT AS n, CASE WHEN n = 1 AND caller <> 'lead_agent' THEN ((pos % 3) * 1000)::BIGINT END AS ms FROM e""",
    ),
)
def llm_latency(spark, sf_dir):
    r = frame(spark, sf_dir, "responses")
    starts = r.where("caller <> 'lead_agent'").select("run_id", "call_id", F.col("created_at").alias("started_at"))
    ends = r.select("run_id", "call_id", F.expr("created_at + make_dt_interval(0, 0, 0, pos % 3)").alias("ended_at"))
    return ops.llm_latency(starts, ends)


@query(
    "d8_merge_runs",
    over("runs", "SELECT run_id, thread_id, CASE WHEN status = 'running' THEN 'live' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, run_id DESC) AS n FROM runs) WHERE n <= 10"),
)
def merge_runs(spark, sf_dir):
    runs = frame(spark, sf_dir, "runs").select("run_id", "thread_id", "status", "created_at")
    return ops.merge_runs(runs.where("status = 'running'").withColumn("status", F.lit("live")), runs, 10).drop("created_at")


@query("g5_latest_runs", over("runs", "SELECT run_id, thread_id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, run_id DESC) AS n FROM runs) WHERE n <= 100"))
def latest_runs(spark, sf_dir):
    return ops.latest_runs(frame(spark, sf_dir, "runs")).select("run_id", "thread_id")


LATEST_FEEDBACK = "SELECT thread_id, run_id, user_id, rating, feedback_id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, run_id, user_id ORDER BY created_at DESC, feedback_id DESC) AS n FROM feedback WHERE rating IN (1, -1)) WHERE n = 1"


@query("i3_upsert_feedback", over("feedback", LATEST_FEEDBACK))
def upsert_feedback(spark, sf_dir):
    return ops.upsert_feedback(frame(spark, sf_dir, "feedback")).select("thread_id", "run_id", "user_id", "rating", "feedback_id")


@query("i4_feedback_map", over("feedback", f"WITH f AS ({LATEST_FEEDBACK}) SELECT thread_id, run_id, max_by(feedback_id, user_id) AS feedback_id FROM f GROUP BY 1, 2"))
def feedback_map(spark, sf_dir):
    return ops.upsert_feedback(frame(spark, sf_dir, "feedback")).groupBy("thread_id", "run_id").agg(F.max_by("feedback_id", "user_id").alias("feedback_id"))


@query("g6_feedback_list", over("feedback", "SELECT thread_id, feedback_id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at, feedback_id) AS n FROM feedback) WHERE n <= 100"))
def feedback_list(spark, sf_dir):
    return ops.feedback_list(frame(spark, sf_dir, "feedback")).select("thread_id", "feedback_id")


@query(
    "d2_messages_with_feedback",
    over(
        "run_events feedback runs",
        f"""WITH f AS ({LATEST_FEEDBACK}), m AS (SELECT *, event_type = 'click' AS is_ai FROM run_events WHERE category = 'message'), l AS (SELECT run_id, max(seq) AS seq FROM m WHERE is_ai GROUP BY 1)
SELECT m.thread_id, m.run_id, m.seq, CASE WHEN l.seq IS NOT NULL THEN f.rating END AS rating, CASE WHEN is_ai THEN (date_diff('microsecond', r.created_at, r.updated_at) // 1000000)::BIGINT END AS seconds
FROM m LEFT JOIN l ON l.run_id = m.run_id AND l.seq = m.seq LEFT JOIN runs r ON r.run_id = m.run_id LEFT JOIN f ON f.thread_id = m.thread_id AND f.run_id = m.run_id AND f.user_id = m.user_id""",
    ),
)
def messages_with_feedback(spark, sf_dir):
    e = frame(spark, sf_dir, "run_events").withColumn("is_ai", F.col("event_type") == "click")
    return ops.messages_with_feedback(e, ops.upsert_feedback(frame(spark, sf_dir, "feedback")), frame(spark, sf_dir, "runs"))


@query(
    "i5_merge_metadata_in_order",
    over("threads", """SELECT thread_id, '{"k":' || regexp_extract(metadata, '([0-9]+)', 1) || ',"n":3,"once":' || CASE WHEN thread_id LIKE '%1' THEN 'true' ELSE 'null' END || ',"what":"2"}' AS metadata FROM threads"""),
)
def merge_metadata_in_order(spark, sf_dir):
    """Three patches a thread, the second without the key that the first sets, the last one over both."""
    t = frame(spark, sf_dir, "threads").withColumn("pos", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))))
    patch = F.when(F.col("pos") == 1, F.when(F.col("thread_id").endswith("1"), '{"n": 1, "once": true}').otherwise('{"n": 1, "once": null}')).when(F.col("pos") == 2, '{"n": [2], "what": "2"}').otherwise('{"n": 3}')
    return ops.merge_metadata(frame(spark, sf_dir, "threads"), t.select("thread_id", "user_id", "pos", patch.alias("metadata"))).select("thread_id", "metadata")


@query(
    "i5_merge_metadata",
    over("threads", """SELECT thread_id, CASE WHEN thread_id LIKE '%1' AND (user_id = 'u1' OR thread_id LIKE '%11') THEN '{"k":' || regexp_extract(metadata, '([0-9]+)', 1) || ',"none":null,"pinned":true,"tags":["a",{"x":1.5}]}' ELSE metadata END AS metadata FROM threads"""),
)
def merge_metadata(spark, sf_dir):
    t = frame(spark, sf_dir, "threads")
    by = F.when(~F.col("thread_id").endswith("11"), "u1")
    patches = t.where("thread_id like '%1'").select("thread_id", by.alias("user_id"), F.lit('{"pinned": true, "tags": ["a", {"x": 1.5}], "none": null}').alias("metadata"))
    return ops.merge_metadata(t, patches).select("thread_id", "metadata")
