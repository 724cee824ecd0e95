"""Stand-in tables: what an agent platform would log, derived from the given tables by SQL that Spark and other engines
both run. Placeholders in braces name tables or other stand-ins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {
    "run_events": """
SELECT 't' || CAST(user_id AS STRING) AS thread_id, 't' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id, 'u' || CAST(user_id % 7 AS STRING) AS user_id, event_type,
  CASE event_type WHEN 'signup' THEN 'lifecycle' WHEN 'error' THEN 'trace' ELSE 'message' END AS category, props AS metadata, 'event ' || CAST(event_id AS STRING) || ' of ' || event_type AS content, value, event_id,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts AS created_at
FROM {events}""",
    "responses": """
SELECT thread_id, run_id, CAST(event_id AS STRING) AS call_id, CASE event_type WHEN 'click' THEN 'lead_agent' WHEN 'view' THEN 'subagent:a' ELSE 'middleware:b' END AS caller, CASE WHEN k % 4 = 3 THEN NULL ELSE 'm' || CAST(k % 3 AS STRING) END AS model_name,
  CAST(floor(value) AS BIGINT) AS input_tokens, CAST(k AS BIGINT) AS output_tokens, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) + k END AS total_tokens, created_at, 2 * event_id + again AS pos
FROM {run_events} CROSS JOIN (SELECT 0 AS again UNION ALL SELECT 1 AS again) x WHERE event_type IN ('click', 'view', 'purchase') AND (again = 0 OR event_id % 10 = 0)""",
    "runs": """
SELECT run_id, thread_id, max(user_id) AS user_id, CASE max(event_id) % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'error' WHEN 2 THEN 'running' ELSE 'pending' END AS status, CASE WHEN max(event_id) % 3 = 0 THEN NULL ELSE ' m' || CAST(max(k) % 3 AS STRING) || ' ' END AS model_name,
  CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_input_tokens, CAST(sum(k) AS BIGINT) AS total_output_tokens, CAST(sum(CAST(floor(value) AS BIGINT) + k) AS BIGINT) AS total_tokens, CAST(sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END) AS BIGINT) AS lead_agent_tokens,
  CAST(sum(CASE WHEN event_type = 'view' THEN k ELSE 0 END) AS BIGINT) AS subagent_tokens, CAST(sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS BIGINT) AS middleware_tokens,
  CASE WHEN max(event_id) % 5 = 0 THEN '{{}}' ELSE '{{"m0":{{"input_tokens":' || CAST(CAST(sum(CASE WHEN k % 2 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS STRING) || ',"output_tokens":' || CAST(CAST(sum(CASE WHEN k % 2 = 0 THEN k ELSE 0 END) AS BIGINT) AS STRING) || ',"total_tokens":' || CAST(CAST(sum(CASE WHEN k % 2 = 0 THEN CAST(floor(value) AS BIGINT) + k ELSE 0 END) AS BIGINT) AS STRING)
    || '}},"m1":{{"input_tokens":' || CAST(CAST(sum(CASE WHEN k % 2 = 1 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS STRING) || ',"output_tokens":' || CAST(CAST(sum(CASE WHEN k % 2 = 1 THEN k ELSE 0 END) AS BIGINT) AS STRING) || ',"total_tokens":' || CAST(CAST(sum(CASE WHEN k % 2 = 1 THEN CAST(floor(value) AS BIGINT) + k ELSE 0 END) AS BIGINT) AS STRING) || '}}}}' END AS token_usage_by_model,
  min(created_at) AS created_at, max(created_at) AS updated_at
FROM {run_events} GROUP BY run_id, thread_id""",
    "feedback": """
SELECT CAST(event_id AS STRING) AS feedback_id, run_id, thread_id, user_id, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS rating, content AS comment, created_at, event_id
FROM {run_events} WHERE event_type IN ('purchase', 'error')""",
    "threads": """
SELECT thread_id, CASE WHEN max(event_id) % 3 = 0 THEN NULL ELSE max(user_id) END AS user_id, CASE max(event_id) % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'busy' ELSE 'error' END AS status, max_by(metadata, event_id) AS metadata, min(created_at) AS created_at, max(created_at) AS updated_at
FROM {run_events} GROUP BY thread_id""",
    "messages": """
SELECT CAST(conv_id AS STRING) AS thread_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) END AS id, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS type, text AS content,
  CAST(floor(length(text) / 4) AS BIGINT) AS input_tokens, CAST(length(text) % 97 AS BIGINT) AS output_tokens
FROM {conversations}""",
    "tool_calls": """
SELECT thread_id, seq AS turn, event_type AS name, CAST(k % 7 AS STRING) AS args, event_id, value FROM {run_events}""",
    "facts": """
SELECT source AS user_id, CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 9 = 0 THEN lower(text) ELSE text END AS content, lang AS category, round(n_chars % 100 / 100.0, 2) AS confidence, doc_id AS pos
FROM {documents}""",
    "text_facts": """
SELECT * FROM {facts}""",
    "cases": """
SELECT l.doc_id AS case_id, d.lang AS configuration, d.source AS strategy, l.quality, l.toxic, d.n_chars, CAST(l.doc_id % 3 AS INT) AS run_number
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "tasks": """
SELECT source AS project_id, doc_id AS task_id, CASE doc_id % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'completed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'planning' WHEN 6 THEN 'testing' ELSE 'failed' END AS status, CAST(doc_id % 4 AS INT) AS attempt_count, 3 AS max_attempts
FROM {documents}""",
    "files": """
SELECT source || '/' || CAST(doc_id % 10 AS STRING) || '/' || CAST(doc_id AS STRING) || '.' || lang AS path, text, doc_id FROM {documents}""",
}


def _named(sql: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}", sql)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stand-in as a DataFrame over the tables in sf_dir."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{t: frame(spark, sf_dir, t) for t in _named(SQL[name])})


def over(names: str, body: str) -> str:
    """SQL text: the named stand-ins (blank separated) and what they need as common table expressions, then the body."""
    done: list[str] = []

    def need(n: str) -> None:
        if n in SQL and n not in done:
            for t in _named(SQL[n]):
                need(t)
            done.append(n)

    for n in names.split():
        need(n)
    ctes = ", ".join(f"{n} AS ({SQL[n].format(**{t: t for t in _named(SQL[n])})})" for n in done)
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
