"""Queries over evaluation results, tasks and pod samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import evals as ops
from tidewell.plans.registry import query
from tidewell.plans.standins import frame, over


def _runs(spark, sf_dir):
    return frame(spark, sf_dir, "cases").select("configuration", F.col("quality").cast("double").alias("pass_rate"), (F.col("n_chars") / 100).alias("time_seconds"), F.col("n_chars").alias("tokens"))


SUMMARY = """m AS (SELECT configuration, 'pass_rate' AS metric, quality::DOUBLE AS x FROM cases UNION ALL SELECT configuration, 'time_seconds', n_chars / 100 FROM cases UNION ALL SELECT configuration, 'tokens', n_chars FROM cases),
s AS (SELECT configuration, metric, round(avg(x), 4) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS stddev, round(min(x), 4) AS min, round(max(x), 4) AS max FROM m GROUP BY 1, 2)"""


@query("e17_benchmark_summary", over("cases", f"WITH {SUMMARY} SELECT * FROM s"))
def benchmark_summary(spark, sf_dir):
    return ops.benchmark_summary(_runs(spark, sf_dir))


@query(
    "e18_benchmark_delta",
    over("cases", f"WITH {SUMMARY}, d AS (SELECT metric, max(mean) FILTER (configuration = 'de') - max(mean) FILTER (configuration = 'en') AS d FROM s GROUP BY 1) SELECT metric, CASE metric WHEN 'pass_rate' THEN printf('%+.2f', d) WHEN 'time_seconds' THEN printf('%+.1f', d) ELSE printf('%+.0f', d) END AS delta FROM d"),
)
def benchmark_delta(spark, sf_dir):
    return ops.benchmark_delta(ops.benchmark_summary(_runs(spark, sf_dir)))


def _trials(spark, sf_dir):
    return frame(spark, sf_dir, "cases").select(F.concat_ws("-", "strategy", "configuration").alias("query"), (F.col("configuration") == "en").alias("should_trigger"), (F.col("quality") == 1).alias("triggered"))


TRIALS = "t AS (SELECT strategy || '-' || configuration AS query, configuration = 'en' AS should_trigger, count(*) FILTER (quality = 1) AS triggers, count(*) AS runs FROM cases GROUP BY 1, 2), r AS (SELECT *, round(triggers / runs, 6) AS rate, CASE WHEN should_trigger THEN triggers / runs >= 0.5 ELSE triggers / runs < 0.5 END AS passed FROM t)"


@query("e19_trigger_eval", over("cases", f"WITH {TRIALS} SELECT * FROM r"))
def trigger_eval(spark, sf_dir):
    return ops.trigger_eval(_trials(spark, sf_dir))


@query("e19_trigger_total", over("cases", f"WITH {TRIALS} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM r"))
def trigger_total(spark, sf_dir):
    return ops.trigger_total(ops.trigger_eval(_trials(spark, sf_dir)))


@query(
    "e20_confusion",
    over("cases", "WITH c AS (SELECT count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn, count(*) FILTER (quality = 0 AND n_chars <= 1000) AS tn FROM cases) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c"),
)
def confusion(spark, sf_dir):
    c = frame(spark, sf_dir, "cases").select((F.col("quality") == 1).alias("good"), (F.col("n_chars") > 1000).alias("long"))
    return ops.confusion(c, "good", "long")


@query(
    "e21_agent_eval_metrics",
    over("cases", "SELECT count(*) AS cases, round(avg(quality::DOUBLE), 6) AS pass_rate, round(avg((case_id % 7 < 5)::INT::DOUBLE), 6) AS recall_at_k, round(avg(n_chars), 6) AS mean_tokens FROM cases"),
)
def agent_eval_metrics(spark, sf_dir):
    c = frame(spark, sf_dir, "cases").select((F.col("quality") == 1).alias("passed"), F.array((F.col("case_id") % 7).cast("int")).alias("expected"), F.array(*[F.lit(i) for i in range(7)]).alias("retrieved"), F.col("n_chars").alias("tokens"))
    return ops.agent_eval_metrics(c)


@query(
    "e22_fixed_eval_metrics",
    over("cases", "SELECT count(*) AS cases, round(avg((toxic = 0)::INT), 6) AS apply_rate, round(avg((quality = 1)::INT), 6) AS test_rate, round(avg((toxic = 0 AND quality = 1)::INT), 6) AS success_rate, round(count(*) FILTER (toxic = 1 AND case_id % 2 = 0) / count(*) FILTER (case_id % 2 = 0), 6) AS unsafe_block_rate, round(avg(n_chars), 6) AS mean_seconds FROM cases"),
)
def fixed_eval_metrics(spark, sf_dir):
    c = frame(spark, sf_dir, "cases").select((F.col("toxic") == 0).alias("applied"), (F.col("quality") == 1).alias("tested"), (F.col("case_id") % 2 == 0).alias("unsafe"), F.col("n_chars").alias("seconds"))
    return ops.fixed_eval_metrics(c)


@query(
    "e23_strategy_metrics",
    over("cases documents", "SELECT strategy, count(*) AS cases, round(avg((quality = 1)::INT), 6) AS correct_rate, round(avg(c.n_chars), 6) AS mean_prompt_tokens, round(avg(1 - (contains(text, 'the')::INT + contains(text, 'que')::INT) / 2), 6) AS omission FROM cases c JOIN documents d ON d.doc_id = c.case_id GROUP BY 1"),
)
def strategy_metrics(spark, sf_dir):
    c = frame(spark, sf_dir, "cases").join(frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("prompt")), "case_id")
    c = c.withColumns({"answer_text": F.when(F.col("quality") == 1, "Answer: A").otherwise("B."), "expected_answer": F.lit("A"), "prompt_tokens": F.col("n_chars"), "required_facts": F.array(F.lit("the"), F.lit("que"))})
    return ops.strategy_metrics(c)


@query(
    "e16_task_metrics",
    over(
        "tasks",
        "SELECT project_id, count(*) AS total, "
        + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ops.TASK_STATUSES)
        + ", count(*) FILTER (status IN ('pending', 'planning')) AS queue_depth, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'failed' AND attempt_count < max_attempts) AS retryable, count(*) FILTER (status = 'failed' AND attempt_count >= max_attempts) AS exhausted, sum(attempt_count)::BIGINT AS attempts FROM tasks GROUP BY 1",
    ),
)
def task_metrics(spark, sf_dir):
    return ops.task_metrics(frame(spark, sf_dir, "tasks"))


@query("g10_best_iteration", over("cases", "SELECT run, iteration FROM (SELECT strategy AS run, case_id AS iteration, row_number() OVER (PARTITION BY strategy ORDER BY coalesce(CASE WHEN quality = 1 THEN n_chars END, toxic) DESC, case_id) AS n FROM cases) WHERE n = 1"))
def best_iteration(spark, sf_dir):
    c = frame(spark, sf_dir, "cases").select(F.col("strategy").alias("run"), F.col("case_id").alias("iteration"), F.when(F.col("quality") == 1, F.col("n_chars")).alias("test_passed"), F.col("toxic").cast("long").alias("train_passed"))
    return ops.best_iteration(c).select("run", "iteration")


@query("g11_stratified_split", over("cases", "SELECT case_id, toxic, r <= greatest(1, floor(n * 0.3)) AS is_test FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || case_id), case_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM cases)"))
def stratified_split(spark, sf_dir):
    return ops.stratified_split(frame(spark, sf_dir, "cases"), "toxic", "case_id", 0.3).select("case_id", "toxic", "is_test")


def _pods(spark, sf_dir):
    e = frame(spark, sf_dir, "run_events")
    top = e.groupBy(F.col("thread_id").alias("name")).agg(F.concat((F.max("k") * 10).cast("string"), F.lit("m")).alias("cpu_raw"), F.when(F.max("k") % 5 == 4, "?").otherwise(F.concat(F.max("seq").cast("string"), F.lit("Mi"))).alias("memory_raw"))
    pods = e.where("seq = 1").select(F.col("thread_id").alias("name"), F.col("event_type").alias("phase"))
    procs = e.select(F.col("thread_id").alias("name"), F.col("event_id").alias("pid"), F.col("k").alias("rss_kib"), F.col("event_type").alias("command"))
    return ops.pod_report(top, pods, procs)


PODS = """p AS (SELECT thread_id AS name, (max(k) * 10)::BIGINT AS millicores, CASE WHEN max(k) % 5 = 4 THEN NULL ELSE max(seq)::DOUBLE END AS mib FROM run_events GROUP BY 1),
t AS (SELECT thread_id AS name, string_agg(event_type || ':' || k, ',' ORDER BY n) AS top_processes FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY k DESC, event_id) AS n FROM run_events) WHERE n <= 3 GROUP BY 1)"""


@query("d9_pod_report", over("run_events", f"WITH {PODS} SELECT p.name, millicores, mib, event_type AS phase, top_processes FROM p LEFT JOIN t USING (name) LEFT JOIN run_events e ON e.thread_id = p.name AND seq = 1"))
def pod_report(spark, sf_dir):
    r = _pods(spark, sf_dir)
    return r.withColumn("top_processes", F.array_join(F.transform("top_processes", lambda x: F.concat(x["command"], F.lit(":"), x["rss_kib"].cast("string"))), ",")).withColumn("mib", F.col("mib").cast("double"))


@query("d9_pod_totals", over("run_events", f"WITH {PODS} SELECT count(*) AS pods, round(sum(mib), 3) AS total_mib, round(avg(mib), 3) AS mean_mib, max(mib) AS max_mib, count(*) FILTER (mib IS NULL) AS unparsed FROM p"))
def pod_totals(spark, sf_dir):
    t = ops.pod_totals(_pods(spark, sf_dir))
    return t.withColumns({c: F.col(c).cast("double") for c in ("total_mib", "mean_mib", "max_mib")})
