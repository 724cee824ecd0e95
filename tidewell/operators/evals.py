"""Rollups of evaluation results, tasks and pod samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import scan
from tidewell.functions import text as tx

# The task statuses that a report lists even where none has them.
TASK_STATUSES = (
    "pending", "planning", "retrieving", "generating", "validating", "applying", "testing", "repairing", "reviewing", "running",
    "completed", "failed", "cancelled", "rejected", "blocked", "timed_out",
)
METRICS = ("pass_rate", "time_seconds", "tokens")


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Per configuration and metric: mean, sample stddev (0 for one run), min and max, rounded to 4."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in METRICS])
    r = runs.select("configuration", F.inline(rows))
    stats = {"mean": F.avg("x"), "stddev": F.coalesce(F.stddev_samp("x"), F.lit(0.0)), "min": F.min("x"), "max": F.max("x")}
    return r.groupBy("configuration", "metric").agg(*[F.round(c, 4).alias(k) for k, c in stats.items()])


def benchmark_delta(summary: DataFrame) -> DataFrame:
    """First configuration by name minus the second, as signed text with 2, 1 and 0 decimals."""
    names = summary.select("configuration").distinct().orderBy("configuration").limit(2)
    ranked = names.withColumn("r", F.row_number().over(Window.orderBy("configuration")))
    s = summary.join(F.broadcast(ranked), "configuration").groupBy("metric").agg(F.max(F.when(F.col("r") == 1, F.col("mean"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("mean"))).alias("b"))
    d = F.col("a") - F.col("b")
    return s.select("metric", F.when(F.col("metric") == "pass_rate", F.format_string("%+.2f", d)).when(F.col("metric") == "time_seconds", F.format_string("%+.1f", d)).otherwise(F.format_string("%+.0f", d)).alias("delta"))


def trigger_eval(trials: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per query (query, should_trigger, triggered): triggers, runs, rate and whether it passes."""
    g = trials.groupBy("query", "should_trigger").agg(F.count_if("triggered").alias("triggers"), F.count("*").alias("runs"))
    rate = F.col("triggers") / F.col("runs")
    return g.withColumn("rate", F.round(rate, 6)).withColumn("passed", F.when(F.col("should_trigger"), rate >= threshold).otherwise(rate < threshold))


def trigger_total(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def confusion(results: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts, precision and recall (1.0 where empty) and accuracy (0.0 where empty)."""
    t, g = F.col(truth), F.col(guess)
    c = results.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    ratio = lambda a, b, empty: F.round(F.when(b == 0, F.lit(empty)).otherwise(a / b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": ratio(tp, tp + fp, 1.0), "recall": ratio(tp, tp + fn, 1.0), "accuracy": ratio(tp + tn, tp + fp + fn + tn, 0.0)})


def agent_eval_metrics(cases: DataFrame, k: int = 5) -> DataFrame:
    """Pass rate, recall at k (all expected paths among the first k retrieved) and mean tokens."""
    hit = F.size(F.array_except("expected", F.slice("retrieved", 1, k))) == 0
    return cases.agg(F.count("*").alias("cases"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.round(F.avg(hit.cast("double")), 6).alias("recall_at_k"), F.round(F.avg("tokens"), 6).alias("mean_tokens"))


def fixed_eval_metrics(cases: DataFrame) -> DataFrame:
    """Apply, test, success and unsafe-block rates (0 where there is no case) and mean seconds."""
    rate = lambda ok, among: F.round(F.coalesce(F.count_if(ok & among) / F.nullif(F.count_if(among), F.lit(0)), F.lit(0.0)), 6)
    every = F.lit(True)
    return cases.agg(
        F.count("*").alias("cases"), rate(F.col("applied"), every).alias("apply_rate"), rate(F.col("tested"), every).alias("test_rate"), rate(F.col("applied") & F.col("tested"), every).alias("success_rate"),
        rate(~F.col("applied"), F.col("unsafe")).alias("unsafe_block_rate"), F.round(F.avg("seconds"), 6).alias("mean_seconds"),
    )


def strategy_metrics(cases: DataFrame) -> DataFrame:
    """Per strategy: cases, correct rate, mean prompt tokens, and omission: one less the share of required facts found."""
    found = F.size(F.filter("required_facts", lambda f: F.col("prompt").contains(f)))
    share = F.when(F.size("required_facts") == 0, 1.0).otherwise(found / F.size("required_facts"))
    right = tx.parse_choice("answer_text") == F.col("expected_answer")
    return cases.groupBy("strategy").agg(F.count("*").alias("cases"), F.round(F.avg(F.coalesce(right, F.lit(False)).cast("double")), 6).alias("correct_rate"), F.round(F.avg("prompt_tokens"), 6).alias("mean_prompt_tokens"), F.round(F.avg(1 - share), 6).alias("omission"))


def task_metrics(tasks: DataFrame) -> DataFrame:
    """Per project: tasks, count per status (zero where none), queue depth, failed, retryable, exhausted, attempts."""
    s = F.col("status")
    retry = F.col("attempt_count") < F.col("max_attempts")
    return tasks.groupBy("project_id").agg(
        F.count("*").alias("total"), *[F.count_if(s == x).alias(f"n_{x}") for x in TASK_STATUSES], F.count_if(s.isin("pending", "planning")).alias("queue_depth"),
        F.count_if(s == "failed").alias("failed"), F.count_if((s == "failed") & retry).alias("retryable"), F.count_if((s == "failed") & ~retry).alias("exhausted"), F.sum("attempt_count").alias("attempts"),
    )


def best_iteration(history: DataFrame) -> DataFrame:
    """Per run (run, iteration, train_passed, test_passed): the iteration with most test passes (train where there are
    none), the first on ties."""
    score = F.coalesce("test_passed", "train_passed")
    w = Window.partitionBy("run").orderBy(F.desc(score), "iteration")
    return history.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def stratified_split(rows: DataFrame, stratum: str, key: str, holdout: float, seed: int = 42) -> DataFrame:
    """rows with is_test: of each stratum, max(1, floor(n x holdout)) rows in a seeded hash order. No stratum is sorted: counts
    by hash range leave one small range of each to rank. Rows with equal keys are told apart by all their columns."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    spot = F.concat(digest, F.coalesce(F.col(key).cast("string"), F.lit("")))
    return scan.first_of_strata(rows, stratum, spot, F.greatest(F.lit(1), F.floor(F.col("n") * holdout)), "is_test")


def pod_report(top: DataFrame, pods: DataFrame, processes: DataFrame, k: int = 3) -> DataFrame:
    """Samples (name, cpu_raw, memory_raw) with pod labels and the k largest processes by memory of each pod."""
    w = Window.partitionBy("name").orderBy(F.desc("rss_kib"), "pid")
    best = processes.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    best = best.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "command", "rss_kib"))).alias("top_processes"))
    s = top.select("name", tx.parse_cpu("cpu_raw").alias("millicores"), F.round(tx.parse_memory("memory_raw") / (1 << 20), 3).alias("mib"))
    return s.join(pods, "name", "left").join(best, "name", "left")


def pod_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("pods"), F.round(F.sum("mib"), 3).alias("total_mib"), F.round(F.avg("mib"), 3).alias("mean_mib"), F.max("mib").alias("max_mib"), F.count_if(F.col("mib").isNull() | F.col("millicores").isNull()).alias("unparsed"))
