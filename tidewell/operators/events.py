"""Run events, runs, feedback and threads, for all threads in one pass.

Tables: events (thread_id, run_id, user_id, event_type, category, content, metadata, seq, created_at), runs, responses
(run_id, call_id, caller, model_name, token counts, pos), feedback, threads.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import scan

USAGE = "map<string,struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>>"


def _last(by: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def list_events(events: DataFrame, types: list[str] | None = None, task_key: str | None = None, task: str | None = None, after: int | None = None, limit: int = 500) -> DataFrame:
    """Events of every run, filtered by type and metadata key before the limit, the first ``limit`` by seq per run."""
    e = events
    if types is not None:
        e = e.where(F.col("event_type").isin(types))
    if task is not None:
        e = e.where(F.get_json_object("metadata", f"$.{task_key}") == task)
    if after is not None:
        e = e.where(F.col("seq") > after)
    return e.withColumn("n", _last(["run_id"], "seq")).where(F.col("n") <= limit).drop("n")


def waiting_runs(runs: DataFrame, before, statuses: tuple[str, ...] = ("pending",)) -> DataFrame:
    return runs.where(F.col("status").isin(*statuses) & (F.col("created_at") <= F.lit(before))).orderBy("created_at", "run_id")


def metadata_equals(column: str, key: str, value) -> Column:
    """Typed equality on a JSON text: booleans, integers, floats, strings and null differ; a missing key equals nothing."""
    get = lambda kind: F.expr(f"try_variant_get(try_parse_json({column}), '$[\"{key}\"]', '{kind}')")
    kind = F.schema_of_variant(get("variant"))
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (get("boolean") == value)
    if isinstance(value, int):
        return (kind == "BIGINT") & (get("bigint") == value)
    if isinstance(value, float):
        return kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE)$") & (get("double") == value)
    return (kind == "STRING") & (get("string") == value)


def search_threads(threads: DataFrame, metadata: dict | None = None, status: str | None = None, user: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Threads by owner, status and metadata, newest first. Keys outside ``[A-Za-z0-9_-]`` and values that are no JSON
    scalars are left out; if that leaves nothing of a filter, it raises."""
    asked = metadata or {}
    good = {k: v for k, v in asked.items() if re.fullmatch(r"[A-Za-z0-9_-]+", k) and (v is None or isinstance(v, (bool, float, str)) or isinstance(v, int) and -(2**63) <= v < 2**63)}
    if asked and not good:
        raise ValueError("no usable metadata filter")
    t = threads
    for k, v in good.items():
        t = t.where(metadata_equals("metadata", k, v))
    if status is not None:
        t = t.where(F.col("status") == status)
    if user is not None:
        t = t.where(F.col("user_id") == user)
    return t.orderBy(F.desc("updated_at"), F.desc("thread_id")).offset(offset).limit(limit)


def thread_access(requests: DataFrame, threads: DataFrame, strict: bool = False) -> DataFrame:
    """Whether each request (thread_id, user_id) may go on: its own thread, an unowned one, or, unless strict, none."""
    t = threads.select("thread_id", F.col("user_id").alias("owner"), F.lit(True).alias("there"))
    ok = F.when(F.col("there").isNull(), F.lit(not strict)).otherwise(F.col("owner").isNull() | (F.col("owner") == F.col("user_id")))
    return requests.join(t, "thread_id", "left").select(*requests.columns, F.coalesce(ok, F.lit(False)).alias("allowed"))


def assign_seq(new: DataFrame, existing: DataFrame, large: int = 1_000_000) -> DataFrame:
    """seq of new rows (thread_id, pos): after the thread's highest one so far, in order of pos. Threads of over ``large``
    new rows are numbered in blocks."""
    top = existing.groupBy("thread_id").agg(F.max("seq").alias("top"))
    n = scan.running(new, ["thread_id"], [F.col("pos")], {"n": F.lit(1).cast("long")}, large=large)
    hot, rows = scan.large_keys(n, ["thread_id"], large)
    if rows:  # the highest numbers of hot threads, at most a thousand, go to where their rows are
        few = top.join(F.broadcast(hot), F.col("thread_id") == F.col("_thread_id"), "left_semi")
        inside = n.join(F.broadcast(hot), F.col("thread_id") == F.col("_thread_id"), "left_semi").join(F.broadcast(few), "thread_id", "left")
        j = n.join(F.broadcast(hot), F.col("thread_id") == F.col("_thread_id"), "left_anti").join(top, "thread_id", "left").unionByName(inside)
    else:
        j = n.join(top, "thread_id", "left")
    return j.withColumn("seq", F.coalesce("top", F.lit(0)) + F.col("n")).drop("n", "top")


def run_message_page(events: DataFrame, limit: int, after: int | None = None, before: int | None = None) -> DataFrame:
    """A page of message rows of each run: the first ``limit`` after a cursor, else the last ``limit`` (before one), with
    has_more where the run holds further rows on that side."""
    m = events.where("category = 'message'")
    forward = after is not None
    if forward:
        m = m.where(F.col("seq") > after)
    elif before is not None:
        m = m.where(F.col("seq") < before)
    order = F.asc("seq") if forward else F.desc("seq")
    m = m.withColumn("n", _last(["run_id"], order)).where(F.col("n") <= limit + 1)  # one more than the page tells whether there is more
    m = m.withColumn("has_more", F.max("n").over(Window.partitionBy("run_id")) > limit)
    return m.where(F.col("n") <= limit).drop("n")


def message_page(events: DataFrame, limit: int = 50, after: int | None = None, before: int | None = None) -> DataFrame:
    """A page of message rows of each thread, like :func:`run_message_page` without the flag."""
    m = events.where("category = 'message'")
    if after is not None:
        return m.where(F.col("seq") > after).withColumn("n", _last(["thread_id"], "seq")).where(F.col("n") <= limit).drop("n")
    if before is not None:
        m = m.where(F.col("seq") < before)
    return m.withColumn("n", _last(["thread_id"], F.desc("seq"))).where(F.col("n") <= limit).drop("n")


def count_messages(events: DataFrame) -> DataFrame:
    return events.where("category = 'message'").groupBy("thread_id").agg(F.count("*").alias("n"))


def delete_events(events: DataFrame, gone: DataFrame, key: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """Events without those whose key is listed, and the counts removed per key."""
    removed = events.join(gone.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("removed"))
    return events.join(gone.select(key), key, "left_anti"), removed


def counted_responses(responses: DataFrame) -> DataFrame:
    """One row per (run, call): the first with a positive total; the total falls back to input plus output."""
    i, o = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    total = F.coalesce(F.when(F.col("total_tokens") > 0, F.col("total_tokens")), i + o)
    r = responses.select("run_id", "call_id", "caller", F.coalesce("model_name", F.lit("unknown")).alias("model"), i.alias("input_tokens"), o.alias("output_tokens"), total.alias("total_tokens"), "pos").where("total_tokens > 0")
    first = r.groupBy("run_id", "call_id").agg(F.min_by(F.struct("caller", "model", "input_tokens", "output_tokens", "total_tokens"), "pos").alias("r"))
    return first.select("run_id", "call_id", "r.*")


def run_token_rollup(responses: DataFrame) -> DataFrame:
    """Per run: token sums, calls, sums by caller class, and a map of total tokens by model."""
    r = counted_responses(responses)
    t = F.col("total_tokens")
    by = lambda c: F.coalesce(F.sum(F.when(c, t)), F.lit(0))
    sub, mid = F.col("caller").startswith("subagent:"), F.col("caller").startswith("middleware:")
    sums = r.groupBy("run_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(t).alias("total_tokens"), F.count("*").alias("calls"),
        by(~sub & ~mid).alias("lead_agent_tokens"), by(sub).alias("subagent_tokens"), by(mid).alias("middleware_tokens"),
    )
    models = r.groupBy("run_id", "model").agg(F.sum(t).alias("t")).groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "t")))).alias("by_model"))
    return sums.join(models, "run_id")


def external_usage_rollup(records: DataFrame) -> DataFrame:
    """Token sums per caller from subagent records, one per source run with a positive total; empty source ids skipped."""
    r = records.where("source_run_id is not null and source_run_id <> '' and total_tokens > 0")
    r = r.groupBy("source_run_id").agg(F.min_by(F.struct("caller", "input_tokens", "output_tokens", "total_tokens"), "pos").alias("r")).select("r.*")
    return r.groupBy("caller").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")], F.count("*").alias("records"))


def thread_token_usage(runs: DataFrame, include_active: bool = False) -> DataFrame:
    status = ["success", "error"] + ["running"] * include_active
    sums = ("total_input_tokens", "total_output_tokens", "total_tokens", "lead_agent_tokens", "subagent_tokens", "middleware_tokens")
    return runs.where(F.col("status").isin(status)).groupBy("thread_id").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("runs"))


def tokens_by_model(runs: DataFrame) -> DataFrame:
    """Per thread and model: tokens and runs from the JSON map; an empty map falls back to the run's model and total."""
    usage = F.from_json("token_usage_by_model", USAGE)
    model = F.coalesce(F.nullif(F.trim("model_name"), F.lit("")), F.lit("unknown"))
    pairs = F.when(F.size(usage) > 0, F.transform(F.map_entries(usage), lambda e: F.struct(e["key"].alias("model"), e["value"]["total_tokens"].alias("tokens"))))
    rows = runs.select("thread_id", "run_id", F.inline(F.coalesce(pairs, F.array(F.struct(model.alias("model"), F.col("total_tokens").alias("tokens"))))))
    return rows.groupBy("thread_id", "model").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("runs"))


def run_durations(runs: DataFrame) -> DataFrame:
    s = (F.col("updated_at").cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")).cast("long")
    return runs.where("created_at is not null and updated_at is not null").select("run_id", s.alias("seconds"))


def token_budget(usage: DataFrame, limit: int, warn: float = 0.8, hard: float = 1.0, large: int = 1_000_000) -> DataFrame:
    """Running tokens of each run (rows: run_id, message_id, total_tokens, pos) against its limit.

    A later revision of a message adds only its increase. State is warn at the first row at or over ``warn`` of the
    limit, hard at and after ``hard``, else ok. Runs of over ``large`` rows are summed in blocks."""
    was = F.lag("total_tokens").over(Window.partitionBy("run_id", "message_id").orderBy("pos"))
    grown = usage.withColumn("growth", F.greatest(F.col("total_tokens") - F.coalesce(was, F.lit(0)), F.lit(0)))
    used = scan.running(grown, ["run_id"], [F.col("pos")], {"used": F.col("growth")}, large=large)
    share = F.col("used") / F.lit(float(limit))
    before = (F.col("used") - F.col("growth")) / F.lit(float(limit))
    return used.withColumn("state", F.when(share >= hard, "hard").when((share >= warn) & (before < warn), "warn").otherwise("ok")).drop("growth")


def upsert_runs(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base with changes (same columns plus pos) applied by run_id: the last one wins, the first created_at stays, model
    names are trimmed and cut at 128 characters."""
    cols = [c for c in base.columns if c not in ("run_id", "created_at")]
    both = base.withColumn("pos", F.lit(-1).cast("long")).unionByName(changes.withColumn("pos", F.col("pos").cast("long")))
    last = both.groupBy("run_id").agg(F.max_by(F.struct(*cols), "pos").alias("r"), F.min_by("created_at", "pos").alias("created_at"))
    return last.select("run_id", "created_at", "r.*").withColumn("model_name", F.left(F.trim("model_name"), F.lit(128)))


def apply_progress(runs: DataFrame, progress: DataFrame, counters: list[str]) -> DataFrame:
    """Counters given (non-null) by progress rows (run_id, counters) replace those of runs that are still running."""
    p = progress.select("run_id", *[F.col(c).alias(f"p_{c}") for c in counters])
    j = runs.join(p, "run_id", "left")
    return j.select(*[F.when(F.col("status") == "running", F.coalesce(f"p_{c}", c)).otherwise(F.col(c)).alias(c) if c in counters else F.col(c) for c in runs.columns])


def apply_completion(runs: DataFrame, done: DataFrame, counters: list[str], texts: list[str]) -> DataFrame:
    """Completion rows (run_id, status, counters, texts) set status and all counters; a null text keeps the old one."""
    d = done.select("run_id", F.lit(True).alias("is_done"), F.col("status").alias("d_status"), *[F.col(c).alias(f"d_{c}") for c in counters + texts])
    j, hit = runs.join(d, "run_id", "left"), F.col("is_done")
    pick = lambda c: F.when(hit, F.coalesce(f"d_{c}", F.lit(0)) if c in counters else F.coalesce(f"d_{c}", c)).otherwise(F.col(c)).alias(c)
    return j.select(*[pick(c) if c in counters + texts + ["status"] else F.col(c) for c in runs.columns])


def llm_latency(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Milliseconds from start to the first end of each call; later ends and ends without a start are null."""
    n = ends.withColumn("n", _last(["run_id", "call_id"], "ended_at"))
    s = starts.groupBy("run_id", "call_id").agg(F.min("started_at").alias("started_at")).withColumn("n", F.lit(1))
    ms = F.expr("timestampdiff(MILLISECOND, started_at, ended_at)")
    return n.join(s, ["run_id", "call_id", "n"], "left").select("run_id", "call_id", "n", ms.alias("ms"))


def merge_runs(live: DataFrame, stored: DataFrame, limit: int = 100) -> DataFrame:
    """Union by run_id where live rows win; the newest ``limit`` per thread."""
    both = live.withColumn("rank", F.lit(0)).unionByName(stored.withColumn("rank", F.lit(1)))
    one = both.withColumn("n", _last(["run_id"], "rank")).where("n = 1").drop("n", "rank")
    return latest_runs(one, limit)


def latest_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    return runs.withColumn("n", _last(["thread_id"], F.desc("created_at"), F.desc("run_id"))).where(F.col("n") <= limit).drop("n")


def feedback_by_run(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"))


def upsert_feedback(rows: DataFrame) -> DataFrame:
    """One row per (thread, run, user): the last valid one (rating +1 or -1) by created_at, then feedback_id."""
    ok = rows.where(F.col("rating").isin(1, -1))
    return ok.withColumn("n", _last(["thread_id", "run_id", "user_id"], F.desc("created_at"), F.desc("feedback_id"))).where("n = 1").drop("n")


def feedback_list(feedback: DataFrame, key: str = "thread_id", limit: int = 100) -> DataFrame:
    return feedback.withColumn("n", _last([key], "created_at", "feedback_id")).where(F.col("n") <= limit).drop("n")


def merge_metadata(threads: DataFrame, patches: DataFrame) -> DataFrame:
    """Thread metadata (JSON) with the patches' keys written over it, values of any type kept as they are: one row a thread.

    A patch counts if it comes from the thread's owner or names no user; a thread without an owner takes only the latter. The
    patches of a thread (with pos, where they have an order; else by user and text) are applied one after the other: of
    each key the last value stays. Keys are folded as rows, so no thread's patches are held as a list."""
    as_map = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    order = ["pos"] if "pos" in patches.columns else []
    p = patches.select("thread_id", F.col("user_id").alias("by"), F.struct(*order, "user_id", "metadata").alias("at"), F.explode(as_map("metadata")).alias("k", "v"))
    p = p.join(threads.select("thread_id", F.col("user_id").alias("owner")), "thread_id").where("by is null or owner = by")
    p = p.groupBy("thread_id", "k").agg(F.max_by(F.to_json("v"), "at").alias("v"))
    new = p.groupBy("thread_id").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: F.struct(x["k"], F.parse_json(x["v"])))).alias("new"))
    j = threads.join(new, "thread_id", "left")
    merged = F.map_concat(F.map_filter(as_map("metadata"), lambda k, _: ~F.array_contains(F.map_keys("new"), k)), F.col("new"))
    return j.withColumn("metadata", F.when(F.col("new").isNotNull(), F.to_json(merged)).otherwise(F.col("metadata"))).select(*threads.columns)


def messages_with_feedback(events: DataFrame, feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Message feed: the run's rating on its last response only, the run's duration on every response.

    Responses are message rows of event_type ``click``-like kinds given by a boolean column ``is_ai``."""
    m = events.where("category = 'message'")
    last = m.where("is_ai").groupBy("run_id").agg(F.max("seq").alias("seq")).withColumn("last", F.lit(True))
    f = feedback.select("thread_id", "run_id", "user_id", "rating")
    j = m.join(last, ["run_id", "seq"], "left").join(run_durations(runs), "run_id", "left").join(f, ["thread_id", "run_id", "user_id"], "left")
    return j.select("thread_id", "run_id", "seq", F.when(F.col("last"), F.col("rating")).alias("rating"), F.when(F.col("is_ai"), F.col("seconds")).alias("seconds"))


def run_message_summary(events: DataFrame, cut: int = 2000, lead: str = "lead_agent") -> DataFrame:
    """Per run: message count, the first human text that was put to the lead agent and the lead agent's last non-empty
    response, each cut. Messages of other callers (subagents, middleware) count, but their texts are passed over; a
    response without a caller is the lead agent's."""
    m = events.where("category = 'message'")
    human = ~F.col("is_ai") & (F.col("content") != "") & (F.col("caller") == lead)
    text = F.regexp_replace("content", r"(?U)^\s+|\s+$", "")
    ai = F.col("is_ai") & (text != "") & (F.col("caller").isNull() | (F.col("caller") == lead))
    return m.groupBy("run_id").agg(
        F.count("*").alias("message_count"),
        F.left(F.min_by(F.when(human, F.col("content")), F.when(human, F.col("seq"))), F.lit(cut)).alias("first_human"),
        F.left(F.max_by(F.when(ai, text), F.when(ai, F.col("seq"))), F.lit(cut)).alias("last_ai"),
    )
