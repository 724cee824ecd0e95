"""Round trips through the file formats: tables exported into the shared folder and loaded again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.plans.registry import query
from tidewell.plans.standins import frame, over
from tidewell.plans.streams import folder
from tidewell.sources import files as src


@query("a1_load_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def load_csv(spark, sf_dir):
    path = src.export(frame(spark, sf_dir, "customer"), f"{folder(spark)}/2024 customers.csv")
    return src.load_csv(spark, [path])["t_2024_customers"]


@query("a1_load_csv_line_ends", "SELECT doc_id::INT AS doc_id, nullif(text, '') AS text, lang, doc_id / 8.0 AS eighth, DATE '2020-01-01' + (doc_id % 500)::INT AS day, doc_id % 2 = 0 AS even FROM documents")
def load_csv_line_ends(spark, sf_dir):
    """Whole texts with quotes and line ends in cells, with inferred types."""
    d = frame(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.col("doc_id") / 8).alias("eighth"), F.expr("date_add(DATE'2020-01-01', cast(doc_id % 500 as int))").alias("day"), (F.col("doc_id") % 2 == 0).alias("even"))
    return src.load_csv(spark, [src.export(d, f"{folder(spark)}/texts.csv")])["texts"]


@query("a3_export_json", "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price FROM orders")
def export_json(spark, sf_dir):
    o = frame(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"))
    path = src.export(o, f"{folder(spark)}/orders.json")
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_orderdate string, price double").json(path)


@query("a3_export_markdown", "SELECT '| p_partkey | p_name |' AS value UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || p_partkey || ' | a\\|' || p_name || ' |' FROM part")
def export_markdown(spark, sf_dir):
    p = frame(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a|"), "p_name").alias("p_name"))
    return spark.read.text(src.export(p, f"{folder(spark)}/part.md"))


@query("a4_read_events", over("run_events", "SELECT thread_id, run_id, event_type, content, seq FROM run_events"))
def read_events(spark, sf_dir):
    e = frame(spark, sf_dir, "run_events").select("thread_id", "run_id", "user_id", "event_type", "category", "content", "metadata", "seq", "created_at")
    lines = e.select(F.to_json(F.struct("*")).alias("value")).unionByName(e.where("seq = 1").select(F.lit("{not json").alias("value")))
    path = f"{folder(spark)}/threads"
    lines.write.text(path)
    return src.read_events(spark, path).select("thread_id", "run_id", "event_type", "content", "seq")


@query(
    "a2_table_names",
    """WITH s AS (SELECT DISTINCT c_mktsegment AS m FROM customer), f AS (SELECT m, '2 ' || m || '!' AS stem, k FROM s, range(0, 3) r(k))
SELECT 't_' || regexp_replace(stem, '[^A-Za-z0-9_]', '_', 'g') || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS name, (SELECT count(*) FROM customer WHERE c_mktsegment = m AND c_custkey % 3 = k) AS n FROM f""",
)
def table_names(spark, sf_dir):
    """Three files a segment, of the same name in three folders: loaded as tables whose names are made valid and distinct."""
    c, root = frame(spark, sf_dir, "customer"), folder(spark)
    segments = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a handful
    for k in range(3):
        rows = c.where(F.col("c_custkey") % 3 == k).groupBy("c_mktsegment").agg(F.array_join(F.sort_array(F.collect_list(F.col("c_custkey").cast("string"))), "\n").alias("keys"))
        src.write_named(rows.select(F.concat(F.lit("2 "), "c_mktsegment", F.lit("!.csv")).alias("path"), F.concat(F.lit("c_custkey\n"), "keys").alias("value")), f"{root}/{k}")
    tables = src.load_csv(spark, [f"{root}/{k}/2 {m}!.csv" for k in range(3) for m in segments], line_ends=False)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every


@query(
    "a5_read_benchmark_runs",
    """WITH r AS (SELECT doc_id % 5 + 1 AS e, lang, doc_id % 3 + 1 AS k, count(*) FILTER (doc_id % 2 = 0) AS passed, count(*) AS total, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2, 3)
SELECT CASE WHEN e = 5 THEN 105 ELSE e END::INT AS eval_id, lang AS configuration, k::INT AS run_number, round(passed / total, 6) AS pass_rate, CASE k WHEN 1 THEN total / 4 WHEN 2 THEN total / 8 ELSE 0 END::DOUBLE AS time_seconds, CASE WHEN k = 2 THEN 10 * total ELSE chars END::BIGINT AS tokens, total::INT AS expectations FROM r""",
)
def read_benchmark_runs(spark, sf_dir):
    """A benchmark folder made of all documents: times in the grading, in a sibling file or nowhere, one eval with an id of its own,
    one grading that does not parse."""
    d = frame(spark, sf_dir, "documents").select(F.col("doc_id"), (F.col("doc_id") % 5 + 1).alias("e"), "lang", (F.col("doc_id") % 3 + 1).alias("k"), "n_chars")
    g = d.groupBy("e", "lang", "k").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("passed"), F.count("*").alias("total"), F.sum("n_chars").cast("long").alias("chars"), F.collect_list(F.struct(F.col("doc_id").cast("string").alias("text"), (F.col("doc_id") % 2 == 0).alias("passed"))).alias("expectations"))
    at = F.concat(F.lit("eval-"), "e", F.lit("/"), "lang", F.lit("/run-"), "k")
    grading = F.to_json(F.struct(
        "expectations", F.struct("passed", "total", F.round(F.col("passed") / F.col("total"), 6).alias("pass_rate")).alias("summary"), F.struct(F.col("chars").alias("output_chars")).alias("execution_metrics"),
        F.when(F.col("k") == 1, F.struct((F.col("total") / 4).alias("total_duration_seconds"))).alias("timing"),
    ))
    timing = g.where("k = 2").select(F.concat(at, F.lit("/timing.json")).alias("path"), F.to_json(F.struct((F.col("total") / 8).alias("total_duration_seconds"), (10 * F.col("total")).alias("total_tokens"))).alias("value"))
    once = g.where("e = 5").select(F.lit("eval-5/eval_metadata.json").alias("path"), F.lit('{"eval_id": 105}').alias("value")).distinct()
    broken = g.select(F.concat(F.lit("eval-"), "e", F.lit("/broken/run-1/grading.json")).alias("path"), F.lit("{not json").alias("value")).distinct()
    root = src.write_named(g.select(F.concat(at, F.lit("/grading.json")).alias("path"), grading.alias("value")).unionByName(timing).unionByName(once).unionByName(broken), folder(spark))
    return src.read_benchmark_runs(spark, root).withColumn("expectations", F.size("expectations"))


@query(
    "a7_read_tasks",
    """SELECT source AS project_id, source || '-' || lang AS task_id, CASE WHEN count(*) % 2 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, (count(*) % 4)::INT AS attempt_count, 3 AS max_attempts, 2 AS contexts, round(count(*) / 7, 4) AS score, 'count ' || sum(n_chars)::BIGINT AS step FROM documents GROUP BY source, lang""",
)
def read_tasks(spark, sf_dir):
    """A project folder for each source with a task for each of its languages, over all documents."""
    g = frame(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id"), "lang").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))
    context = lambda path, score: F.struct(F.lit(path).alias("path"), score.alias("score"))
    task = F.to_json(F.struct(
        "project_id", F.concat("project_id", F.lit("-"), "lang").alias("task_id"), F.when(F.col("n") % 2 == 0, "COMPLETED").otherwise("FAILED").alias("status"), (F.col("n") % 4).alias("attempt_count"), F.lit(3).alias("max_attempts"),
        F.array(context("a.py", F.round(F.col("n") / 7, 4)), context("b.py", F.lit(0.0))).alias("contexts"), F.array(F.struct(F.concat(F.lit("count "), "chars").alias("name"), F.lit("done").alias("status"))).alias("steps"),
    ))
    root = src.write_named(g.select(F.concat("project_id", F.lit("/"), "lang", F.lit("/task.json")).alias("path"), task.alias("value")), folder(spark))
    t = src.read_tasks(spark, root)
    return t.select("project_id", "task_id", "status", "attempt_count", "max_attempts", F.size("contexts").alias("contexts"), F.col("contexts")[0]["score"].alias("score"), F.col("steps")[0]["name"].alias("step"))
