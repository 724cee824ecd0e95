"""Readers of the file layouts that agent platforms leave behind, and exports."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import summary_lines
from tidewell.sources import csv

EVENT_SCHEMA = "thread_id string, run_id string, user_id string, event_type string, category string, content string, metadata string, seq long, created_at timestamp"
NOISE_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".idea", ".vscode")
LANGUAGES = {"py": "python", "go": "go", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "md": "markdown", "sql": "sql", "sh": "shell", "yaml": "yaml", "yml": "yaml", "json": "json"}


def sanitize_table_name(name: str) -> str:
    """Non-word characters become underscores; a leading digit gets ``t_`` in front."""
    clean = re.sub(r"\W", "_", name)
    return f"t_{clean}" if clean[:1].isdigit() else clean


def table_names(names: list[str]) -> list[str]:
    """Sanitised names made distinct with _1, _2, ... in the given order."""
    taken: set[str] = set()
    out = []
    for base in map(sanitize_table_name, names):
        name, k = base, 0
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        out.append(name)
    return out


def load_csv(spark: SparkSession, paths: list[str], schemas: dict[str, str] | None = None, line_ends: bool = True) -> dict[str, DataFrame]:
    """Every CSV as a table (and temporary view) named after its file stem. A schema saves the inference scan. Quotes in
    cells are doubled, empty cells are null, quoted or not, and cells may hold line ends; large files are read in splits all
    the same. Where no cell holds any, ``line_ends=False`` saves the count of quotes."""
    stems = [p.rstrip("/").rpartition("/")[2].rpartition(".")[0] or p for p in paths]
    tables = {}
    for name, stem, path in zip(table_names(stems), stems, paths):
        given = (schemas or {}).get(stem)
        reader = spark.read.options(header=True, **csv.OPTIONS)
        if line_ends:
            df = csv.read(spark, path, given)
        else:
            df = reader.schema(given).csv(path) if given else reader.option("inferSchema", True).csv(path)
        df.createOrReplaceTempView(name)
        tables[name] = df
    return tables


def export(df: DataFrame, path: str) -> str:
    """Write part files in the format of the path's ending: .csv with header, .json with nulls kept, .md as a table.

    Binary columns are written as hex, timestamps in ISO form. Returns the folder written."""
    kind = path.rpartition(".")[2].lower()
    if kind not in ("csv", "json", "md"):
        raise ValueError(f"cannot export to .{kind}; use .csv, .json or .md")
    flat = df.select(*[F.hex(c.name).alias(c.name) if isinstance(c.dataType, T.BinaryType) else F.date_format(c.name, "yyyy-MM-dd'T'HH:mm:ss").alias(c.name) if isinstance(c.dataType, T.TimestampType) else F.col(c.name) for c in df.schema])
    if kind == "csv":
        flat.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif kind == "json":
        flat.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        markdown_lines(flat).write.mode("overwrite").text(path)
    return path


def write_named(rows: DataFrame, root: str) -> str:
    """One text file under ``root`` for each row (path: its name with folders, value: its content), for layouts that other
    programs prescribe. Spark writes the contents, the driver only gives the files their names: some thousands of files
    are fine, for more a table is the better layout. Repeated paths keep the rows as lines of one file."""
    spark = rows.sparkSession
    rows.select("path", "value").repartition("path").write.partitionBy("path").text(f"{root}/.parts")
    java = spark.sparkContext._jvm
    place = lambda p: java.org.apache.hadoop.fs.Path(p)
    fs = place(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(place(f"{root}/.parts")):
        name = folder.getPath().getName()
        if name.startswith("path="):
            to = place(f"{root}/{urllib.parse.unquote(name[5:])}")
            fs.mkdirs(to.getParent())
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, to)
    fs.delete(place(f"{root}/.parts"), True)
    return root


def markdown_lines(df: DataFrame) -> DataFrame:
    """One text row per row of df as a Markdown table line, pipes escaped and line ends folded; the two head lines first.

    The head is a row of its own in the first partition, so the body stays parallel."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\\|", "\\\\|"), "\\s*\\n\\s*", " ")
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("value"))
    head = [("| " + " | ".join(df.columns) + " |",), ("|" + " --- |" * len(df.columns),)]
    return df.sparkSession.createDataFrame(head, "value string").coalesce(1).union(body)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Run events from ``threads/{thread}/runs/{run}.jsonl`` trees; lines that are not JSON objects are skipped."""
    raw = spark.read.schema(EVENT_SCHEMA + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path)
    place = F.regexp_extract("_metadata.file_path", "threads/([^/]+)/runs/([^/]+)\\.jsonl$", 1)
    run = F.regexp_extract("_metadata.file_path", "threads/([^/]+)/runs/([^/]+)\\.jsonl$", 2)
    fill = lambda c, x: F.coalesce(F.col(c), F.nullif(x, F.lit("")))
    return raw.withColumns({"thread_id": fill("thread_id", place), "run_id": fill("run_id", run)}).where("_bad is null and seq is not null").drop("_bad")


GRADING = "eval_id int, expectations array<struct<text:string,passed:boolean,evidence:string>>, summary struct<passed:int,failed:int,total:int,pass_rate:double>, execution_metrics struct<output_chars:long,total_tool_calls:long>, timing struct<total_duration_seconds:double,total_tokens:long>"


def read_benchmark_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of ``eval-N/<configuration>/run-K/grading.json`` with timing and eval ids from their sibling files.

    Time comes from the grading, else timing.json; tokens from the timing, else the characters put out; the eval id from
    eval_metadata.json, else the folder's number. Files that do not parse are skipped."""
    reader = lambda s, name: spark.read.schema(s).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    folder = lambda depth: F.regexp_extract("_metadata.file_path", "^(.*)" + "/[^/]+" * depth + "$", 1)
    runs = reader(GRADING, "grading.json").select("*", folder(1).alias("run_dir"), folder(3).alias("eval_dir")).where("summary is not null")
    timing = reader("total_duration_seconds double, total_tokens long", "timing.json").select(folder(1).alias("run_dir"), F.col("total_duration_seconds").alias("t_s"), F.col("total_tokens").alias("t_tok"))
    meta = reader("eval_id int", "eval_metadata.json").select(folder(1).alias("eval_dir"), F.col("eval_id").alias("m_id"))
    j = runs.join(timing, "run_dir", "left").join(meta, "eval_dir", "left")
    return j.select(
        F.coalesce("m_id", F.regexp_extract("eval_dir", "eval-(\\d+)$", 1).try_cast("int"), "eval_id").alias("eval_id"),
        F.regexp_extract("run_dir", "/([^/]+)/run-\\d+$", 1).alias("configuration"),
        F.regexp_extract("run_dir", "/run-(\\d+)$", 1).try_cast("int").alias("run_number"),
        F.col("summary.pass_rate").alias("pass_rate"),
        F.coalesce("timing.total_duration_seconds", "t_s", F.lit(0.0)).alias("time_seconds"),
        F.coalesce("timing.total_tokens", "t_tok", "execution_metrics.output_chars", F.lit(0)).alias("tokens"),
        "expectations",
    )


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Source files under path: path, language (by ending), size, text and summary (first three non-empty lines, 240
    characters); folders of dependencies, builds and caches are left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    ending = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    noise = "(^|/)(" + "|".join(map(re.escape, NOISE_DIRS)) + ")(/|$)"
    return raw.withColumn("language", known[ending]).where(F.col("language").isNotNull() & ~F.col("path").rlike(noise)).withColumn("summary", summary_lines("text"))


TASK_SCHEMA = "project_id string, task_id string, title string, status string, attempt_count int, max_attempts int, contexts array<struct<path:string,score:double>>, steps array<struct<name:string,status:string>>, created_at string"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*/task.json`` under path with its nested parts."""
    return spark.read.schema(TASK_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "task.json").json(path).where("task_id is not null")
