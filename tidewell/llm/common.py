"""Helpers shared by the corpus operators: reliable checkpoints, clash-free column picks, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.shared import BATCH_LIMITS, bounded  # noqa: F401

WORD = "[^\\x20\\x09-\\x0D]+"
WORDS = re.compile(r"[^\x20\t-\r]+")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for local sessions without it."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared checkpoint folder and read it back: its lineage ends there, so lost executors
    cost no recomputation, and later plans know its real size (``checkpoint()`` keeps the plan's estimate, which the joins
    of an iteration multiply round by round)."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: str | Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(doc_id: str, k: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(k))


def split_join(rows: DataFrame, table: DataFrame, key: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each key and in ``size`` the number of ``rows`` with that key.

    Keys with more than a thousandth of the ``total`` rows (256 at least) are at most a thousand, so their part of the
    table is broadcast and their rows stay where they are; all other keys meet in an ordinary join. No task gets a hot key."""
    most = max(256, total // 1000)
    hot, cold = table.where(F.col(size) > most), table.where(F.col(size) <= most)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def bit_array(rows: DataFrame, *columns: str, bits: int = 25) -> DataFrame:
    """Bits of the hashes of the columns' values as rows (word, mask): at most 2**(bits - 6) rows, however many values
    (half a million, or some 30 MB when broadcast)."""
    spot = rows.select(F.pmod(F.xxhash64(*columns), F.lit(1 << bits)).alias("p"))
    return spot.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("mask"))


def with_bit(rows: DataFrame, array: DataFrame, *columns: str, bits: int = 25, flag: str = "__bit") -> DataFrame:
    """``rows`` with a flag that is false only where no value of the array equals the row's. The array is broadcast: its
    size is bounded by its definition. Past some 10 million values more and more rows pass for nothing, none is lost."""
    p = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    j = rows.withColumn(flag, p).join(F.broadcast(array.withColumnRenamed("word", f"{flag}_w").withColumnRenamed("mask", f"{flag}_m")), F.shiftright(F.col(flag), 6) == F.col(f"{flag}_w"), "left")
    hit = F.expr(f"coalesce((shiftrightunsigned({flag}_m, cast({flag} & 63 as int)) & 1L) = 1L, false)")
    return j.withColumn(flag, hit).drop(f"{flag}_w", f"{flag}_m")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of an undirected graph given as edges (u, v): rows (node, root), root the least node.

    Alternates large-star and small-star steps until every node hangs on one root and no root on another. Each step
    takes the least neighbour by a grouped minimum (combined before the shuffle), writes it and joins it back with hot
    nodes split off. Every round is checkpointed. Self loops are dropped; nodes without edges do not appear.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    for _ in range(max_rounds):
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1 and hangs > 0").isEmpty():
            break
        n = e.count()
        near = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).withColumn("m", F.least("u", "m")))
        e = checkpointed(split_join(near.where("v > u"), low, "u", "size", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every node hangs its smaller neighbours on the least of them
        low = checkpointed(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")))
        hung = split_join(e, low, "u", "size", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = checkpointed(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
