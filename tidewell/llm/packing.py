"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A bin never holds two pieces of one duplicate cluster, nor more than one piece of a source where ``by_source`` asks for
that. Documents longer than a bin are cut into full pieces, which fill bins alone, and a rest. The result has one row
per piece: doc_id, copy (number among rows that repeat the doc_id), piece, start and words (the piece's range in the
document), shard, bin, offset (first word in the bin). Documents without words are one empty piece in a bin of their
own shard. A null source conflicts with nothing; a null cluster is a cluster of its own. Ties go to the lower row
hash, doc_id and copy, so reruns agree; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import checkpointed, word_count

PACKED = "doc_id long, copy int, piece long, start long, words long, source string, cluster long, shard long, bin long, offset long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, placed in the given order. Sources and clusters are small ids, -1 for none.

    Open bins are kept in order of what they have left. The search starts at the least residual that the piece fits in
    and goes on to the next larger one until the bin's bitmaps of sources and clusters have no bit in common with it.
    """
    order: list[tuple[int, int]] = []
    left: list[int] = []
    held: list[tuple[int, int]] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]][0] & s or held[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            _, b = order.pop(at)
        else:
            b = len(left)
            left.append(capacity)
            held.append((0, 0))
        bins.append(b)
        offsets.append(capacity - left[b])
        left[b] -= size
        held[b] = (held[b][0] | s, held[b][1] | c)
        if left[b]:
            insort(order, (left[b], b))
    return bins, offsets


def _pack_shard(capacity: int, by_source: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "key", "doc_id", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable")
        source = pd.factorize(pdf["source"])[0] if by_source else [-1] * len(pdf)
        twice = pdf["cluster"].where(pdf.duplicated("cluster", keep=False) & pdf["cluster"].notna())
        pdf["bin"], pdf["offset"] = best_fit(pdf["words"].tolist(), list(source), pd.factorize(twice)[0].tolist(), capacity)
        return pdf.drop(columns=["key"])

    return pack


def pack(docs: DataFrame, capacity: int = 2048, shard: int = 4000, by_source: bool = True, cluster: str | None = None, seed: int = 29) -> DataFrame:
    """Pack ``docs`` (doc_id, text, source, ...); see the module docstring.

    ``cluster`` names a column of duplicate-cluster ids; without it, documents of equal text form one. Pieces are dealt
    at random to shards of about ``shard`` pieces, each packed by one task, so the work of a task is bounded and no
    source or cluster gathers in one place. Only ids and sizes are shuffled, never texts.
    """
    kind = F.xxhash64(F.col(cluster).cast("string")) if cluster else F.xxhash64("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        word_count("text").alias("size"),
        F.col("source").cast("string").alias("source"),
        F.when(F.col(cluster or "text").isNotNull(), kind).alias("cluster"),
    )
    rows = rows.withColumn("key", F.xxhash64("doc_id", "size", "cluster", F.lit(seed)))
    # equal rows are counted before they are numbered, so a row repeated very often meets in no window
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id", "key").orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("upto", upto).withColumn("copy", F.explode(F.sequence((F.col("upto") - F.col("n") + 1).cast("int"), F.col("upto").cast("int"))))
    rows = checkpointed(rows.drop("n", "upto"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("long"))))
    rows = rows.withColumn("start", F.col("piece") * capacity).withColumn("words", F.least(F.col("size") - F.col("start"), F.lit(capacity)))
    shards = max(1, round(rows.count() / shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "copy", "piece"), F.lit(shards)))
    rows = rows.select("doc_id", "copy", "piece", "start", "words", "source", "cluster", "shard", "key")
    return rows.groupBy("shard").applyInPandas(_pack_shard(capacity, by_source), PACKED)
