"""Exact top-k search over binary codes by incremental multi-index hashing, in DataFrame functions only.

:func:`top_k` returns, for each query row, the k other rows nearest by Hamming distance: query_id, rank (from 1),
vec_id, distance. Ties go to the lower vec_id. A row never answers its own query. Rows with a null id or code are
neither indexed nor asked; fewer than k other rows give fewer results; repeated rows (same id and code) count once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import checkpointed


def sign_code(vector: str) -> Column:
    """64-bit code of a vector's first 64 signs (a positive element sets its bit; null elements do not); null for null."""
    bit = lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(0).cast("long"))
    return F.aggregate(F.slice(F.col(vector), 1, 64), F.lit(0).cast("long"), bit)


def segments(rows: int, bits: int = 64, bucket: int = 8, widest: int = 22) -> list[tuple[int, int]]:
    """(shift, width) of the code's segments, each about log2(rows / bucket) bits wide: a bucket holds about ``bucket``
    codes, which travel as one array, so a query needs fewer probes than with a code for each. Beyond ``widest`` bits
    buckets grow instead, as the number of probes at a radius grows with its power of the width."""
    m = max(2, round(bits / min(widest, max(8.0, math.log2(max(rows, 2) / bucket)))))
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(code: str, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(code), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def probes(waiting: DataFrame, parts: list[tuple[int, int]], low: int, high: int) -> DataFrame:
    """Rows (q, bound, seg, value) of all segment values whose distance from the query's is between low and high.

    A mask of r bits is one of r - 1 with a higher bit added, so masks come from exploded bit numbers, one at a time: no
    list of masks is ever held, however wide the segment."""
    own = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(w).alias("width"), _segment("q", a, w).alias("value")) for i, (a, w) in enumerate(parts)])
    at = waiting.select("q", "bound", F.inline(own)).withColumn("next", F.lit(0))
    found = [at] if low == 0 else []
    for r in range(1, high + 1):
        at = at.where("next < width").withColumn("b", F.explode(F.expr("sequence(next, width - 1)")))
        at = at.select("q", "bound", "seg", "width", F.expr("value ^ shiftleft(1L, b)").alias("value"), (F.col("b") + 1).alias("next"))
        if r >= low:
            found.append(at)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select("q", "bound", "seg", "value")


def _ordered(by: str, *order: str):
    return Window.partitionBy(by).orderBy(*order)


def _met(df: DataFrame) -> DataFrame:
    """A side of a join by sorting: the tables here grow with the input, and Spark would broadcast them, over the driver, where their
    compressed files seem small."""
    return df.hint("merge")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, chunk: int = 4096) -> DataFrame:
    """Nearest ``k`` of ``rows`` (vec_id, code) for each of ``queries`` (vec_id, code); see the module docstring.

    Codes are indexed once each with the k + 1 lowest ids that carry them, which is all a top-k can use, so very common
    vectors cost nothing extra. Round s probes every segment at radius s. After it, every code within m(s+1)-1 bits has
    been seen (m segments): queries whose kth distance is within that are done, the others go on to the next round with
    the distance they already have as a bound. The first round takes radii 0 and 1 together.
    A bucket's codes travel as arrays, verified where they are joined. Buckets of more than a thousandth of all entries
    (``chunk`` at least), so at most a thousand, are cut into parts of about ``chunk`` codes, and probes of them meet each.
    """
    rows = rows.where("vec_id is not null and code is not null").select("vec_id", "code")
    ids = rows.distinct().withColumn("n", F.row_number().over(_ordered("code", "vec_id"))).where(F.col("n") <= k + 1)
    codes = checkpointed(ids.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    distinct = codes.count()
    parts = segments(distinct, bits)
    asked = queries.where("vec_id is not null and code is not null").select(F.col("code").alias("q")).distinct()
    entries = codes.select("code", F.posexplode(F.array(*[_segment("code", a, w) for a, w in parts])).alias("seg", "value"))
    hot = entries.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > max(chunk, distinct * len(parts) // 1000))
    hot = checkpointed(hot.select("seg", "value", F.ceil(F.col("n") / chunk).cast("int").alias("cuts")))
    cuts = F.coalesce("cuts", F.lit(1))
    index = entries.join(F.broadcast(hot), ["seg", "value"], "left").withColumn("part", F.pmod(F.xxhash64("code"), cuts).cast("int"))
    index = checkpointed(index.groupBy("seg", "value", "part").agg(F.collect_list("code").alias("bucket")))
    waiting, found, best = checkpointed(asked.withColumn("bound", F.lit(bits))), [], None
    for low, s in [(0, 1)] + [(r, r) for r in range(2, max(w for _, w in parts) + 1)]:
        probe = probes(waiting, parts, low, s).join(F.broadcast(hot), ["seg", "value"], "left")
        probe = probe.withColumn("part", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("cuts")
        close = F.filter("bucket", lambda c: F.bit_count(F.col("q").bitwiseXOR(c)) <= F.col("bound"))
        near = probe.join(_met(index), ["seg", "value", "part"]).select("q", F.explode(close).alias("code"))
        near = near.select("q", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"), "code")
        near = (near if best is None else near.unionByName(best.drop("upto").join(_met(waiting), "q", "left_semi"))).distinct().join(_met(codes), "code")
        sums = {c: F.sum(F.size("ids")).over(_ordered("q", "distance").rangeBetween(Window.unboundedPreceding, r)) for c, r in (("before", -1), ("upto", 0))}
        near = near.withColumns(sums).where(F.coalesce("before", F.lit(0)) <= k)  # ties at the last distance all stay
        best = checkpointed(near.select("q", "distance", "code", "upto"))
        proven = len(parts) * (s + 1) - 1
        state = waiting.join(_met(best.groupBy("q").agg(F.max(F.when(F.col("distance") <= proven, F.col("upto"))).alias("sure"), F.max("upto").alias("have"), F.max("distance").alias("last"))), "q", "left")
        state = checkpointed(state.withColumn("ready", (F.coalesce("sure", F.lit(0)) > k) | F.lit(proven >= bits)))
        found.append(best.select("q", "distance", "code").join(_met(state.where("ready").select("q")), "q", "left_semi"))
        waiting = state.where("not ready").select("q", F.when(F.col("have") > k, F.col("last")).otherwise(F.lit(bits)).alias("bound"))
        if waiting.isEmpty():
            break
    answers = found[0]
    for more in found[1:]:
        answers = answers.unionByName(more)
    answers = answers.join(_met(codes), "code").select("q", "distance", F.explode("ids").alias("vec_id"))
    asks = queries.where("vec_id is not null and code is not null").select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).distinct()
    hits = answers.join(_met(asks), "q").where("query_id <> vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(_ordered("query_id", "distance", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))
