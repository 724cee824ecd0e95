"""Running sums, row numbers and ranks inside keys of any size, and the smallest rows of a stratum without sorting it.

A window over a key is one task. :func:`running` leaves keys of ordinary size to windows and takes the rows of large keys
apart by ranges of their order: a block is one partition of a range shuffle, block sums give each block's offset, and
windows work inside blocks alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.shared import written


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of a's keys and b's, which are named with a leading underscore."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"_{k}"])
    return cond


def large_keys(df: DataFrame, keys: list[str], large: int) -> tuple[DataFrame, int]:
    """The keys (named with a leading underscore) with more than ``large`` rows, or a thousandth of all where that is more: a
    thousand at most. And the number of their rows, 0 if there are none."""
    counts = written(df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("n")))
    most = max(large, (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // 1000)
    hot = counts.where(F.col("n") > most)
    return hot.drop("n"), hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def blocks(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """df with block: its partition of n by ranges of key and order. Rows equal in both share a block. Written, so that a lost
    executor does not number the blocks anew."""
    return written(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("block", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, rank: str | None = None, ties: bool = False, large: int = 1_000_000) -> DataFrame:
    """df with running sums inside each key by ``order``: name -> summed column; rows of equal order share the sum where
    ``ties``, else they follow one another. ``rank`` names a column for the rank by the same order.

    Keys with more than ``large`` rows are worked on in blocks of about a quarter of that. Columns of df named block are
    lost; other columns stay."""
    sums = sums or {}

    def windows(d: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order)
        frame = w if ties else w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        made = {n: F.sum(c).over(frame) for n, c in sums.items()}
        return d.withColumns(made | ({rank: F.rank().over(w)} if rank else {}))

    hot, rows = large_keys(df, keys, large)
    if not rows:
        return windows(df, keys)
    cold = windows(df.join(F.broadcast(hot), _same(df, hot, keys), "left_anti"), keys)
    inside = df.join(F.broadcast(hot), _same(df, hot, keys), "left_semi")
    cut = blocks(inside, keys, order, 1 + 4 * rows // large)
    total = cut.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("block").alias("_block")).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    names = ["_rows", *[f"_{n}" for n in sums]]
    # a key has as many rows here as blocks
    start = written(total.select(*[f"_{k}" for k in keys], "_block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names]))
    done = windows(cut, [*keys, "block"])
    done = done.join(start, _same(done, start, keys) & (done["block"] == start["_block"]))
    after = {n: F.col(n) + F.col(f"_{n}") for n in sums} | ({rank: (F.col(rank) + F.col("_rows")).cast("int")} if rank else {})
    return cold.unionByName(done.withColumns(after).select(*cold.columns))


def streaks(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, large: int = 1_000_000) -> DataFrame:
    """df with ``name``: how many rows inside each key have followed one another by ``order`` with one ``value``, a row itself
    included; 0 where the value is null, which also ends a streak. Keys with more than ``large`` rows are worked on in
    blocks: a streak that ends a block goes on into the next one by the place of its first row."""
    v = F.col(value)

    def windows(d: DataFrame, part: list[str]) -> DataFrame:
        """With _row, the row's number, and _first, that of its streak's first row."""
        w = Window.partitionBy(*part).orderBy(*order)
        d = d.withColumns({"_row": F.row_number().over(w), "_same": F.coalesce(F.lag(v).over(w) == v, F.lit(False))})
        # by row number, as rows of equal order must not change places between the windows
        by_row = Window.partitionBy(*part).orderBy("_row")
        return d.withColumn("_first", F.max(F.when(~F.col("_same"), F.col("_row"))).over(by_row))

    length = F.when(v.isNotNull(), F.col("_row") - F.col("_first") + 1).otherwise(0).cast("int").alias(name)
    hot, rows = large_keys(df, keys, large)
    if not rows:
        return windows(df, keys).select(*df.columns, length)
    cold = windows(df.join(F.broadcast(hot), _same(df, hot, keys), "left_anti"), keys).select(*df.columns, length)
    inside = df.join(F.broadcast(hot), _same(df, hot, keys), "left_semi")
    # rows of equal order must keep their places, so what the windows made is written
    cut = written(windows(blocks(inside, keys, order, 1 + 4 * rows // large), [*keys, "block"]))
    ends = cut.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("block").alias("_block")).agg(
        F.count("*").alias("_rows"), F.min_by(v, "_row").alias("_head"), F.max_by(v, "_row").alias("_tail"), F.max("_first").alias("_last"))
    # a key has as many rows here as blocks
    w = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_block")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_on": F.coalesce(F.lag("_tail").over(w) == F.col("_head"), F.lit(False))})
    # a block that is one streak and goes on with the one before starts none of its own
    ends = ends.withColumn("_begun", F.when(~(F.col("_on") & (F.col("_last") == 1)), F.col("_before") + F.col("_last")))
    ends = written(ends.withColumn("_begun", F.max("_begun").over(earlier)).select(*[f"_{k}" for k in keys], "_block", "_before", "_on", "_begun"))
    done = cut.join(ends, _same(cut, ends, keys) & (cut["block"] == ends["_block"]))
    goes_on = F.col("_on") & (F.col("_first") == 1)
    done = done.withColumn("_first", F.when(goes_on, F.col("_begun")).otherwise(F.col("_before") + F.col("_first"))).withColumn("_row", F.col("_before") + F.col("_row"))
    return cold.unionByName(done.select(*df.columns, length))


def first_of_strata(df: DataFrame, stratum: str, spot: Column, wanted: Column, flag: str, digits: int = 4) -> DataFrame:
    """df with ``flag``: whether a row is among the first of its stratum by ``spot`` (a hex text of even spread, such as a digest;
    ties by order of the rest of it), of which there are ``wanted`` (a function of the stratum's row count n).

    Counts by the first ``digits`` of spot tell in which of their buckets a stratum's last row lies; only that bucket, a
    65,536th of the stratum for four, is ranked."""
    r = df.withColumn("_spot", spot).withColumn("_bucket", F.left("_spot", F.lit(digits)))
    counts = r.groupBy(F.col(stratum).alias("_stratum"), F.col("_bucket").alias("_cut")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_stratum")
    c = counts.withColumns({"n": F.sum("_n").over(w), "_before": F.sum("_n").over(w.orderBy("_cut")) - F.col("_n")}).withColumn("_left", wanted - F.col("_before"))
    cuts = written(c.where("_left > 0 and _left <= _n").select("_stratum", "_cut", "_left"))  # one row a stratum
    met = F.broadcast(cuts) if cuts.count() <= 100_000 else cuts
    j = r.join(met, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    at = F.col("_bucket") == F.col("_cut")
    clear = j.where(~F.coalesce(at, F.lit(False))).withColumn(flag, F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_spot"))
    ranked = j.where(at).withColumn(flag, place <= F.col("_left"))
    return clear.select(*df.columns, flag).unionByName(ranked.select(*df.columns, flag))
