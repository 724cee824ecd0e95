"""Profiling and reporting over any table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import scan
from tidewell.sources.shared import written


def numeric_columns(df: DataFrame) -> list[str]:
    return [c.name for c in df.schema if isinstance(c.dataType, T.NumericType)]


def inspect(df: DataFrame) -> DataFrame:
    """Per column: column_name, data_type, nullable, non_null and row_count, from one aggregate pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.lit(c.dataType.simpleString()).alias("data_type"), F.lit(c.nullable).alias("nullable"), F.col(f"c{i}").alias("non_null")) for i, c in enumerate(df.schema)])
    return counts.select("n", F.inline(cells)).withColumnRenamed("n", "row_count")


def rewrite_names(sql: str, names: dict[str, str]) -> str:
    """SQL with original table names replaced by their sanitised ones, longest first."""
    for old in sorted(names, key=len, reverse=True):
        if old != names[old]:
            sql = re.sub(rf'"{re.escape(old)}"|(?<![\w"]){re.escape(old)}(?![\w"])', names[old], sql)
    return sql


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], names: dict[str, str] | None = None) -> DataFrame:
    """Any SELECT over the given tables; double quotes may name columns. Errors list the tables there are."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    text = rewrite_names(sql, names or {})
    if '"' in text:
        text = re.sub(r'"([^"]+)"', r"`\1`", text)
    try:
        return spark.sql(text)
    except Exception as e:
        raise ValueError(f"{e}\nTables: {', '.join(sorted(tables))}") from e


def quantiles(rows: DataFrame, key: str, value: str, at: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int = 10_000, keys: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles of ``value`` (double, nulls dropped) for each ``key``: key, n and q (array).

    A first pass brackets each quantile between approximate ones; a second counts what lies below each bracket and the
    values inside it, of which there are a few ten-thousandths, and picks the two neighbours of the exact rank from their
    counts. So no buffer ever holds all values. The brackets are written once, and broadcast if there are at most ``keys`` keys."""
    rows = rows.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))
    near = [p for q in at for p in (max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy))]
    first = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", near, accuracy).alias("p"))
    rank = lambda q: F.lit(q) * (F.col("n") - 1)
    few = F.col("n") <= 4 * accuracy  # too few for a bracket to hold both neighbours of the rank for sure: all values are inside
    ends = F.array(*[F.struct(F.lit(i).alias("i"), rank(q).alias("rank"), F.when(few, F.col("least")).otherwise(F.col("p")[2 * i]).alias("a"), F.when(few, F.col("most")).otherwise(F.col("p")[2 * i + 1]).alias("b")) for i, q in enumerate(at)])
    brackets = written(first.select(key, "n", F.inline(ends)))
    small = brackets.count() <= keys * len(at)
    j = rows.join(F.broadcast(brackets) if small else brackets, key).where("x <= b")
    counts = j.groupBy(key, "i", F.when(F.col("x") >= F.col("a"), F.col("x")).alias("v")).agg(F.count("*").alias("c"))  # null: all below the bracket
    upto = F.sum("c").over(Window.partitionBy(key, "i").orderBy(F.asc_nulls_first("v")))
    held = counts.withColumn("upto", upto).join(F.broadcast(brackets) if small else brackets, [key, "i"])
    low, high = F.floor("rank"), F.ceil("rank")
    ranked = held.where(F.col("v").isNotNull()).groupBy(key, "n", "i", "rank").agg(F.min(F.when(F.col("upto") > low, F.col("v"))).alias("lo"), F.min(F.when(F.col("upto") > high, F.col("v"))).alias("hi"))
    share = F.col("rank") - low
    one = F.struct("i", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - share) * F.col("lo") + share * F.col("hi")).alias("q"))
    return ranked.groupBy(key, "n").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["q"]).alias("q"))


def summary_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, stddev, min, q25, median, q75, max, nulls. Quantiles interpolate and are exact."""
    cols = columns or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x.isNull()).alias("nulls")).alias(f"s{i}"))
    s = df.agg(*aggs).select(F.inline(F.array(*[f"s{i}" for i in range(len(cols))])))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])))
    q = quantiles(long, "column_name", "x").select("column_name", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
    return s.join(q, "column_name", "left").select("column_name", "count", "mean", "stddev", "min", "q25", "median", "q75", "max", "nulls")


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def summary_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count, distinct, mode (least value on ties) and nulls, by one unpivot and grouped counts."""
    g = _long(df, columns)
    some = F.col("value").isNotNull()
    top = g.where(some).groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("m"))
    out = g.groupBy("column_name").agg(F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("count"), F.count_if(some).alias("distinct"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("nulls"))
    return out.join(top, "column_name", "left").select("column_name", "count", "distinct", F.col("m.value").alias("mode"), "nulls")


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent non-null values per column with their percent of all rows; ties by value."""
    total = df.agg(F.count("*").alias("rows"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    g = _long(df, columns).where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return g.join(F.broadcast(total)).select("column_name", "value", "n", F.round(100.0 * F.col("n") / F.col("rows"), 2).alias("percent"), "rank")


def group_by_month(df: DataFrame, category: str, ts: str, amount: str) -> DataFrame:
    return df.groupBy(F.col(category).alias("category"), F.trunc(ts, "month").alias("month")).agg(F.round(F.sum(amount), 2).alias("total"), F.count("*").alias("n"))


def pivot_months(df: DataFrame, category: str, ts: str, amount: str, months: list[str]) -> DataFrame:
    """One row per category, one column per month of the fixed list."""
    m = F.date_format(ts, "yyyy-MM")
    return df.groupBy(F.col(category).alias("category")).agg(*[F.round(F.coalesce(F.sum(F.when(m == x, F.col(amount))), F.lit(0.0)), 2).alias("m" + x.replace("-", "_")) for x in months])


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"), F.count("*").alias("n"))


def running_total_and_rank(df: DataFrame, key: str, order: str, amount: str, large: int = 1_000_000) -> DataFrame:
    """Running sum by date inside each key (rows of one date share it) and rank by amount, highest first. Keys of over
    ``large`` rows are scanned in blocks."""
    summed = scan.running(df, [key], [F.col(order)], {"running": F.col(amount)}, ties=True, large=large)
    return scan.running(summed.withColumn("running", F.round("running", 2)), [key], [F.desc(amount)], rank="rank", large=large)


def top_totals(df: DataFrame, name: str, amount: Column, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(name).alias("name")).agg(F.round(F.sum(amount), 2).alias("total")).orderBy(F.desc("total"), "name").limit(k)


# ---- chart feeds -------------------------------------------------------------------------------------------------


def time_series(df: DataFrame, group: str, ts: str, unit: str = "day") -> DataFrame:
    """Counts per group and time on the same times for all groups, gaps filled with 0, ISO labels."""
    t = df.select(F.col(group).alias("group"), F.date_trunc(unit, ts).cast("date").alias("t"))
    counts = t.groupBy("group", "t").agg(F.count("*").alias("n"))
    ends = t.groupBy("group").agg(F.lit(1).alias("one")).drop("one")
    span = t.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select(F.explode(F.expr(f"sequence(lo, hi, interval 1 {unit})")).alias("t"))
    grid = ends.join(F.broadcast(span))
    return grid.join(counts, ["group", "t"], "left").select("group", F.date_format("t", "yyyy-MM-dd").alias("time"), F.coalesce("n", F.lit(0)).alias("value"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the least and the largest value, nulls dropped; the largest value is in the last bin."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = x.join(F.broadcast(ends)).withColumn("bin", F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).cast("int"))
    return j.groupBy("bin").agg(F.count("*").alias("n"), F.first(F.col("lo")).alias("lo"), F.first(F.col("hi")).alias("hi")).select("bin", "n", F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins, 6).alias("bin_start"))


def box(df: DataFrame, category: str, value: str, least: int = 5) -> DataFrame:
    """Five numbers and the count of outliers (beyond 1.5 interquartile ranges) per category with enough samples. Rows
    without a category are left out."""
    rows = df.select(F.col(category).alias("category"), F.col(value).cast("double").alias("v")).where("v is not null and category is not null")
    q = quantiles(rows, "category", "v").where(F.col("n") >= least).select("category", "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
    far = 1.5 * (F.col("q75") - F.col("q25"))
    beyond = (F.col("v") < F.col("q25") - far) | (F.col("v") > F.col("q75") + far)
    return rows.join(q, "category").groupBy("category", "n", "q25", "median", "q75").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(beyond).alias("outliers"))


def pie(df: DataFrame, category: str, keep: int = 6) -> DataFrame:
    """Share per category; beyond ``keep`` categories the smallest ones fold into ``other``."""
    g = df.groupBy(F.col(category).cast("string").alias("category")).agg(F.count("*").alias("n"))
    top = g.orderBy(F.desc("n"), F.asc_nulls_last("category")).limit(keep - 1).select(F.col("category").alias("c"), F.lit(True).alias("top"))
    j = g.join(F.broadcast(top), g["category"].eqNullSafe(top["c"]), "left").join(F.broadcast(g.agg(F.count("*").alias("k"))))
    name = F.when((F.col("k") > keep) & F.col("top").isNull(), "other").otherwise(F.col("category"))
    out = j.groupBy(name.alias("category")).agg(F.sum("n").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def bars(df: DataFrame, category: str, group: str, keep: int = 12) -> DataFrame:
    """Counts per category and group for the ``keep`` largest categories."""
    g = df.groupBy(F.col(category).alias("category"), F.col(group).alias("group")).agg(F.count("*").alias("n"))
    top = g.groupBy("category").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "category").limit(keep)
    return g.join(top, "category", "left_semi")


def flows(edges: DataFrame, nodes: DataFrame, source: str, target: str, least: int) -> DataFrame:
    """Flow per (source, target) of at least ``least``, both ends among the nodes (column ``node``)."""
    g = edges.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    n = nodes.select("node")
    return g.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi")


def treemap(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Sums of non-negative leaf values for every level; a parent is the sum of its children."""
    return df.where(F.col(value) >= 0).rollup(*levels).agg(F.round(F.sum(value), 2).alias("value"), F.grouping_id().alias("level"))


def word_cloud(df: DataFrame, text: str, stop: list[str], synonyms: dict[str, str], k: int = 50) -> DataFrame:
    """Counts of case-folded words without stop words, synonyms merged; the k most frequent."""
    w = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("word"))
    if synonyms:
        w = w.replace(synonyms, subset=["word"])
    return w.where(~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def standardised(df: DataFrame, key: str, value: str, share: float = 1.0, seed: int = 0) -> DataFrame:
    """z score and min-max value of a hash sample of rows; the statistics cover all rows."""
    v = F.col(value).cast("double")
    s = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    kept = df if share >= 1 else df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    j = kept.join(F.broadcast(s))
    return j.select(key, F.round((v - F.col("m")) / F.col("s"), 6).alias("z"), F.round((v - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("unit"))


def funnel(df: DataFrame, stage: str, stages: list[str]) -> DataFrame:
    """Counts per stage in the given order with the conversion from the first and from the previous stage."""
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    g = df.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n")).withColumn("pos", order[F.col("stage")]).where("pos is not null")
    w = Window.orderBy("pos")
    return g.select("stage", "pos", "n", F.round(F.col("n") / F.first("n").over(w), 6).alias("of_first"), F.round(F.col("n") / F.coalesce(F.lag("n").over(w), F.col("n")), 6).alias("of_previous"))


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two series (key, value) on one list of keys."""
    return a.withColumnRenamed("value", "left_value").join(b.withColumnRenamed("value", "right_value"), key, "full_outer")


def venn(df: DataFrame, member: str, group: str, groups: list[str]) -> DataFrame:
    """Size of every combination of at most four sets, as flags per member, so no member's sets are gathered in a list."""
    flags = df.groupBy(member).agg(*[F.max((F.col(group) == g).cast("int")).alias(f"in_{i}") for i, g in enumerate(groups)])
    names = F.concat_ws("&", *[F.when(F.col(f"in_{i}") == 1, F.lit(g)) for i, g in enumerate(groups)])
    return flags.groupBy(names.alias("sets")).agg(F.count("*").alias("n")).where("sets <> ''")


def cross_tab(df: DataFrame, row: str, column: str, values: list, amount: str) -> DataFrame:
    return df.groupBy(F.col(row).alias("row")).agg(*[F.round(F.coalesce(F.sum(F.when(F.col(column) == v, F.col(amount))), F.lit(0.0)), 2).alias(f"c_{v}") for v in values])
