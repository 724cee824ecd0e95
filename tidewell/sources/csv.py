"""CSV files whose cells hold line ends, read in splits.

A line end ends a record where the quotes before it are even in number. Each split counts its quotes; prefix sums over the splits
of a file tell whether a split begins inside a cell, and a running sum inside the split does the same for its lines. Lines that
are records of their own, nearly all, stay where they are; the lines of others meet by the line that opened them, across
splits as well.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.shared import written

OPTIONS = {"quote": '"', "escape": '"'}
# Types that a column may have, tried in order, with the form that its values must have.
TYPES = {
    "int": r"[+-]?\d{1,10}",
    "bigint": r"[+-]?\d{1,19}",
    "double": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?Infinity",
    "date": r"\d{4}-\d{2}-\d{2}",
    "timestamp": r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?",
    "boolean": r"(?i)true|false",
}


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, id, record) of every record of the CSV files under path, a file's in the order of at and id; empty lines are
    left out. Raises ValueError where a file's last quote is never closed."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    lines = raw.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    splits = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(lines.groupBy("file", "at").agg(F.sum("quotes").alias("n")))
    odd = sums.groupBy("file").agg(F.sum("n").alias("n")).where("n % 2 = 1").first()
    if odd:
        raise ValueError(f"{odd['file']}: a quote is never closed")
    sums = sums.select("file", "at", F.coalesce(F.sum("n").over(splits), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "at").orderBy("id")
    lines = lines.join(sums, ["file", "at"]).withColumn("upto", F.col("before") + F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumns({"open": (F.col("upto") - F.col("quotes")) % 2 == 1, "opens": F.col("upto") % 2 == 1})
    lines = lines.select("file", "at", "id", "value", "open", "opens", F.last(F.when(~F.col("open") & F.col("opens"), F.col("id")), True).over(inside).alias("opener"))
    alone = lines.where("not open and not opens").select("file", "at", "id", F.col("value").alias("record"))
    rest = written(lines.where("open or opens"))  # lines of records that go over line ends
    last = rest.groupBy("file", "at").agg(F.max("opener").alias("opener"))
    last = last.select("file", "at", F.last("opener", True).over(splits).alias("carried"))  # opened in an earlier split
    rest = rest.join(last, ["file", "at"]).withColumn("opener", F.coalesce("opener", "carried"))
    part = F.sort_array(F.collect_list(F.struct("at", "id", "value")))
    long = rest.groupBy("file", F.col("opener").alias("id")).agg(F.min("at").alias("at"), F.array_join(F.transform(part, lambda x: x["value"]), "\n").alias("record"))
    every = alone.unionByName(long).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return every.where("record <> ''")


def inferred(df: DataFrame) -> T.StructType:
    """The schema of a table of strings: each column's first type of TYPES that all its values have, by one pass."""
    fits = lambda c, t, form: F.count_if(F.col(c).isNotNull() & ~F.coalesce(F.col(c).rlike(f"^({form})$") & F.col(c).try_cast(t).isNotNull(), F.lit(False))) == 0
    tests = [F.struct(F.count(c).alias("some"), *[fits(c, t, form).alias(t) for t, form in TYPES.items()]).alias(f"c{i}") for i, c in enumerate(df.columns)]
    found = df.agg(*tests).first()
    kind = lambda r: next((t for t in TYPES if r[t]), "string") if r["some"] else "string"
    return T.StructType([T.StructField(c, T._parse_datatype_string(kind(r))) for c, r in zip(df.columns, found)])


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The table of CSV files under path, each with the same header. Without a schema the types are inferred from all values.
    Quotes in cells are doubled; empty cells are null, quoted or not; cells may hold line ends. The records are put together
    once and written: heads, inference and the table itself read them back."""
    r = written(records(spark, path))
    heads = r.where("at = 0").groupBy("file").agg(F.min("id").alias("first"), F.min_by("record", "id").alias("head"))
    heads = written(heads)
    one = heads.agg(F.min("head")).first()[0]
    if one is None:
        return spark.createDataFrame([], schema or T.StructType())
    names = next(csv.reader([one.removeprefix("\ufeff")]))
    body = r.join(heads, (r["file"] == heads["file"]) & (r["id"] == heads["first"]), "left_anti").select("record")
    strings = T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(names)])
    parsed = lambda shape: body.select(F.from_csv("record", _ddl(shape), OPTIONS).alias("r")).select("r.*")
    if schema is None:
        schema = inferred(parsed(strings))
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return parsed(schema)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
