"""Mixing sources to target weights by hash-random order and distributed prefix sums of word counts.

:func:`mix` returns one row per document: doc_id, size, source_size, target, taken, rank_words (words of the source
that come before the document in its random order; null sizes count 0).

Sources go by code point order, null last, and take the weights in turn. Together they are to share ``share`` times all
words; no source's target exceeds ``repeat_limit`` times its own words, and what is cut off is shared again among the
others by weight. A source takes whole epochs of its documents and then, in hash-random order, documents up to its exact
(floored) target; the document at the cut is taken in part. Ties in the random key are broken by doc_id, then by size,
so repeated rows share one order and reruns agree. Empty tables give no rows; documents without words take 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import bit_array, checkpointed, with_bit, word_count

WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat_limit: int = 2) -> DataFrame:
    """Each source's target from (source, source_size, docs): water filling in closed form.

    With ratio = repeat_limit x size / weight, sources fill up in order of that ratio. Going through them in that order
    the first k are full exactly if each one's ratio is under the level that the rest would get.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.get(table, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(repeat_limit)))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("before")) / F.col("rest"))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("before"), F.col("level")))).over(every)["level"]
    return s.select("source", "source_size", "docs", F.coalesce(F.least("limit", level * F.col("weight")), F.col("limit")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat_limit: int = 2, run: int = 1000, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """Words taken from every document; see the module docstring. Columns named in ``carry`` come along.

    Every source's hash range is divided into buckets of about ``run`` documents, or the square root of its documents
    where that is more. Bucket sums give each bucket's offset, a window inside the bucket gives the offset within it, so
    neither a hot source nor the whole order ever meets in one task. Keys come from id and text; rows equal in both are one
    row with a number until the end. Texts are read once and never shuffled.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    key = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), key, *carry)
    rows = checkpointed(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    per_source = checkpointed(targets(sizes, weights, share, repeat_limit))
    per_source = per_source.withColumn("buckets", F.ceil(F.col("docs") / F.greatest(F.lit(float(run)), F.sqrt("docs"))).cast("long"))
    spot = F.shiftright(F.col("key") * F.col("buckets"), 32)
    rows = rows.join(per_source, rows["source"].eqNullSafe(per_source["source"])).drop(per_source["source"]).withColumn("bucket", spot)
    words = F.col("size") * F.col("n")
    sums = rows.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("within", F.sum(words).over(inside) - words)
    placed = placed.join(sums, placed["source"].eqNullSafe(sums["s"]) & (placed["bucket"] == sums["b"]))
    placed = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = placed.withColumn("rank_words", F.col("start") + F.col("within") + F.col("i") * F.col("size"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    left = budget - epochs * F.col("source_size") - F.col("rank_words")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(left, F.lit(0)))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "rank_words", *carry)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: a row for each whole time that a document is taken, and one cut to the words of the part taken.

    Documents without words carry none and stay once. Every row counts for itself, also where rows share a doc_id or have
    none; rows equal in all columns are told apart only by their number. n_chars, where present, follows the text. Rows
    of which nothing is taken are dropped, by a bit array of the others, before texts are shuffled.
    """
    row = ["hash_a", "hash_b"]  # two hashes of all columns, as one of 64 bits is not enough for very many rows
    names = [F.col(f"`{c}`") for c in docs.columns]
    # the row travels as one struct, so no name of its columns can meet one used here
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64(*names).alias("hash_a"), F.xxhash64(F.lit(1), *names).alias("hash_b"))
    own = mix(docs.select("doc_id", "text", "source", F.xxhash64(*names).alias("hash_a"), F.xxhash64(F.lit(1), *names).alias("hash_b")), carry=tuple(row), **options)
    whole = F.sum(F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(1)).cast("int").alias("whole")
    part = F.sum(F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)).alias("part")  # a source is cut in one row
    own = checkpointed(own.where("taken > 0 or size = 0").groupBy(*row).agg(whole, part))
    j = with_bit(rows, bit_array(own, "hash_a"), "hash_a").where("__bit").drop("__bit").dropDuplicates(row).join(own, row)
    cut = F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>"))
    j = j.select("row", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole")), cut)).alias("copy"))
    at = lambda c: F.col("row").getField(c)
    words = F.regexp_extract_all(at("text"), F.lit("([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+)"), F.lit(1))
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("copy"), F.lit(1)).cast("int")), "")
    j = j.withColumn("text", F.when(F.col("copy") < 0, at("text")).otherwise(head))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("copy") < 0, at("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return j.select(*[made.get(c, at(c)).alias(c) for c in docs.columns])
