"""SimHash near-duplicates by covering locality-sensitive hashing.

:func:`near_copies` gives for each row doc_id, fingerprint (16 lowercase hex digits) and component_id: the smallest doc_id
reachable over links between fingerprints that differ in at most ``radius`` bits, its own included.

A text is lower-cased in A-Z alone and taken apart at ASCII white space; its shingles are ``words`` consecutive words
joined by one space, repeats included (a shorter text is one shingle). A fingerprint bit is 1 if it is set in more than half
of the shingles' XXH64 (seed 42). A null text and one without words have fingerprint zero, which links like any other.
Every row is a document of its own, also where rows share a doc_id; a row without doc_id counts in no minimum, and
component_id is null where no row of its component has one. Extra columns are ignored. An empty table gives no rows.

The tables: bit i has one of the 2**(radius + 1) - 1 nonzero vectors of radius + 1 bits, and table v keeps the bits whose
vector has an odd product with v. Any ``radius`` bits have vectors that do not span the space, so some v is orthogonal to
them all: two fingerprints that differ in those bits alone agree on everything that table v keeps. No pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bit_array, bounded, checkpointed, components, split_join, with_bit

BITS, SEED = 64, 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of a text's word shingles, in any number of them: bits are counted in slices."""
    parts = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space alone
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - [len(p) + 1 for p in parts]).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1 :] or ends[-1:]
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, n, 4096):
        h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[lo : min(n, lo + 4096)], last[lo : lo + 4096])], "<u8")
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks of kept bits, one for each table: whatever ``radius`` bits are chosen, some mask keeps none of them."""
    tables = (1 << (radius + 1)) - 1
    vector = [1 + i % tables for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; no shuffle."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pdf[["doc_id"]].copy()
            made["fp"] = np.array([_signed(fingerprint(t, words)) for t in pdf["text"]], np.int64)
            yield made

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(texts).mapInPandas(sign, "doc_id long, fp long")


def _cross_links(members: DataFrame, comps: DataFrame, radius: int, block: int, most: int) -> DataFrame | None:
    """Links between different components within the buckets: (comp, near: other components, at most ``most``, more).

    In a bucket only the members outside its largest component are compared, with all its members: pairs inside the
    largest have nothing to add. Both sides are cut by hash into parts of about ``block``; a part of members is one array."""
    placed = members.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    per = placed.groupBy("t", "key", "comp").agg(F.count("*").alias("m"))
    open_ = per.groupBy("t", "key").agg(F.max_by("comp", F.struct("m", "comp")).alias("big"), F.max("m").alias("inside"), F.sum("m").alias("size")).where("inside < size")
    open_ = checkpointed(open_.select("t", "key", "big", "size", F.ceil(F.col("size") / block).cast("int").alias("cols"), F.ceil((F.col("size") - F.col("inside")) / block).cast("int").alias("rows")))
    total = open_.agg(F.sum("size")).first()[0]
    if total is None:
        return None
    placed = checkpointed(split_join(with_bit(placed, bit_array(open_, "t", "key"), "t", "key").where("__bit").drop("__bit"), open_, ["t", "key"], "size", total))
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    cells = placed.withColumn("col", part("cols")).groupBy("t", "key", "col").agg(F.collect_list(F.struct("fp", "comp")).alias("cell"), F.first("rows").alias("rows"))
    cells = cells.withColumn("row", every("rows")).drop("rows")
    outer = placed.where("comp <> big").withColumn("row", part("rows")).withColumn("col", every("cols")).select("t", "key", "row", "col", "fp", "comp")
    near = F.filter("cell", lambda x: (x["comp"] != F.col("comp")) & (F.bit_count(x["fp"].bitwiseXOR(F.col("fp"))) <= radius))
    met = outer.join(cells, ["t", "key", "row", "col"]).select("comp", F.array_distinct(F.transform(near, lambda x: x["comp"])).alias("near")).where(F.size("near") > 0)
    return checkpointed(met.select("comp", F.slice("near", 1, most).alias("near"), (F.size("near") > most).alias("more")))


def classes(fps: DataFrame, radius: int = 4, block: int = 1024, most: int = 8) -> DataFrame:
    """(fp, comp) of the fingerprints (fp distinct, copies) that are linked to others, comp the least of their component.

    Buckets of the covering tables with two fingerprints and more first give a star around their commonest one. What
    the stars leave apart is compared bucket by bucket, and each member tells a few components that it links to; if some
    have more, the rest is compared again with these merged, until all links lie within components."""
    masks = [_signed(m) for m in covering_masks(radius)]
    keys = fps.select("fp", "copies", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    buckets = keys.groupBy("t", "key").agg(F.max_by("fp", F.struct("copies", "fp")).alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = checkpointed(buckets)
    shared = with_bit(keys.drop("copies"), bit_array(buckets, "t", "key"), "t", "key").where("__bit").drop("__bit")
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = checkpointed(split_join(shared, buckets, ["t", "key"], "n", total).select("t", "key", "fp", "pivot"))
    stars = members.where((F.col("fp") != F.col("pivot")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= radius))
    comps = checkpointed(components(stars.select(F.col("fp").alias("u"), F.col("pivot").alias("v"))).select(F.col("node").alias("fp"), F.col("root").alias("comp")))
    members = members.select("t", "key", "fp")
    while (links := _cross_links(members, comps, radius, block, most)) is not None:
        joined = checkpointed(components(links.select(F.col("comp").alias("u"), F.explode("near").alias("v"))).select(F.col("node").alias("comp"), "root"))
        if joined.isEmpty():
            break
        # a component hangs on its least fingerprint, so it is a node of its own name; a fingerprint without one is its own
        sizes = checkpointed(comps.groupBy("comp").agg(F.count("*").alias("n")).join(joined, "comp"))
        moved = with_bit(comps, bit_array(sizes, "comp"), "comp")
        stay, move = moved.where("not __bit").select("fp", "comp"), moved.where("__bit").select("fp", "comp")
        move = split_join(move, sizes, "comp", "n", comps.count(), "left").select("fp", F.coalesce("root", "comp").alias("comp"))
        alone = joined.select(F.col("comp").alias("fp"), F.col("root").alias("comp")).join(comps.select("fp"), "fp", "left_anti")
        comps = checkpointed(stay.unionByName(move).unionByName(alone))
        if not links.agg(F.max("more")).first()[0]:
            break
    return comps


def near_copies(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (doc_id, text, ...); see the module docstring."""
    signed = checkpointed(fingerprints(docs, words))
    fps = checkpointed(signed.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")))
    comps = classes(fps.select("fp", "copies"), radius)
    linked = checkpointed(comps.join(fps, "fp"))
    roots = checkpointed(linked.groupBy("comp").agg(F.min("low").alias("least"), F.count("*").alias("n")))
    named = split_join(linked, roots, "comp", "n", linked.count()).select("fp", "least")
    named = checkpointed(fps.join(named, "fp", "left").select("fp", "copies", F.coalesce("least", "low").alias("component_id")))
    rows = split_join(signed, named, "fp", "copies", signed.count())
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
