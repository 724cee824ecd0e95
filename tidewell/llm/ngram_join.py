"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Result of :func:`ngram_join`, one row per document: doc_id, class_id (least doc_id among all documents linked to it
directly or through others), copy_id (least doc_id with the same n-gram set), n_links (number of other documents with
Jaccard similarity of at least the threshold) and n_grams.

Words are runs of characters other than ASCII white space, compared as they are. A text of one to four words has its
whole word sequence as its only n-gram. A text without words (or null) has no n-grams and links to nothing. Every row is
a document of its own, also where rows share a doc_id or have none; class_id and copy_id are null where no row of the
class has a doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import WORDS, bit_array, bounded, checkpointed, components, split_join, with_bit

ODD = np.uint64(0x9E3779B97F4A7C15)
_cache: dict[str, int] = {}


def bands_for(threshold: float, recall: float, pair_cost: float = 3_000) -> tuple[int, int]:
    """(bands, rows) of least cost among those by which a pair at the threshold meets in a band with probability ``recall``.

    For each number of rows the fewest such bands count. The cost of a choice is its hash values, bands x rows, and
    ``pair_cost`` times the probability that a pair of half the threshold, as shared passages make it, meets for nothing."""
    choices = []
    for rows in range(1, 33):
        missed = math.log1p(-(threshold**rows)) if threshold < 1 else -math.inf
        bands = max(1, math.ceil(math.log(1 - recall) / missed))
        for_nothing = -math.expm1(bands * math.log1p(-((threshold / 2) ** rows)))
        choices.append((bands * rows + pair_cost * for_nothing, bands, rows))
    return min(choices)[1:]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = WORDS.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    if len(_cache) > 50_000:
        _cache.clear()
    ids = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _cache.get(w)
        if h is None:
            h = _cache[w] = xxhash.xxh64_intdigest(w)
        ids[i] = h
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mix(h * ODD + ids[k : len(words) - width + 1 + k])
    return np.unique(h)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> list[int]:
    """One 64-bit key per band, the band's number mixed in. Minima are taken over the upper halves of the hashes, in 32
    bits, and by slices of a long set."""
    upper = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(upper), 128):  # a slice times all hash functions stays in the cache
        low = np.minimum(low, (upper[i : i + 128, None] * a + b).min(axis=0))
    rows = low.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = _mix(key * ODD + rows[:, k])
    return key.view(np.int64).tolist()


def _signer(n: int, bands: int, rows: int):
    rng = np.random.default_rng(20_011)
    a = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, mark, text in zip(pdf["doc_id"], pdf["mark"], pdf["text"]):
                g = gram_hashes(text, n)
                out.append((doc, mark, len(g), set_hash(g), signature(g, a, b, bands) if len(g) else None))
            made = pd.DataFrame(out, columns=["doc_id", "mark", "n_grams", "set_hash", "bands"])
            made["doc_id"] = pdf["doc_id"].to_numpy()
            yield made

    return sign


def set_hash(grams: np.ndarray) -> bytes | None:
    """128-bit hash of a whole n-gram set; null for an empty one."""
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def _packed(n: int):
    """Column function: the packed n-grams of a text, null unless their set has the given hash."""

    def pack(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        grams = [gram_hashes(t, n) for t in texts]
        return pd.Series([g.tobytes() if set_hash(g) == bytes(h) else None for g, h in zip(grams, hashes)], dtype=object)

    return F.pandas_udf(pack, T.BinaryType())


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, exact.

    Only values that two sets share can add to one, so a 0/1 matrix over those, multiplied by its transpose in slices of
    columns, gives every size.
    """
    all_values = np.concatenate(sets)
    _, inverse, count = np.unique(all_values, return_inverse=True, return_counts=True)
    column = np.where(count >= 2, np.cumsum(count >= 2) - 1, -1)[inverse]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = column >= 0
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(sets), len(sets)))
    width = 8192
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        shared += part @ part.T
    return shared


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of sets with Jaccard similarity at or over the threshold (no diagonal)."""
    size, shared = np.array([len(s) for s in sets]), overlaps(sets)
    hit = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(hit, False)
    return hit


def roots(hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id in each item's component of the boolean link matrix."""
    low = ids.copy()
    while True:
        best = np.minimum(low, np.where(hit, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (best == low).all():
            return low
        low = best


def _verifier(threshold: float):
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, band), part in pdf.groupby(["unit", "band"], sort=False):
            ids, blk, w = part["rid"].to_numpy(), part["block"].to_numpy(), part["copies"].to_numpy()
            hit = linked([np.frombuffer(g, np.uint64) for g in part["grams"]], threshold)
            if part["lo"].iloc[0] != part["hi"].iloc[0]:  # two blocks: pairs across them only
                hit &= blk[:, None] != blk[None, :]
            if band > 0 and hit.any():  # pairs that met in an earlier band were counted there
                hit &= overlaps([np.asarray(x, np.int64) for x in part["seen"]]) == 0
            out.append(pd.DataFrame({"rid": ids, "links": hit @ w, "root": roots(hit, ids)}))
        made = pd.concat(out)
        return made[made["links"] > 0]

    return verify


def units_of(stars: DataFrame, buckets: DataFrame, comps: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Where each candidate is to be verified: rid, unit, band, blocks and seen.

    ``stars`` (rid, band, key) and ``buckets`` (key, v, n) hold the band buckets of two rows and more, ``comps`` (rid, comp,
    n_grams) the components of their stars. A component all of whose pairs are no more than those that met in its
    buckets, one for each band, is one unit (band -1). Any other, such as a long chain of unlike texts, is verified bucket by bucket,
    and ``seen`` lists a row's buckets of earlier bands, where its pairs were counted. So never more pairs are verified
    than met in a band. A unit is cut into blocks of bounded rows and bytes.
    """
    cut = lambda rows, grams: F.greatest(F.ceil(F.col(rows) / block), F.ceil(F.col(grams) * 8 / block_bytes), F.lit(1)).cast("long")
    met = buckets.join(comps.select(F.col("rid").alias("v"), "comp"), "v").groupBy("comp").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("met"))
    sizes = comps.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g")).join(met, "comp")
    sizes = checkpointed(sizes.select("comp", "m", (F.col("m") * (F.col("m") - 1) <= F.col("met")).alias("whole"), cut("m", "g").alias("blocks")))
    placed = checkpointed(split_join(comps, sizes, "comp", "m", comps.count()))
    whole = placed.where("whole").select("rid", F.col("comp").alias("unit"), F.lit(-1).alias("band"), "blocks", F.array().cast("array<long>").alias("seen"))
    own = stars.join(placed.where("not whole").select("rid", "n_grams"), "rid")
    own = checkpointed(own.groupBy("rid", "n_grams").agg(F.sort_array(F.collect_list(F.struct("band", "key"))).alias("keys")))
    own = own.select("rid", "n_grams", F.transform("keys", lambda x: x["key"]).alias("keys"), F.posexplode("keys").alias("i", "at"))
    own = own.select("rid", "n_grams", F.col("at.key").alias("unit"), F.col("at.band").alias("band"), F.slice("keys", F.lit(1), F.col("i")).alias("seen"))
    each = checkpointed(own.groupBy("unit").agg(F.count("*").alias("size"), F.sum("n_grams").alias("g")).select("unit", "size", cut("size", "g").alias("blocks")))
    banded = split_join(own, each, "unit", "size", stars.count()).select("rid", "unit", "band", "blocks", "seen")
    return whole.unionByName(banded)


def members(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, block: int = 256, block_bytes: int = 32 << 20) -> DataFrame:
    """Each row's class: doc_id, mark (hash of the text), n_grams, and for texts with words copies, links (of the row's
    n-gram set) and the structs own and head: (none, doc_id, mark) of the least row with the same set and of the class.

    Equal sets are folded into one representative by a 128-bit hash. Band keys that more than one representative has
    give a star per bucket in place of its pairs. :func:`units_of` deals the stars' components, or their buckets, to
    units of verification; a unit's blocks are verified in pairs by exact intersections, and only per-row counts and a local
    root leave a task, never the pairs. Classes are the components of verified links alone.
    """
    bands, rows = bands_for(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text"))
    signed = bounded(texts).mapInPandas(_signer(n, bands, rows), "doc_id long, mark long, n_grams int, set_hash binary, bands array<long>")
    signed = checkpointed(signed.withColumn("rid", F.monotonically_increasing_id()))
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("own")
    folded = signed.where("set_hash is not null").groupBy("set_hash").agg(F.min("rid").alias("rid"), own, F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    folded = checkpointed(folded)
    keys = folded.select("rid", F.posexplode("bands").alias("band", "key"))
    buckets = checkpointed(keys.groupBy("key").agg(F.min("rid").alias("v"), F.count("*").alias("n")).where("n > 1"))
    shared = with_bit(keys, bit_array(buckets, "key"), "key").where("__bit").drop("__bit")
    stars = checkpointed(split_join(shared, buckets, "key", "n", buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).select("rid", "band", "key", "v"))
    comps = components(stars.select(F.col("rid").alias("u"), "v")).select(F.col("node").alias("rid"), F.col("root").alias("comp"))
    comps = checkpointed(comps.join(folded.select("rid", "own", "set_hash", "copies", "n_grams"), "rid"))
    units = units_of(stars.select("rid", "band", "key"), buckets, comps.select("rid", "comp", "n_grams"), block, block_bytes)
    units = units.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    todo = units.groupBy("rid").agg(F.collect_list(F.struct("unit", "band", "blocks", "block", "seen")).alias("units")).join(comps, "rid")
    spot = F.coalesce("doc_id", "mark")
    todo = checkpointed(todo.select("rid", "copies", "set_hash", "units", "n_grams", F.coalesce("own.doc_id", "own.mark").alias("spot"), F.col("own.mark").alias("mark")))
    wanted = with_bit(texts.select(spot.alias("spot"), "mark", "text"), bit_array(todo, "spot", "mark"), "spot", "mark").where("__bit")
    wanted = wanted.groupBy("spot", "mark").agg(F.first("text").alias("text")).join(todo, ["spot", "mark"])
    grams = wanted.withColumn("grams", _packed(n)(F.col("text"), F.col("set_hash"))).where("grams is not null")
    held = todo.agg(F.count("*"), F.coalesce(F.sum("n_grams"), F.lit(0))).first()
    slots = 1 + max(held[0] // block, held[1] * 8 // block_bytes)
    pairs = grams.select("rid", "copies", "grams", F.inline("units")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    pairs = pairs.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other"), "cut": F.col("blocks") > 1}).drop("other", "blocks")
    pairs = pairs.withColumn("slot", F.when(F.col("cut"), F.xxhash64("unit", "band")).otherwise(F.pmod(F.xxhash64("unit", "band"), F.lit(slots))))
    found = checkpointed(pairs.groupBy("cut", "slot", "lo", "hi").applyInPandas(_verifier(threshold), "rid long, links long, root long"))
    roots_ = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rid"), "root")
    links = found.groupBy("rid").agg(F.sum("links").alias("links")).join(roots_, "rid").join(folded.select("rid", "own"), "rid")
    links = checkpointed(links)
    heads = checkpointed(links.groupBy("root").agg(F.min("own").alias("head"), F.count("*").alias("size")))
    links = split_join(links, heads, "root", "size", links.count()).select("rid", "links", "head")
    folded = checkpointed(folded.select("set_hash", "rid", "own", "copies").join(links, "rid", "left").withColumn("head", F.coalesce("head", "own")).drop("rid"))
    every = signed.select("doc_id", "mark", "n_grams", "set_hash")
    with_words = split_join(every.where("set_hash is not null"), folded, "set_hash", "copies", every.count())
    return with_words.unionByName(every.where("set_hash is null"), allowMissingColumns=True).drop("set_hash")


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """Near-duplicate classes and link counts of ``docs`` (doc_id, text, ...); see the module docstring and :func:`members`."""
    words = F.col("n_grams") > 0
    return members(docs, **options).select(
        "doc_id",
        F.when(words, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(words, F.col("own.doc_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.col("n_grams").cast("long").alias("n_grams"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class kept, the one with the least doc_id; columns as they came.

    Rows equal in doc_id and text count as one document. Texts without words are in no class and stay. Only rows that may go,
    by a bit array of theirs, are shuffled; all others stay where they are.
    """
    m = members(docs, **options)
    goes = (F.col("n_grams") > 0) & ~(F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.mark") == F.col("mark")))
    m = m.groupBy(F.coalesce("doc_id", "mark").alias("spot"), "mark").agg(F.max(goes).alias("goes"), F.count("*").alias("n"))
    suspects = checkpointed(m.where("goes or n > 1"))
    # the row travels as one struct, so no name of its columns can meet one used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    rows = rows.select("row", F.coalesce("id", "mark").alias("spot"), "mark")
    rows = with_bit(rows, bit_array(suspects, "spot", "mark"), "spot", "mark")
    total = suspects.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = split_join(rows.where("__bit"), suspects, ["spot", "mark"], "n", total, "left").where("not coalesce(goes, false)")
    return rows.where("not __bit").select("row.*").unionByName(near.dropDuplicates(["spot", "mark"]).select("row.*"))
