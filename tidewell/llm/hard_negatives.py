"""Hard negatives for contrastive training, with full exact scores by the method of the Four Russians.

:func:`mine` takes rows (vec_id, label, embedding) and the anchors among them. A row's score is the integer inner product
of its vector and the anchor's, each component x taken as floor(scale * x). Higher scores come first, ties by vec_id. An
anchor's positives are its first ``positives`` other rows of its label; for each of them the negatives are the first
``negatives`` rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score. Result:
anchor_id, positive_id, rank (from 1, within the positive), negative_id, positive_score, negative_score.

Rows with a null id, label or vector, or a vector with a null or non-finite component, take no part. Where vectors have
different lengths the missing components count as zeros. Rows alike in id, label and score count once, so repeated rows
change nothing; a row is no positive or negative of an anchor that has its id. An anchor without positives, and a positive
without negatives in its band, give no rows. Components so large that a score could leave 62 bits raise a ValueError. Extra
columns are ignored.

Scoring: a row's components are cut into groups of eight, and of each group's two's complement every bit plane is one
byte. An anchor has for each group a table of the 256 sums of its components over subsets. A score is then the sum over
planes of the tables' entries at the row's bytes, shifted by the plane's number, the sign plane counted negative.
Rows travel as packed blocks, anchors as blocks of tables' sources; each pair of blocks is one unit of work and gives no more
than each anchor's own best, so nothing is broadcast and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import bounded, checkpointed

PACKED = "ids binary, labels binary, planes binary, groups int, bits int"


def integers(vectors: np.ndarray | list, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of any lengths as one matrix, padded with zeros to a multiple of eight columns."""
    long = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(8, -(-long // 8) * 8)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.asarray(v, float)
    out = np.floor(scale * out)
    if len(out) and np.abs(out).max() >= 2.0**30 / np.sqrt(out.shape[1]):
        raise ValueError("components are too large for exact scores")
    return out.astype(np.int64)


def pack_planes(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes (planes, groups, rows) of the bit planes of two's complement numbers, eight columns a byte, the lowest plane
    first, and the number of planes; the last is the sign's."""
    bits = int(max(abs(int(x.min())), abs(int(x.max())), 1)).bit_length() + 1 if x.size else 1
    planes = [np.packbits(((x >> b) & 1).astype(np.uint8).reshape(len(x), -1, 8), axis=2, bitorder="little")[:, :, 0].T for b in range(bits)]
    return np.ascontiguousarray(np.stack(planes)), bits


def subset_sums(x: np.ndarray) -> np.ndarray:
    """(groups, 256, rows): for each group of eight columns the sums over all subsets, each from one with a column less."""
    groups = x.T.reshape(-1, 8, len(x))
    out = np.zeros((len(groups), 256, len(x)), np.int64)
    for b in range(8):
        out[:, 1 << b : 2 << b] = out[:, : 1 << b] + groups[:, b : b + 1]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products of packed rows and the anchors of the tables. Groups that one side lacks are zeros."""
    groups = min(planes.shape[1], len(tables))
    total = np.zeros((planes.shape[2], tables.shape[2]), np.int64)
    for b in range(len(planes) - 1, -1, -1):
        plane = np.zeros_like(total)
        for g in range(groups):
            plane += tables[g].take(planes[b, g], axis=0)
        total = 2 * total + (-plane if b == len(planes) - 1 else plane)
    return total


def _packer(rows: int, scale: float):
    """Rows to packed blocks of at most ``rows``, gathered over a partition's batches."""

    def block(held: list[pd.DataFrame]) -> dict:
        pdf = pd.concat(held)
        planes, bits = pack_planes(integers(pdf["embedding"].tolist(), scale))
        return {"ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "labels": pdf["label"].to_numpy(np.int64).tobytes(), "planes": planes.tobytes(), "groups": planes.shape[1], "bits": bits}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            while len(pdf):
                part, pdf = pdf.iloc[: rows - n], pdf.iloc[rows - n :]
                held.append(part)
                n += len(part)
                if n == rows:
                    yield pd.DataFrame([block(held)])
                    held, n = [], 0
        if n:
            yield pd.DataFrame([block(held)])

    return pack


def _unpacked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
    return ids, labels, np.frombuffer(r.planes, np.uint8).reshape(r.bits, r.groups, len(ids))


def _values(planes: np.ndarray) -> np.ndarray:
    """The numbers behind bit planes."""
    bits = np.unpackbits(planes, axis=1, bitorder="little")  # (planes, 8 groups, rows), as a byte's bits lie along its group
    weight = 2 ** np.arange(len(planes), dtype=np.int64)
    weight[-1] = -weight[-1]
    return np.tensordot(weight, bits.astype(np.int64), 1).T


def _best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at``, the first k by score and id, places alike in both once."""
    if len(at) > 4 * k:  # only ties with the kth can still matter
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    at = at[np.lexsort((ids[at], -score[at]))]
    new = np.concatenate(([True], (np.diff(ids[at]) != 0) | (np.diff(score[at]) != 0))) if len(at) else np.empty(0, bool)
    return at[new][:k]


def _searcher(positives: int, negatives: int, low: int, high: int, width: int = 64):
    """For joined pairs of blocks: each anchor's best rows of its label or, where ``bands`` gives the anchors' positives, the
    best rows of other labels in each positive's band."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, labels, planes = _unpacked(r)
                a = pd.Series({"ids": r.a_ids, "labels": r.a_labels, "planes": r.a_planes, "groups": r.a_groups, "bits": r.a_bits})
                a_ids, a_labels, a_planes = _unpacked(a)
                values, out = _values(a_planes), []
                bands = None if r.bands is None else {}
                for x in r.bands if bands is not None else []:
                    bands.setdefault(x["at"], []).append((x["positive_id"], x["positive_score"]))
                for lo in range(0, len(a_ids), width):
                    s = scores(planes, subset_sums(values[lo : lo + width])).T
                    for i in range(len(s)):
                        n, own = lo + i, np.ascontiguousarray(s[i])
                        alike = labels == a_labels[n]
                        if bands is None:
                            at = _best(own, ids, np.flatnonzero(alike & (ids != a_ids[n])), positives)
                            out.append((np.full(len(at), n), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), ids[at], own[at]))
                        for p_id, p_score in bands.get(n, []) if bands is not None else []:
                            at = np.flatnonzero(~alike & (100 * own >= low * p_score) & (100 * own <= high * p_score) & (ids != a_ids[n]))
                            at = _best(own, ids, at, negatives)
                            out.append((np.full(len(at), n), np.full(len(at), p_id), np.full(len(at), p_score), ids[at], own[at]))
                if out:
                    at, p_id, p_score, found, score = map(np.concatenate, zip(*out))
                    yield pd.DataFrame({"ab": r.ab, "at": at, "anchor_id": a_ids[at], "positive_id": p_id, "positive_score": p_score, "vec_id": found, "score": score})

    return search


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256, block: int = 8192, anchor_block: int = 256) -> DataFrame:
    """Hard negatives of ``anchors`` among ``rows``, both (vec_id, label, embedding, ...); see the module docstring.

    Rows are packed where they lie and written once, some ten bytes for eight components. Pairs of a row block and an anchor
    block (the number of either grows with its table) are joined twice: for the positives and, with their bands, for
    the negatives. A pair's best are at most ``positives`` rows an anchor, or ``negatives`` a positive, and Spark limits ranks
    before it shuffles them."""
    whole = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(whole)
    asked = clean(anchors).distinct()
    a_blocks = max(1, -(-asked.count() // anchor_block))
    packed = lambda df, n: bounded(df).mapInPandas(_packer(n, scale), PACKED)
    a = checkpointed(packed(asked.repartition(a_blocks), 2 * anchor_block + 1024).withColumn("ab", F.spark_partition_id()))
    c = checkpointed(packed(clean(rows), block).withColumn("cb", F.monotonically_increasing_id()))
    # keys of one anchor block and about four row blocks each
    salts = max(1, c.count() // 4)
    a = a.select("ab", *[F.col(x).alias(f"a_{x}") for x in ("ids", "labels", "planes", "groups", "bits")]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    c = c.withColumn("salt", F.pmod(F.xxhash64("cb"), F.lit(salts)).cast("int")).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))))
    met = bounded(c.repartition(min(a_blocks * salts, 20_000), "ab", "salt").join(a, ["ab", "salt"]))
    kind = "ab int, at int, anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    search = _searcher(positives, negatives, low, high)
    no_bands = F.lit(None).cast("array<struct<at: int, positive_id: bigint, positive_score: bigint>>").alias("bands")
    place = lambda keys: F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")).cast("int")  # noqa: E731  equal rows share a place
    best = lambda df, keys, k: df.withColumn("rank", place(keys)).where(F.col("rank") <= k).distinct()
    first = best(met.select("*", no_bands).mapInPandas(search, kind), ["ab", "at"], positives)
    bands = first.groupBy("ab").agg(F.collect_list(F.struct("at", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("bands"))
    second = best(met.join(checkpointed(bands), "ab").mapInPandas(search, kind), ["ab", "at", "positive_id", "positive_score"], negatives)
    return second.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
