"""Nearest vectors by cosine, exact, with blocks that cannot hold one passed over.

Rows hang on the nearest of some pivots, themselves rows, and the rows of a pivot are cut into blocks by their angle to
it. Angles obey the triangle inequality, so a query that lies at angle a from a pivot is at least ``max(0, a - hi, lo - a)``
away from every row of a block with angles lo to hi. A first round scores each query's nearest blocks that hold k rows;
the second visits only those other blocks whose bound still reaches the kth score found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import scan
from tidewell.sources.shared import written

# Scores are rounded to six digits: half of that, and what angles lose near zero, is granted to every bound.
SLACK = 1e-6


@dataclass
class Pivots:
    """Unit vectors by length of vector: dim -> (cell numbers, matrix). At most as many as :func:`search` is told."""

    by_dim: dict[int, tuple[np.ndarray, np.ndarray]]

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        _, matrix = self.by_dim[vectors.shape[1]]
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        return np.arccos(np.clip(vectors @ matrix.T / norm[:, None], -1, 1))


def usable(c: str) -> Column:
    """Whether a vector has no null or non-finite part and is not all zeros."""
    return F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == math.inf)) & F.exists(c, lambda x: x != 0)


def pivots_of(vectors: DataFrame, most: int) -> Pivots:
    """``most`` vectors at most, those with the least hash of their values, repeats apart."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(most).collect()
    by_dim: dict[int, dict[tuple, int]] = {}
    for i, r in enumerate(rows):
        by_dim.setdefault(len(r[0]), {}).setdefault(tuple(r[0]), i)
    made = {}
    for dim, found in by_dim.items():
        m = np.array(list(found), float)
        made[dim] = (np.array(list(found.values())), m / np.sqrt((m * m).sum(axis=1))[:, None])
    return Pivots(made)


def _placed(pivots: Pivots):
    """Column function: cell (-1 where no pivot has the vector's length) and angle to its pivot."""

    def place(vectors: pd.Series) -> pd.DataFrame:
        cell, angle = np.full(len(vectors), -1), np.zeros(len(vectors))
        lengths = vectors.map(len).to_numpy()
        for dim in set(lengths.tolist()) & set(pivots.by_dim):
            at = np.flatnonzero(lengths == dim)
            found = pivots.angles(np.stack(vectors.iloc[at]).astype(float))
            best = found.argmin(axis=1)
            cell[at], angle[at] = pivots.by_dim[dim][0][best], found[np.arange(len(at)), best]
        return pd.DataFrame({"cell": cell, "angle": angle})

    return F.pandas_udf(place, "cell int, angle double")


def _cells_asked(pivots: Pivots, cells: dict[int, tuple[float, float, int]], k: int, weight: float, first: bool):
    """Cells that each query (qid, q, kth) turns to, with its angle to their pivots: in the first round the nearest by bound that
    hold k rows together, then all whose bound reaches kth. Rows without a pivot (cell -1) have no bound."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            lengths = pdf["q"].map(len).to_numpy()
            for dim in set(lengths.tolist()):
                part = pdf[lengths == dim]
                known = [c for c in pivots.by_dim.get(dim, ([],))[0] if c in cells]
                if known:
                    lo, hi, n = (np.array(x) for x in zip(*(cells[c] for c in known)))
                    a = pivots.angles(np.stack(part["q"]).astype(float))[:, [list(pivots.by_dim[dim][0]).index(c) for c in known]]
                    bound = np.maximum(0, np.maximum(a - hi, lo - a))
                    if first:
                        order = np.argsort(bound + 1e-9 * a, axis=1, kind="stable")
                        before = np.cumsum(n[order], axis=1) - n[order]
                        wanted = np.zeros(a.shape, bool)
                        np.put_along_axis(wanted, order, before < k, axis=1)
                    else:
                        wanted = weight * np.maximum(0, np.cos(np.minimum(bound, math.pi))) + SLACK >= part["kth"].to_numpy()[:, None]
                    i, j = np.nonzero(wanted)
                    out.append(pd.DataFrame({"qid": part["qid"].to_numpy()[i], "dim": dim, "cell": np.array(known)[j], "a": a[i, j]}))
                if not known or not first:
                    out.append(pd.DataFrame({"qid": part["qid"].to_numpy(), "dim": dim, "cell": -1, "a": 0.0}))
            yield pd.concat(out) if out else pd.DataFrame({"qid": [], "dim": [], "cell": [], "a": []})

    return ask


def _best_cosines(k: int, weight: float):
    """For a block of vectors and a block of queries: each query's best k of the block."""

    def best(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(wanted):
            rows = rows.sort_values("vec_id")
            ids, v, q = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float), np.stack(wanted["q"]).astype(float)
            vn, qn, names = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1)), wanted["qid"].to_numpy()
            for i in range(0, len(q), 256):  # slices keep the matrix small
                part = q[i : i + 256]
                s = np.round(weight * np.clip(part @ v.T / (qn[i : i + 256, None] * vn), 0, 1), 6)
                low = np.partition(s, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                for r in range(len(part)):
                    at = np.flatnonzero(s[r] >= low[r])
                    at = at[np.argsort(-s[r, at], kind="stable")[:k]]  # ties by vec_id, as rows are in that order
                    out.append(pd.DataFrame({"qid": names[i + r], "vec_id": ids[at], "score": s[r, at]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "vec_id": [], "score": []})

    return best


@dataclass
class Found:
    """hits (query_id, vec_id, score, rank), visits (qid, dim, cell, block: what was scored) and blocks (dim, cell, block, lo, hi, n)."""

    hits: DataFrame
    visits: DataFrame
    blocks: DataFrame


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, query_block: int = 4096, row_block: int = 8192, weight: float = 1.0, pivots: int = 256) -> Found:
    """See :func:`semantic_retrieve`; also tells what was visited.

    Only the pivots (one for each ``row_block`` rows, ``pivots`` at most) and the bounds of their cells reach driver and tasks whole. Blocks are
    ranges of cell, angle and id, so a cell with a third of all rows is many of them."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    v = vectors.where(usable("embedding")).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    total = v.count()
    chosen = pivots_of(v, min(pivots, 1 + total // row_block))  # cells of about a block; more could skip no more
    v = v.withColumn("at", _placed(chosen)(F.col("embedding").cast("array<double>"))).select("vec_id", "embedding", "dim", "at.cell", "at.angle")
    v = scan.blocks(v, ["dim", "cell"], [F.col("angle"), F.col("vec_id")], 1 + total // row_block)
    blocks = written(v.groupBy("dim", "cell", "block").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")))
    cells = {r["cell"]: (r["lo"], r["hi"], r["n"]) for r in blocks.where("cell >= 0").groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()}
    q = written(queries.where(usable("q")).select("query_id", F.col("q").cast("array<double>").alias("q"), F.monotonically_increasing_id().alias("qid")))
    parts = 1 + q.count() // query_block

    def asked(rows: DataFrame, first: bool) -> DataFrame:
        c = rows.mapInPandas(_cells_asked(chosen, cells, k, weight, first), "qid long, dim int, cell int, a double").join(blocks, ["dim", "cell"])
        least = F.when(F.col("cell") < 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("a") - F.col("hi"), F.col("lo") - F.col("a")))
        return c.withColumn("bound", least)

    def scored(targets: DataFrame) -> DataFrame:
        cut = lambda t: t.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)))
        place = ["dim", "cell", "block"]
        own = v.join(cut(targets).select(*place, "part").distinct(), place)
        return own.groupBy(*place, "part").cogroup(cut(targets).join(q, "qid").groupBy(*place, "part")).applyInPandas(_best_cosines(k, weight), f"qid long, vec_id {kind}, score double")

    near = Window.partitionBy("qid").orderBy("bound", "a", "cell", "block")
    few = asked(q.select("qid", "q", F.lit(0.0).alias("kth")), True)
    few = few.withColumn("before", F.coalesce(F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < k)
    few = written(few.select("qid", "dim", "cell", "block"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = lambda s: s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    one = written(top(scored(few)))
    kth = one.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    rest = asked(q.join(kth, "qid", "left").select("qid", "q", F.coalesce("kth", F.lit(0.0)).alias("kth")), False).join(kth, "qid", "left")
    reach = F.lit(float(weight)) * F.greatest(F.lit(0.0), F.cos(F.least("bound", F.lit(math.pi)))) + F.lit(SLACK) >= F.coalesce("kth", F.lit(0.0))
    rest = written(rest.where(reach).select("qid", "dim", "cell", "block").join(few, ["qid", "dim", "cell", "block"], "left_anti"))
    hits = top(one.drop("rank").unionByName(scored(rest))).join(q.select("qid", "query_id"), "qid").select("query_id", "vec_id", "score", "rank")
    return Found(hits, few.unionByName(rest), blocks)


def semantic_retrieve(queries: DataFrame, vectors: DataFrame, k: int = 5, query_block: int = 4096, row_block: int = 8192, weight: float = 1.0, pivots: int = 256) -> DataFrame:
    """Top vectors (vec_id, embedding) by cosine clamped to 0..1, times ``weight``, for each query (query_id, q), any number of
    both: query_id, vec_id, score, rank; ties by vec_id. Exact; see the module docstring.

    Vectors of zeros, with a null or non-finite part or of another length than the query's meet nothing. Rows that share a
    query_id, or have none, are queries of their own. Other columns are ignored."""
    return search(queries, vectors, k, query_block, row_block, weight, pivots).hits
