"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled as good; all documents are the unlabelled set, and labels of bad rows are never used.
A document is a row of binned text statistics and of hashed word frequencies (:func:`measured`), and the model is linear:

1. a plain classifier of positives against unlabelled rows orders the documents;
2. the class prior is the best-bin estimate over that order: the least ratio of the unlabelled to the positive share above a
   threshold, less what chance may do to it;
3. the weights minimise the non-negative unbiased risk pi R_p(+) + max(0, R_u(-) - pi R_p(-)) with the logistic loss;
4. the cut is the middle of the thresholds whose balanced accuracy, as the positives, all documents and the prior give it,
   is within ``flat`` of the best; the scale then brings the mean score of all documents as near to the prior as it can.

The first classifier and the start of the weights come from bounded hash samples. The weights then take steps down the risk
over all documents, each summed by Spark in one pass (:func:`descend`); only the positives, which are labelled, stay bounded.
Bin edges, prior and intercept come from all documents. Half of the positives, by hash of their id, serve for the weights and the other half for prior and intercept, as a classifier
scores the positives that it was fitted on too high.

:func:`score` returns doc_id, score (0 to 1, higher: better) and predicted (score of at least 0.5). Null and empty texts
have statistics of zero and get a score like any other. Without positives every score is the prior (0.5 if none is
given). Repeated rows are each scored; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bounded

FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "adjacent_repeats", "odd_signs", "odd_word_ends", "sentence_ends",
    "capitals", "digits", "line_length", "repeated_lines", "distinct_pairs", "short_words", "long_words",
)
BUCKETS = 256  # of hashed words
MEASURED = "doc_id long, x array<double>, bucket array<short>, weight array<float>"
_ODD = re.compile(r"[^\w\s.,;:'\"!?()\-]")
_ODD_END = re.compile(r"[^\w\s.,;:'\"!?()\-]+(?=\s|$)")
_bucket: dict[str, int] = {}


def statistics(text: str | None) -> tuple[list[float], dict[int, float]]:
    """The statistics named in FEATURES over the whole text, and its hashed words: the square roots of their numbers by
    bucket, as a vector of length one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES), {}
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    part = words[: n - n % 50] if n >= 50 else words
    blocks = [len(set(part[i : i + 50])) / min(50, len(part)) for i in range(0, len(part), 50)]
    pairs = Counter(zip(words, words[1:]))
    odd = len(_ODD.findall(text))
    by_length = Counter(map(len, words))
    if len(_bucket) > 50_000:
        _bucket.clear()
    held: dict[int, float] = {}
    for w, c in count.items():
        b = _bucket.get(w)
        if b is None:
            b = _bucket[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        held[b] = held.get(b, 0.0) + c
    return [
        np.log1p(n),
        chars / n,
        sum(blocks) / len(blocks),
        max(count.values()) / n,
        sum(c for (a, b), c in pairs.items() if a == b) / n,
        odd / chars,
        (len(_ODD_END.findall(text)) if odd else 0) / n,
        text.count(".") / n,
        sum(c for w, c in count.items() if w[0].isupper()) / n,
        sum(c for w, c in count.items() if w.isdigit()) / n,
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        len(pairs) / max(1, n - 1),
        sum(c for k, c in by_length.items() if k <= 3) / n,
        sum(c for k, c in by_length.items() if k >= 14) / n,
    ], {b: (c / n) ** 0.5 for b, c in held.items()}


def rounded(x: list[list[float]]) -> np.ndarray:
    """Statistics to four significant digits, so that their distinct values stay few."""
    x = np.array(x, float).reshape(-1, len(FEATURES))
    unit = 10.0 ** (3 - np.floor(np.log10(np.where(x == 0, 1, np.abs(x)))))
    return np.round(x * unit) / unit


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x (statistics), bucket and weight (hashed words) of every whole text of ``docs`` (doc_id, text, ...)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [statistics(t) for t in pdf["text"]]
            held = [sorted(h.items()) for _, h in rows]
            made = {"doc_id": pdf["doc_id"], "x": list(rounded([x for x, _ in rows])), "bucket": [[b for b, _ in h] for h in held], "weight": [[w for _, w in h] for h in held]}
            yield pd.DataFrame(made)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(texts).mapInPandas(measure, MEASURED)


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # (statistics, bins - 1)
    weights: np.ndarray  # one-hot bins of all statistics, then word buckets
    intercept: float
    prior: float

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        """Feature rows of measured documents."""
        bins = self.edges.shape[1] + 1
        x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
        out = np.zeros((len(x), len(FEATURES) * bins + BUCKETS), np.float32)
        for j in range(len(FEATURES)):
            out[np.arange(len(x)), j * bins + np.searchsorted(self.edges[j], x[:, j], side="right")] = 1
        own = np.repeat(np.arange(len(x)), [len(b) for b in rows["bucket"]])
        if len(own):
            out[own, len(FEATURES) * bins + np.concatenate(rows["bucket"].to_numpy()).astype(np.int64)] = np.concatenate(rows["weight"].to_numpy())
        return out

    def rates(self, rows: pd.DataFrame) -> np.ndarray:
        """Scores before the intercept, in slices of 256 rows."""
        parts = [self.matrix(rows.iloc[i : i + 256]) @ self.weights for i in range(0, len(rows), 256)]
        return np.concatenate(parts).astype(float) if parts else np.zeros(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _mean(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.append(r @ x, r.sum()) / len(x)


def split_risk(w: np.ndarray, pos: np.ndarray, unl_loss: float, unl_gradient: np.ndarray, prior: float, ridge: float) -> tuple[float, float, np.ndarray]:
    """As :func:`nn_risk`, the unlabelled rows given by their mean loss as negatives and its gradient."""
    zp = pos @ w[:-1] + w[-1]
    negative = unl_loss - prior * float(np.logaddexp(0, zp).mean())
    risk = prior * float(np.logaddexp(0, -zp).mean()) + max(0.0, negative) + ridge / 2 * float(w[:-1] @ w[:-1])
    g_neg = unl_gradient - prior * _mean(pos, _sigmoid(zp))
    g = prior * _mean(pos, _sigmoid(zp) - 1) + g_neg if negative >= 0 else -g_neg
    return risk, negative, g + ridge * np.append(w[:-1], 0)


def nn_risk(w: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float) -> tuple[float, float, np.ndarray]:
    """The non-negative risk at w (intercept last), its negative part before the cut at zero, and the descent gradient:
    that of the risk, or, where the negative part is under zero, the reversed one of that part."""
    zu = unl @ w[:-1] + w[-1]
    return split_risk(w, pos, float(np.logaddexp(0, zu).mean()), _mean(unl, _sigmoid(zu)), prior, ridge)


def adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def order_fit(pos: np.ndarray, unl: np.ndarray, steps: int = 200, ridge: float = 3e-3) -> np.ndarray:
    """Weights of a logistic classifier of positives against unlabelled rows, both sides weighing the same."""

    def gradient(w: np.ndarray) -> np.ndarray:
        rp, ru = _sigmoid(pos @ w[:-1] + w[-1]) - 1, _sigmoid(unl @ w[:-1] + w[-1])
        return (np.append(rp @ pos, rp.sum()) / len(pos) + np.append(ru @ unl, ru.sum()) / len(unl)) / 2 + ridge * np.append(w[:-1], 0)

    return adam(gradient, pos.shape[1] + 1, steps)[:-1]


def nn_risk_fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Minimise the non-negative risk; weights, intercept last."""
    return adam(lambda w: nn_risk(w, pos, unl, prior, ridge)[2], pos.shape[1] + 1, steps)


def unlabelled_risk(rows: DataFrame, model: Model, at: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Mean loss of all measured ``rows`` as negatives and its gradient, at each of the points ``at`` (weights, intercept last),
    in one pass. A task hands on one sum for each point and weight, so what is shuffled grows with the tasks alone."""
    w = np.stack(at, axis=1)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gradient, loss, n = np.zeros(w.shape), np.zeros(w.shape[1]), 0
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                x = model.matrix(pdf.iloc[i : i + 256])
                z = x @ w[:-1] + w[-1]
                r = _sigmoid(z)
                gradient += np.vstack([x.T @ r, r.sum(0)])
                loss, n = loss + np.logaddexp(0, z).sum(0), n + len(x)
        total = np.concatenate([gradient.ravel(), loss, [n]])
        yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "total": total})

    sums = rows.mapInPandas(summed, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).toPandas().sort_values("i")["total"].to_numpy()
    mean = np.round(sums[:-1] / sums[-1], 10)  # the order in which tasks are added does not count
    return list(zip(mean[w.size :].tolist(), mean[: w.size].reshape(w.shape).T))


def descend(rows: DataFrame, model: Model, pos: np.ndarray, unl: np.ndarray, prior: float, passes: int, ridge: float = 1e-3) -> Model:
    """``model`` after steps down the non-negative risk of positives and all measured ``rows``, the start being one pass and
    each step another.

    Risks and gradients are exact, over all rows; the curvature that bends the direction is that of the sample ``unl``
    (sub-sampled Newton; with the logistic loss the positives' part is linear and has none). A pass tries ten lengths of a
    step, and the point of least risk so far is where the next starts, so the result is never worse than the sample's."""
    w = np.append(model.weights, model.intercept)
    z = unl @ model.weights + model.intercept
    x = np.hstack([unl, np.ones((len(unl), 1))])
    curve = (x * (_sigmoid(z) * _sigmoid(-z))[:, None]).T @ x / len(x) + np.diag(np.full(len(w), ridge))
    tried, least, slope = [w], np.inf, None
    for _ in range(passes):
        better = False
        for v, (loss, gradient) in zip(tried, unlabelled_risk(rows, model, tried)):
            risk, negative, _ = split_risk(v, pos, loss, gradient, prior, ridge)
            if risk < least:
                zp = _sigmoid(pos @ v[:-1] + v[-1])
                slope = prior * _mean(pos, zp - 1) + ridge * np.append(v[:-1], 0)
                slope = slope + gradient - prior * _mean(pos, zp) if negative > 0 else slope
                w, least, better = v, risk, True
        far = 1.0 if better else far / 1024  # nothing gained: shorter steps along the same line
        step = np.linalg.solve(curve, slope)
        tried = [w - far * step / 2**k for k in range(10)]
    return replace(model, weights=w[:-1], intercept=float(w[-1]))


def best_bin_prior(values: np.ndarray, pos: np.ndarray, unl: np.ndarray, gamma: float = 0.01, delta: float = 0.1) -> float:
    """Class prior from counts of positive and unlabelled rows by score: the ratio of their shares above the threshold at
    which its upper confidence bound is least (best-bin estimation; gamma and delta as published)."""
    order = np.argsort(-values)
    p, u = np.cumsum(pos[order]) / pos.sum(), np.cumsum(unl[order]) / unl.sum()
    ok = p > 0
    chance = np.sqrt(np.log(4 / delta) / (2 * unl.sum())) + np.sqrt(np.log(4 / delta) / (2 * pos.sum()))
    i = int((u[ok] / p[ok] + (1 + gamma) * chance / p[ok]).argmin())
    return float(np.clip(u[ok][i] / p[ok][i], 1e-3, 1 - 1e-3))


def best_intercept(values: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> float:
    """Intercept of least non-negative risk, given counts of positive and unlabelled rows by score before the intercept."""
    p, u = pos / pos.sum(), unl / unl.sum()

    def risk(b: float) -> float:
        z = values + b
        loss = np.logaddexp(0, z)
        return float(prior * (p @ (loss - z)) + max(0.0, u @ loss - prior * (p @ loss)))

    lo, hi = -values.max() - 10, -values.min() + 10
    for _ in range(4):  # a finer grid around the best of the last one
        grid = np.linspace(lo, hi, 201)
        at = int(np.argmin([risk(b) for b in grid]))
        lo, hi = grid[max(0, at - 1)], grid[min(200, at + 1)]
    return float(grid[at])


def best_cut(values: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float, flat: float = 0.02) -> tuple[float, float]:
    """(scale, intercept) of scores, given counts of positive and unlabelled rows by score before both.

    Above a threshold lie a share p of the positives and u of all rows, so (u - prior p) / (1 - prior) of the negatives. The
    least risk of a flat score moves the cut into the negatives where good rows are many; the cut here weighs both kinds
    the same. Scales are tried from 1 to 64."""
    p, u = 1 - (np.cumsum(pos) - pos) / pos.sum(), 1 - (np.cumsum(unl) - unl) / unl.sum()
    gain = p - np.clip((u - prior * p) / (1 - prior), 0, 1)
    near = values[gain >= gain.max() - flat]
    at = (near[0] + near[-1]) / 2
    scales = np.geomspace(1, 64, 121)
    miss = [abs(float(_sigmoid(k * (values - at)) @ unl) / unl.sum() - prior) for k in scales]
    k = float(scales[int(np.argmin(miss))])
    return k, -k * float(at)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each statistic has each value in a task: feature, value, n."""
    count = [Counter() for _ in FEATURES]
    for pdf in batches:
        for c, column in zip(count, np.stack(pdf["x"].to_numpy()).T if len(pdf) else ()):
            c.update(dict(zip(*(y.tolist() for y in np.unique(column, return_counts=True)))))
    yield pd.DataFrame([(j, v, n) for j, c in enumerate(count) for v, n in c.items()], columns=["feature", "value", "n"])


def edges_of(rows: DataFrame, bins: int) -> np.ndarray:
    """Quantiles of each statistic over all measured ``rows``, exact; (statistics, bins - 1)."""
    counts = rows.select("x").mapInPandas(_counted, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    at = np.linspace(0, 1, bins + 1)[1:-1].tolist()
    found = counts.groupBy("feature").agg(F.percentile("value", at, F.col("n")).alias("q")).collect()
    return np.array([r["q"] for r in sorted(found, key=lambda r: r["feature"])])


def rate_counts(rows: DataFrame, good: DataFrame, model: Model, slices: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores before the intercept over all measured ``rows`` and how many positive (ids in ``good``) and how many rows have
    each. Scores are cut to slices (``slices`` a unit, within 100 units of zero), so what the driver gets is bounded."""

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.clip(model.rates(pdf), -100, 100)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "z": np.round(z * slices).astype(np.int64)})

    z = rows.mapInPandas(rated, "doc_id long, z long")
    flagged = z.join(good.select("doc_id", F.lit(1).alias("good")), "doc_id", "left")
    got = flagged.groupBy("z").agg(F.count("good").alias("pos"), F.count("*").alias("unl")).toPandas().sort_values("z")
    return got["z"].to_numpy() / slices, got["pos"].to_numpy(float), got["unl"].to_numpy(float)


def fit(rows: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = 10_000, unlabelled: int = 10_000, bins: int = 10, passes: int = 3) -> Model:
    """Fit on measured ``rows`` (best written before) and ``labels`` (doc_id, quality); see the module docstring.

    At most ``positives`` rows labelled good are used, those with the least hash of their id. The weights start from as
    many of all documents as ``unlabelled`` says and then take ``passes`` - 1 steps over all of them. The prior is estimated
    unless it is given.
    """
    good = labels.where("doc_id is not null and quality > 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    half = good.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)))
    kept, tested = half.where("own = 0").select("doc_id"), half.where("own = 1").select("doc_id")
    start = 0.5 if prior is None else float(prior)
    flat = Model(np.zeros((len(FEATURES), 0)), np.zeros(len(FEATURES) + BUCKETS), float(np.log((start + 1e-6) / (1 - start + 1e-6))), start)
    least = lambda ids, n, seed: ids.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
    any_ = rows.where("doc_id is not null").select("doc_id").distinct()
    chosen = least(kept, positives, 1).withColumn("kind", F.lit(1)).unionByName(least(any_, unlabelled, 2).withColumn("kind", F.lit(0)))
    x = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(*[F.first(c).alias(c) for c in ("x", "bucket", "weight")])
    x = x.toPandas().sort_values(["kind", "doc_id"], kind="stable")
    if not (x["kind"] == 1).any() or rows.join(tested, "doc_id", "left_semi").isEmpty():
        return flat
    model = Model(edges_of(rows, bins), flat.weights, 0.0, start)
    pos, unl = model.matrix(x[x["kind"] == 1]), model.matrix(x[x["kind"] == 0])
    if prior is None:
        start = best_bin_prior(*rate_counts(rows, tested, replace(model, weights=order_fit(pos, unl))))
    w = nn_risk_fit(pos, unl, min(start, 0.99))
    model = descend(rows, replace(model, weights=w[:-1], intercept=float(w[-1]), prior=start), pos, unl, min(start, 0.99), passes)
    scale, intercept = best_cut(*rate_counts(rows, tested, model), min(start, 0.99))
    return replace(model, weights=scale * model.weights, intercept=intercept)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Quality of every measured row; see the module docstring."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = _sigmoid(model.rates(pdf) + model.intercept)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": p, "predicted": (p >= 0.5).astype("int32")})

    return rows.mapInPandas(scored, "doc_id long, score double, predicted int")
