"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding, normalised by length, with exceptions.

:func:`fit` learns the lexicon from labelled rows: whole words and word beginnings that labelled toxic documents hold far
more often than clean ones, each weighted by its log odds, and as exceptions the words that begin like a lexicon entry
and the phrases (an entry's word with the word before it, after it, or both) that only clean documents hold. A hit that
starts inside an exception does not count. :func:`score` gives every document doc_id, score (0 to 1), predicted (score of
at least 0.5), hits and words.

Folding lowers case, maps homoglyphs to Latin letters and, next to letters, digits and signs to the letters they stand
for. Null and empty texts score as a document without hits. Without labelled rows of both kinds the lexicon is empty and
the score is the share of toxic rows (0 for none). Repeated rows are each scored; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import bounded, checkpointed

# Letters of other scripts that look like Latin ones, and what digits and signs stand for inside words.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ɡ": "g", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "ո": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ս": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_SIGN = re.compile(r"(?<=[^\W\d_])[013457]|[013457](?=[^\W\d_])|[@$](?=[^\W\d_])|(?<=[^\W\d_])!(?=[^\W\d_])")
_HAS_SIGN = re.compile(r"[013457@$!]")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words of a text, each between single spaces."""
    t = (text or "").lower().translate(_FOLD)
    if _HAS_SIGN.search(t):
        t = _SIGN.sub(lambda m: SIGNS[m[0]], t)
        t = _SIGN.sub(lambda m: SIGNS[m[0]], t)  # a run of two signs has its second one beside a letter now
    return " " + _GAP.sub(" ", t).strip() + " "


def entries(word: str, shortest: int = 4, longest: int = 7) -> list[str]:
    """Lexicon candidates of a folded word: the whole word and its beginnings."""
    return [f" {word} "] + [" " + word[:k] for k in range(shortest, min(longest, len(word) - 1) + 1)]


def unspared(found) -> dict[int, float]:
    """Greatest weight by start of the matches (end, (pattern, weight)) that start in no exception (weight 0).

    Starts and exceptions are gone through once in order, with the furthest end of the exceptions begun so far."""
    at: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (p, w) in found:
        start = end - len(p) + 1
        if w:
            at[start] = max(w, at.get(start, 0.0))
        else:
            spared.append((start, end))
    if spared:
        spared.sort()
        i, reach = 0, -1
        for start in sorted(at):
            while i < len(spared) and spared[i][0] <= start:
                reach = max(reach, spared[i][1])
                i += 1
            if start < reach:
                del at[start]
    return at


def phrases(text: str | None, matcher) -> set[str]:
    """Folded phrases around the words in which the matcher's entries start: with the word before, after, and both."""
    t, out = fold(text), set()
    for start in unspared(matcher.iter(t)) if len(matcher) and len(t) > 2 else ():
        end = t.index(" ", start + 1)
        before = t.rfind(" ", 0, start) if start else -1
        after = t.find(" ", end + 1)
        if before >= 0:
            out.add(t[before : end + 1])
        if after >= 0:
            out.add(t[start : after + 1])
        if before >= 0 and after >= 0:
            out.add(t[before : after + 1])
    return out


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    intercept: float

    def matcher(self):
        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (p, w))
        for p in self.exceptions:
            found.add_word(p, (p, 0.0))
        if len(found):
            found.make_automaton()
        return found

    def rate(self, text: str | None, matcher) -> tuple[float, int, int]:
        """Weight of the hits over the logarithm of the length, number of hits, number of words."""
        t = fold(text)
        words = t.count(" ") - 1 if len(t) > 2 else 0
        if not len(matcher) or not words:
            return 0.0, 0, words
        hits = unspared(matcher.iter(t))
        return sum(hits.values()) / math.log2(2 + words), len(hits), words

    def probability(self, rate: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * rate + self.intercept))))


def _count(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """Counts of candidates in clean and toxic texts; handed on whenever ``most`` have gathered, to be summed later."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pd.DataFrame:
        keys = list(seen[0].keys() | seen[1].keys())
        made = pd.DataFrame({"entry": keys, "neg": [seen[0][k] for k in keys], "pos": [seen[1][k] for k in keys]})
        seen[0].clear(), seen[1].clear()
        return made

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            seen[int(toxic)].update(e for w in set(fold(text).split()) for e in entries(w))
            if len(seen[0]) + len(seen[1]) > most:
                yield out()
    if seen[0] or seen[1]:
        yield out()


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a slight ridge, so that separable data stay finite."""
    a, b = 0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.05 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def explaining(texts: list, neg: list[int], base: float, least: float) -> list[int]:
    """Entries that explain toxic texts, best first: each pick halves what the texts that hold it still count, so words
    that only come along in near copies of texts already explained fall under the bound ``least``."""
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    entry = np.concatenate([np.asarray(t, np.int64) for t in texts]) if len(doc) else np.zeros(0, np.int64)
    left, miss, picked = np.ones(len(texts)), np.asarray(neg, float), []
    open_ = np.ones(len(neg), bool)
    while open_.any():
        gain = np.bincount(entry, left[doc], len(neg))
        n = gain + miss + 1e-12
        ratio = gain * np.log(np.maximum(gain, 1e-12) / n / base) + miss * np.log(np.maximum(miss, 1e-12) / n / (1 - base))
        ratio[~open_ | (gain / n <= base)] = -1
        i = int(ratio.argmax())
        if ratio[i] <= least:
            break
        picked.append(i)
        open_[i] = False
        left[np.unique(doc[entry == i])] /= 2
    return picked


def _phrase_counts(lexicon: Lexicon):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = lexicon.matcher()
        for pdf in batches:
            found = [(p, int(toxic)) for text, toxic in zip(pdf["text"], pdf["toxic"]) for p in phrases(text, m)]
            made = pd.DataFrame(found, columns=["entry", "toxic"])
            yield made.groupby("entry")["toxic"].agg(["count", "sum"]).reset_index().rename(columns={"count": "n", "sum": "pos"})

    return count


def fit(docs: DataFrame, labels: DataFrame, sample: int = 15_000) -> Lexicon:
    """Learn a lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    At most ``sample`` labelled documents are used, those with the least hash of their id; that bound also bounds what
    is broadcast. Copies of a text count once; a beginning (of 4 to 7 letters, see :func:`entries`) counts for each distinct
    word of a text that has it. Entries and exceptions have no limit of their own: all come from the sampled texts, and none
    is taken that chance explains, so an entry stands in several toxic texts. An entry's likelihood ratio must exceed the
    logarithm of the number of candidates. A phrase is an exception if no toxic text has it and if, with the share of
    toxic texts among those with phrases of entries, as many clean ones in a row are too many for chance as well.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    train = checkpointed(train)
    counts = bounded(train).mapInPandas(_count, "entry string, neg long, pos long").groupBy("entry").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = checkpointed(counts.where("pos > 1 or neg > 2"))
    totals = {int(r["toxic"]): r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, (), 0.0, 30.0 if pos else -30.0)
    base, n = pos / (pos + neg), F.col("pos") + F.col("neg")
    ratio = F.col("pos") * F.log(F.col("pos") / n / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / n / (1 - base))).otherwise(0)
    weight = F.log((F.col("pos") + 0.5) / (pos + 1) / ((F.col("neg") + 0.5) / (neg + 1)))
    strong = counts.where(F.col("pos") / n > base).withColumns({"ratio": ratio, "weight": weight}).where((F.col("ratio") > math.log(1 + counts.count())) & (F.col("weight") > 1.5))
    best = strong.orderBy(F.desc("ratio"), F.desc(F.length("entry")), "entry").collect()
    place = {r["entry"]: i for i, r in enumerate(best)}

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"held": [[place[e] for w in set(fold(t).split()) for e in entries(w) if e in place] for t in pdf["text"]]})

    texts = train.where("toxic = 1").mapInPandas(held, "held array<int>").toPandas()["held"].tolist()
    weights: dict[str, float] = {}
    for i in explaining(texts, [r["neg"] for r in best], base, math.log(1 + counts.count())):
        e = best[i]["entry"]
        covered = any(e[:k] in weights for k in range(2, len(e) + 1)) or any(w.startswith(e) for w in weights)
        if not covered:
            weights[e] = best[i]["weight"]
    heads = sorted({e for e in weights if not e.endswith(" ")})
    like = F.lit(False)
    for k in {len(h) for h in heads}:
        like = like | F.substring("entry", 1, k).isin([h for h in heads if len(h) == k])
    spared = counts.where((F.col("pos") == 0) & (F.col("neg") > 2) & F.col("entry").endswith(" ") & like)
    exceptions = tuple(sorted(r["entry"] for r in spared.collect()))
    found = Lexicon(weights, exceptions, 1.0, 0.0)
    held_phrases = checkpointed(train.mapInPandas(_phrase_counts(found), "entry string, n long, pos long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
    kinds, n_all, n_toxic = held_phrases.agg(F.count("*"), F.sum("n"), F.sum("pos")).first()
    if kinds and n_toxic:
        clean_share = max(1 - n_toxic / n_all, 1e-6)
        least = math.log(1 + kinds) / -math.log(clean_share) if clean_share < 1 else math.inf
        safe = held_phrases.where((F.col("pos") == 0) & (F.col("n") > max(2.0, least)))
        exceptions += tuple(sorted(r["entry"] for r in safe.collect()))
        found = Lexicon(weights, exceptions, 1.0, 0.0)

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = found.matcher()
        for pdf in batches:
            yield pd.DataFrame({"x": [found.rate(t, m)[0] for t in pdf["text"]], "y": pdf["toxic"].astype("int32")})

    xy = train.mapInPandas(rates, "x double, y int").toPandas()
    slope, intercept = _logistic(xy["x"].to_numpy(), xy["y"].to_numpy(float))
    return Lexicon(weights, exceptions, slope, intercept)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Score of every whole text of ``docs`` (doc_id, text, ...); see the module docstring."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = lexicon.matcher()
        for pdf in batches:
            out = [lexicon.rate(t, m) for t in pdf["text"]]
            p = np.array([lexicon.probability(x) for x, _, _ in out])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": p, "predicted": (p >= 0.5).astype("int32"), "hits": [h for _, h, _ in out], "words": [w for _, _, w in out]})

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(ids).mapInPandas(scored, "doc_id long, score double, predicted int, hits long, words long")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without the documents predicted toxic; columns and their order as they came. Only the text goes to Python,
    only the verdict comes back, and nothing is shuffled."""

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = lexicon.matcher()
        for texts in batches:
            yield pd.Series([lexicon.probability(lexicon.rate(t, m)[0]) < 0.5 for t in texts], dtype=bool)

    return bounded(docs).where(F.pandas_udf(clean, T.BooleanType())(F.col("text").cast("string")))
