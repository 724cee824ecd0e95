"""Periodic runs of words, found by multi-scale minimizers, and texts with their repetitions collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(12, 2 q) that no neighbouring word extends keeping period q. :func:`find` gives for each row doc_id, n_words, runs
(array of start, length, period by start, then period, in words from 0) and collapsed: the words that no run contains
after its first q words, joined by one space.

Words are runs of characters other than ASCII white space, compared as they are. A null text has no words: no runs and an
empty collapsed text. Every row is a document of its own, also where rows share a doc_id or have none; extra columns are
ignored. A text is worked on whole in one task, in memory of some 25 times its bytes.

Periods up to 32 words are found by comparing each word with the one a period before it. Beyond, one scale w for each
doubling covers the periods in (w, 2 w]: every window of w - 1 words chooses the least hash among its runs of w / 2 words.
Inside a run equal windows lie a period apart and choose equal places, so each run holds a pair of equal minimizers at
distance q, which is extended word by word. Equal minimizers that follow one another closely lie in a run of a shorter
period; they are taken as one arithmetic progression, of which two give one seed per distance and one alone gives none: so
the seeds are proportional to the minimizers, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bounded

SHORT = 32  # periods up to this are scanned directly; a power of two
LEAST = 12  # words of the shortest run
SHAPE = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _join(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the stretches of 2 k words from those of k words."""
    return _mix(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash, the first of equals, in each window of ``width`` (a power of two) hashes."""
    if len(h) < width:
        return np.empty(0, np.int64)
    low = np.uint64((1 << len(h).bit_length()) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # which ties these are depends on the window's words alone
    m = 1
    while m < width:
        best = np.minimum(best[:-m], best[m:])
        m *= 2
    return (best[np.concatenate(([True], best[1:] != best[:-1]))] & low).astype(np.int64)


def equal_for(x: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For each pair of places, how many words from there on (step 1) or back (step -1) are equal, at most ``most``."""
    out = np.zeros(len(a), np.int64)
    open_, width = np.arange(len(a)), 16
    while len(open_):
        following = []
        for lo in range(0, len(open_), max(1, (1 << 20) // width)):
            i = open_[lo : lo + max(1, (1 << 20) // width)]
            ahead = out[i, None] + np.arange(width)
            p, q = a[i, None] + step * ahead, b[i, None] + step * ahead
            inside = (ahead < most[i, None]) & (np.minimum(p, q) >= 0) & (np.maximum(p, q) < len(x))
            same = inside & (x[np.clip(p, 0, len(x) - 1)] == x[np.clip(q, 0, len(x) - 1)])
            n = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[i] += n
            following.append(i[n == width])
        open_, width = np.concatenate(following), min(2 * width, 4096)
    return out


def chains(h: np.ndarray, at: np.ndarray, near: int) -> tuple[np.ndarray, ...]:
    """Equal minimizers as arithmetic progressions with steps of at most ``near``: (hash, first, last, step, count), by
    hash and place; a lone one has step 0 and count 1."""
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    same = h[1:] == h[:-1]
    grouped = np.concatenate((same, [False])) | np.concatenate(([False], same))
    h, at = h[grouped], at[grouped]
    if not len(h):
        return h, at, at, at, at
    gap = np.diff(at)
    link = (h[1:] == h[:-1]) & (gap <= near)
    link[1:] &= ~(link[:-1] & (gap[1:] != gap[:-1]))
    head = np.flatnonzero(np.concatenate(([True], ~link)))
    tail = np.concatenate((head[1:] - 1, [len(at) - 1]))
    step = np.where(tail > head, np.concatenate((gap, [0]))[head], 0)
    return h[head], at[head], at[tail], step, tail - head + 1


def seeds(h: np.ndarray, first: np.ndarray, last: np.ndarray, step: np.ndarray, count: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, place) of one pair of equal minimizers for each distance in (w, 2 w] that two progressions have."""
    lags, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in range(1, len(h)):
        a = np.flatnonzero((h[r:] == h[:-r]) & (first[r:] - last[:-r] <= 2 * w))
        if not len(a):
            break
        b = a + r
        base = first[b] - last[a]
        unlike = (step[a] > 0) & (step[b] > 0) & (step[a] != step[b])
        for i, j in zip(a[unlike], b[unlike]):
            p, q = np.arange(count[i]) * step[i] + first[i], np.arange(count[j]) * step[j] + first[j]
            p = p[p >= first[j] - 2 * w]
            for place in p:  # few: two periods of one stretch of words cannot both be short
                lag = q[(q - place > w) & (q - place <= 2 * w)] - place
                lags.append(lag)
                places.append(np.full(len(lag), place))
        a, b, base = a[~unlike], b[~unlike], base[~unlike]
        g = np.maximum(np.maximum(step[a], step[b]), 1)
        low = np.maximum(0, -((base - w - 1) // g))
        high = np.minimum(count[a] + count[b] - 2, (2 * w - base) // g)
        n = np.maximum(0, high - low + 1)
        own = np.repeat(np.arange(len(a)), n)
        t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[own]
        back = np.minimum(t, count[a][own] - 1)
        lags.append(base[own] + t * g[own])
        places.append(last[a][own] - back * g[own])
    return np.concatenate(lags), np.concatenate(places)


def extended(x: np.ndarray, lag: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Rows (start, end, period) of the maximal stretches around the seeds that are two periods long or more."""
    order = np.lexsort((at, lag))
    lag, at = lag[order], at[order]
    keep = np.concatenate(([True], (lag[1:] != lag[:-1]) | (at[1:] != at[:-1]))) if len(lag) else np.empty(0, bool)
    lag, at = lag[keep], at[keep]
    if not len(lag):
        return np.empty((0, 3), np.int64)
    # a seed need only be followed to the next of its distance, where that is near
    next_ = np.where((lag[1:] == lag[:-1]) & (np.diff(at) <= 2 * w), np.diff(at), len(x))
    next_ = np.concatenate((next_, [len(x)]))
    ahead = equal_for(x, at, at + lag, next_, 1)
    joined = ahead >= next_
    head = np.flatnonzero(np.concatenate(([True], ~joined[:-1])))
    tail = np.concatenate((head[1:] - 1, [len(at) - 1]))
    back = equal_for(x, at[head] - 1, at[head] - 1 + lag[head], np.full(len(head), len(x)), -1)
    start, end = at[head] - back, at[tail] + ahead[tail]
    long = end - start >= lag[head]
    return np.stack((start, end + lag[head], lag[head]), axis=1)[long]


def runs_of(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs (start, end, period), by start and period, in a sequence of word numbers made of parts of the given sizes,
    each followed by one number that nothing else has (so no run crosses it)."""
    found = []
    longest = int(sizes.max()) if len(sizes) else 0
    for q in range(1, min(SHORT, longest // 2, longest - LEAST + 1 if longest >= LEAST else 0) + 1):
        hit = np.flatnonzero(x[q:] == x[:-q])
        if len(hit):
            cut = np.flatnonzero(np.diff(hit) != 1)
            first, last = hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))]
            ok = last - first + 1 >= max(LEAST - q, q)
            found.append(np.stack((first[ok], last[ok] + 1 + q, np.full(ok.sum(), q)), axis=1))
    w, h, at = SHORT, None, np.arange(len(x))
    while longest >= 2 * w + 2:
        wide = np.repeat(sizes >= 2 * w + 2, sizes + 1)  # shorter parts hold no such run
        x, at, sizes = x[wide], at[wide], sizes[sizes >= 2 * w + 2]
        if h is None:
            h, k = _mix(x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)), 1
        else:
            h = h[wide[: len(h)]]
        while 2 * k <= w:
            h, k = _join(h, k), 2 * k
            if 2 * k == w:
                break
        place = minimizers(h, k)
        lag, seed = seeds(*chains(h[place], place, k // 2), w)
        stretch = extended(x, lag, seed, w)
        stretch[:, 0], stretch[:, 1] = at[stretch[:, 0]], at[stretch[:, 1] - 1] + 1
        found.append(stretch)
        w *= 2
    every = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    # a stretch found at a multiple of its smallest period equals the one found there
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    smallest = np.concatenate(([True], (every[1:, :2] != every[:-1, :2]).any(axis=1))) if len(every) else np.empty(0, bool)
    every = every[smallest]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def collapsed(texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """(number of words, runs as (start, length, period), collapsed text) of each text."""
    split = [(t or "").encode().split() for t in texts]  # of bytes: at ASCII white space alone
    sizes = np.array([len(s) for s in split], np.int64)
    words = [w for s in split for w in s]
    begin = np.cumsum(sizes + 1) - sizes - 1
    x = np.empty(sizes.sum() + len(split), np.int64)
    inner = np.ones(len(x), bool)
    inner[begin + sizes] = False
    x[inner] = pd.factorize(np.array(words + [None], object)[:-1])[0] if words else 0
    x[~inner] = -1 - np.arange(len(split))
    runs = runs_of(x, sizes)
    edge = np.zeros(len(x) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    part = np.searchsorted(runs[:, 0], np.concatenate((begin, [len(x)])))
    out = []
    for i, s in enumerate(split):
        own = runs[part[i] : part[i + 1]]
        rest = compress(s, kept[begin[i] : begin[i] + sizes[i]].tolist()) if len(own) else s
        out.append((len(s), [(int(a - begin[i]), int(b - a), int(q)) for a, b, q in own], b" ".join(rest).decode()))
    return out


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = pd.DataFrame(collapsed(pdf["text"].tolist()), columns=["n_words", "runs", "collapsed"])
        made.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        yield made


def find(docs: DataFrame) -> DataFrame:
    """Runs and collapsed text of every row of ``docs`` (doc_id, text, ...); see the module docstring. No shuffle."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(texts).mapInPandas(_batches, SHAPE)
