"""Language identification with a blended-spectrum string kernel.

The kernel counts the character n-grams (one to three) that two texts share, by presence, each length normalised by the
texts' own numbers of n-grams and the lengths averaged. A set of landmark documents gives Nyström features; one-versus-
rest ridge regression on those is fitted on a bounded sample, and every document is scored by matrix products.

:func:`predict` returns doc_id, lang_pred and score (0 to 1). A null text, or one without a letter, is ``und`` with
score 0; so is every text if no row could be learned from. Repeated rows are each scored; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bounded


# Hash bits of one-, two- and three-character n-grams.
BITS = (10, 12, 14)
DIM = sum(1 << b for b in BITS)
_LETTER = re.compile(r"[^\W\d_]")


def presence(texts: list[str]) -> np.ndarray:
    """0/1 matrix of hashed n-gram presence, one row per text."""
    out = np.zeros((len(texts), DIM), np.uint8)
    mult = np.uint32(2654435761)
    for row, text in zip(out, texts):
        h = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        gram, base = h, 0
        for n, bits in enumerate(BITS):
            if n:
                gram = gram[:-1] * np.uint32(0x01000193) + h[n:]
            row[base + ((gram * mult) >> np.uint32(32 - bits))] = 1
            base += 1 << bits
            if len(gram) < 2:
                break
    return out


def scaled(presence_rows: np.ndarray) -> np.ndarray:
    """Presence rows with each n-gram length brought to length one, so that the kernel is the mean of plain products."""
    out, base = presence_rows.astype(np.float32), 0
    for bits in BITS:
        part = out[:, base : base + (1 << bits)]
        part /= np.sqrt(np.maximum(part.sum(1), 1))[:, None]
        base += 1 << bits
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Blended kernel between the rows of two presence matrices."""
    return scaled(a) @ scaled(b).T / len(BITS)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits
    alpha: np.ndarray

    def marks(self) -> np.ndarray:
        """Landmarks as scaled rows, made once for each worker."""
        return scaled(np.unpackbits(self.landmarks, axis=1)[:, :DIM])

    def scores(self, texts: list[str], marks: np.ndarray) -> np.ndarray:
        return scaled(presence(texts)) @ marks.T @ self.alpha / len(BITS)


def train(packed: np.ndarray, langs: list[str], y: np.ndarray, landmarks: int, least_marks: int, ridge: float) -> Model:
    """Nyström ridge regression on packed presence bits with language numbers y."""
    rng = np.random.default_rng(7)
    per = max(least_marks, landmarks // len(langs))
    at = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:per] for c in range(len(langs))])
    marks = scaled(np.unpackbits(packed[at], axis=1)[:, :DIM])
    k_mm = (marks @ marks.T).astype(np.float64) / len(BITS)
    value, vector = np.linalg.eigh(k_mm + 1e-6 * np.eye(len(at)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    gram, moment = np.zeros((len(at), len(at))), np.zeros((len(at), len(langs)))
    for i in range(0, len(packed), 256):  # slices of rows: no matrix of all rows and all landmarks or languages
        z = (scaled(np.unpackbits(packed[i : i + 256], axis=1)[:, :DIM]) @ marks.T / len(BITS)) @ root
        gram += z.T @ z
        moment += z.T @ np.where(y[i : i + 256, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    w = np.linalg.solve(gram + ridge * np.eye(len(at)), moment)
    return Model(langs, packed[at], (root @ w).astype(np.float32))


def fit(docs: DataFrame, sample: int = 3000, least: int = 40, landmarks: int = 96, least_marks: int = 2, ridge: float = 1e-2) -> Model | None:
    """Fit on ``docs`` (doc_id, text, lang): about ``sample`` rows with a language, in proportion to their numbers of ids but about
    ``least`` of each language at least, those with the least hash of their id; rows that share an id and a language
    count once. ``landmarks`` of them, ``least_marks`` of each language at least, are landmarks, so any number of languages
    is learned. The driver gets each language's number of rows and the sample's presence bits, a fixed few kilobytes a
    row, not the texts."""
    known = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "text", "lang")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counted = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"), F.min(spot).alias("first")).collect()
    total = sum(r["n"] for r in counted)
    if not counted:
        return None
    # in proportion, so the fit knows what is common; a share of the hash range each, so no language's rows ever meet, and
    # the least hash of each, so none is left out
    share = [(r["lang"], max(r["first"], int(min(1.0, max(least, sample * r["n"] / total) / max(r["n"], 1)) * (1 << 30)))) for r in counted]
    shares = docs.sparkSession.createDataFrame(share, "lang string, __share long")
    chosen = known.join(F.broadcast(shares), "lang").where(spot <= F.col("__share")).select("doc_id", "text", "lang")

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [np.packbits(presence([t])[0]).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "bits": packed})

    got = bounded(chosen).mapInPandas(bits, "doc_id long, lang string, bits binary").groupBy("doc_id", "lang").agg(F.min("bits").alias("bits"))
    got = got.toPandas().sort_values(["lang", "doc_id"], kind="stable")
    langs = sorted(set(got["lang"]))
    number = {g: i for i, g in enumerate(langs)}
    packed = np.stack([np.frombuffer(b, np.uint8) for b in got["bits"]])
    return train(packed, langs, got["lang"].map(number).to_numpy(), landmarks, least_marks, ridge)


def predict(docs: DataFrame, model: Model | None, batch: int = 128) -> DataFrame:
    """Language of every whole text of ``docs`` (doc_id, text, ...); see the module docstring."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = None if model is None else model.marks()
        for pdf in batches:
            lang, sure = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            texts = pdf["text"].tolist()
            ok = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
            for lo in range(0, len(ok), batch):
                part = ok[lo : lo + batch]
                s = model.scores([texts[i] for i in part], marks)
                e = np.exp(3.0 * (s - s.max(1, keepdims=True)))
                lang[part] = [model.languages[j] for j in s.argmax(1)]
                sure[part] = (e / e.sum(1, keepdims=True)).max(1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": np.clip(sure, 0, 1)})

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(ids).mapInPandas(scored, "doc_id long, lang_pred string, score double")
