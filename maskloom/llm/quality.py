"""Quality scores from pairwise preferences (Bradley-Terry).

Each whole text becomes a row of surface features (shares of characters, repetition of words, pairs and
lines, shape of words). Of labelled training rows a uniform sample of at most about `sample` is used (a documented bound, taken
by a hash of the key). Each sampled row is paired with `rivals` rows of the other label; the model is the
logistic loss on the difference of the features, (good - bad), with a small ridge, fitted by Newton steps. The threshold is the
quantile of the sample's scores at the share of bad rows; a text at the threshold has the score `cut`.

Features are computed once, in one pass without a shuffle, and kept as a small table; labels meet that table, never texts.

Defined cases: a null text is an empty one and is scored; very long texts are read whole; repeated rows are scored each; a key
labelled several times counts as good if any label is; without training rows of both labels every score is `cut`; an empty table
gives no rows; other columns are not read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import crc_mod, in_share, written

NAMES = ("letters", "upper", "digits", "symbols", "marks", "space", "length", "short", "word_mean", "word_spread", "distinct", "distinct_pairs", "top_word", "same_next", "line_repeats", "line_length", "odd_ends", "bare_symbols", "capitals", "ends", "long_words", "odd_inside", "empty")
_MARKS = frozenset(map(ord, ".,;:?'\"()-"))


def _kind(c: str) -> int:
    """0 letter (or a mark upon one), 1 capital, 2 digit, 3 white space, 4 usual mark, 5 other symbol."""
    if c.isascii():
        return 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4 if ord(c) in _MARKS else 5
    return 1 if c.isupper() else 0 if c.isalpha() else 3 if c.isspace() else {"M": 0, "N": 2, "P": 4}.get(category(c)[0], 5)


_ASCII = np.array([_kind(chr(i)) for i in range(128)], np.uint8)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point of any script."""
    return np.fromiter((_kind(chr(i)) for i in range(0x110000)), np.uint8, 0x110000)


def features(text: str | None) -> np.ndarray:
    text = text or ""
    words = text.split()
    if not words:
        return np.array([0.0] * (len(NAMES) - 1) + [1.0], np.float32)
    raw = _ASCII[np.frombuffer(text.encode(), np.uint8)] if text.isascii() else _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    kinds = np.bincount(raw, minlength=6) / len(raw)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    same = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    last = Counter(w[-1] for w in words)
    odd = sum(k for c, k in last.items() if not c.isalnum() and c not in ".,;:?\"')")
    bare = sum(k for w, k in counts.items() if not any(map(str.isalnum, w))) / n
    first = sum(k for w, k in counts.items() if w[0].isupper())
    inside = sum(k for w, k in counts.items() if not w[:-1].isalpha() and len(w) > 1)
    return np.array(
        [kinds[0] + kinds[1], kinds[1] / max(1e-9, kinds[0] + kinds[1]), kinds[2], kinds[5], kinds[4], kinds[3], np.log1p(n), n < 30, sizes.mean(), sizes.std(),
         len(counts) / n * min(1.0, n**0.3 / 6), pairs, max(counts.values()) / n, same, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), odd / n, bare, first / n,
         (last["."] + last["!"] + last["?"]) / n, (sizes > 20).mean(), inside / n, 0.0],
        np.float32,
    )


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and features of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "features": [features(t) for t in b["text"]]})

    ids = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return ids.mapInPandas(run, "id string, features array<float>").select(F.col("id").cast("long").alias("doc_id"), "features")


def _wide(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - middle) / spread, -6, 6)
    return np.c_[z, np.abs(z), np.maximum(0, z - 1)]


class Preference:
    """A fitted Bradley-Terry model with its threshold."""

    def __init__(self, x: np.ndarray, good: np.ndarray, rivals: int, cut: float, seed: int = 11):
        self.cut, self.weights = cut, None
        if not len(x) or good.all() or not good.any():
            return
        self.middle, self.spread = np.median(x, 0), x.std(0) + 1e-3
        z = _wide(x, self.middle, self.spread)
        rng = np.random.default_rng(seed)
        yes, no = np.flatnonzero(good), np.flatnonzero(~good)
        d = np.r_[z[np.repeat(yes, rivals)] - z[rng.choice(no, len(yes) * rivals)], z[rng.choice(yes, len(no) * rivals)] - z[np.repeat(no, rivals)]]
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + len(d) * 2e-4 * np.eye(len(w)), d.T @ p - len(d) * 2e-4 * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        raw = z @ w
        self.weights = w
        self.threshold = float(np.quantile(raw, (~good).mean()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.cut)
        raw = _wide(x, self.middle, self.spread) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold, -30, 30) - np.log(self.cut / (1 - self.cut))))


def learn(rows: DataFrame, labels: DataFrame, label: str, sample: int = 40_000, rivals: int = 4, cut: float = 0.3) -> Preference:
    """Fit on `rows` (doc_id, features) that have a label. The sample is bounded, so the driver may hold it."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, sample / max(1, marked.count()))
    chosen = marked.where(in_share("doc_id", share))
    got = rows.join(F.broadcast(chosen), "doc_id").select("features", "y").orderBy("doc_id").collect()
    return Preference(np.array([r["features"] for r in got], float).reshape(-1, len(NAMES)), np.array([r["y"] == 1 for r in got], bool), rivals, cut)


def scored(rows: DataFrame, model: Preference) -> DataFrame:
    """doc_id and score from doc_id and features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "score": model.score(np.array(b["features"].tolist(), float))})

    return rows.select(F.col("doc_id").cast("string").alias("id"), "features").mapInPandas(run, "id string, score double").select(F.col("id").cast("long").alias("doc_id"), "score")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels with crc32(doc_id) mod 5 not 0 and score all documents."""
    rows = written(featured(docs), "quality-features")
    model = learn(rows, labels.where(crc_mod("doc_id", 5) != 0), "quality")
    return scored(rows, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
