"""Language ID by rank order of n-grams.

A text's letters are lower-cased, everything else is one space, and its 1- to 3-grams that do not
cross a word are counted. A language's profile is the order of its most frequent n-grams over its training
documents. A document's most frequent n-grams are compared to each profile by out-of-place distance: the
sum of the differences in rank, `profile_size` for an n-gram the profile lacks, as a share of the most possible.
The nearest language wins (ties: the smaller name); its score is its share of exp(-40 * distance).

Training documents: at most about `per_language` of each language, taken by a hash of the text; the languages are
few (the profiles travel with the tasks: `profile_size` entries each). Scoring has no shuffle.

Defined cases: a null text or one without a letter is `und` with score 0; very long texts are read whole; repeated
rows are scored each; with no training row every text is `und`; an empty table gives no rows; columns named `lang_pred`, `score`
or `distance` are replaced by the results, all others asked for stay as they are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskloom.llm.shared import crc_mod, tidy

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashed 1- to 3-grams of a text, in sorted order with repeats."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a word
    keep[0] = True
    c, letter = np.where(letter, c, 32)[keep].astype(np.uint64), letter[keep]
    m = np.uint64(0x9E3779B97F4A7C15)
    one = c * m
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) + c[2:] * np.uint64(0xC4CEB9FE1A85EC53)
    out = np.concatenate([one[letter], (two * m)[letter[:-1] | letter[1:]], (three * m)[letter[1:-1]]])
    out = (out >> np.uint64(32)).astype(np.uint32)
    out.sort()
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts."""
    g = grams(text)
    if not len(g):
        return g, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return g[first], np.diff(np.r_[first, len(g)])


def ranked(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by n-gram."""
    g, n = counted(text)
    key = (n.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - g.astype(np.uint64))
    if len(key) > size:
        key = np.partition(key, len(key) - size)[-size:]
    return (np.uint64(0xFFFFFFFF) - (np.sort(key)[::-1] & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", profile_size: int = 400, per_language: int = 4000) -> dict[str, list[int]]:
    """Profiles of the languages of the labelled rows: n-grams by falling count."""
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    sample = rows.where(unit < share[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[int, int]] = {}
        for b in batches:
            for t, name in zip(b["text"], b["lang"]):
                own = held.setdefault(name, {})
                g, n = counted(t)
                for x, k in zip(g.tolist(), n.tolist()):
                    own[x] = own.get(x, 0) + k
                if len(own) > 200_000:
                    yield pd.DataFrame({"lang": name, "gram": list(own), "n": list(own.values())})
                    own.clear()
        for name, own in held.items():
            if own:
                yield pd.DataFrame({"lang": name, "gram": list(own), "n": list(own.values())})

    counts = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    out = {}
    for name in sorted(sizes):
        top = counts.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(profile_size).collect()
        out[name] = [r["gram"] for r in top]
    counts.unpersist()
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], columns: list[str], text: str = "text") -> DataFrame:
    """`columns` of docs, as they are, and lang_pred, score, distance (0 to 1, of the winner), which replace columns of these names."""
    names, size = sorted(profiles), max([1, *map(len, profiles.values())])
    tables = []
    for name in names:
        g = np.array(profiles[name], np.uint32)
        order = np.argsort(g)
        tables.append((g[order], order.astype(np.int64)))

    def one(t: str | None) -> tuple[str, float, float]:
        mine = ranked(t, size) if t and names else ()
        if not len(mine):
            return UNKNOWN, 0.0, 1.0
        at, d = np.arange(len(mine)), []
        for g, rank in tables:
            k = np.minimum(np.searchsorted(g, mine), max(0, len(g) - 1))
            hit = g[k] == mine if len(g) else np.zeros(len(mine), bool)
            d.append(float(np.where(hit, np.abs(rank[k] - at) if len(g) else 0, size).sum()) / (size * len(mine)))
        d = np.array(d)
        best = int(np.argmin(d))
        return names[best], float(1 / np.exp(-40 * (d - d[best])).sum()), float(d[best])

    kept = [c for c in columns if c not in ("lang_pred", "score", "distance")]
    fields = StructType([docs.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double").add("distance", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t.as_py()) for t in b.column(len(kept))]
            made = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(b.columns[: len(kept)] + made, [*kept, "lang_pred", "score", "distance"])
        tidy()

    return docs.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(run, fields)


def digest(docs: DataFrame) -> DataFrame:
    """Learn from documents with crc32(doc_id) mod 5 not 0 and predict all."""
    profiles = learn(docs.where(crc_mod("doc_id", 5) != 0))
    return predict(docs, profiles, ["doc_id"]).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "distance")
