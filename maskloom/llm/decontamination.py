"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are reduced to normal words. An item of m characters may be found with at most k = floor(rate * m) edits. It is
split into k + 1 pieces: whatever the k edits, one piece is left exactly. One automaton of all pieces finds every
exact piece in a text; each hit says where the item would lie. Places of one item that overlap are joined; those with too few of the
item's runs of three characters for the budget (each edit breaks three) are dropped, the others verified with Myers'
bit-parallel distance, for many places at once in numpy words of 64 bits; the text before an end is read backwards for the start.

The items go to the tasks in groups of at most `group` items (a documented bound), one pass over the documents for each; a group is sent
once and made ready once in each Python worker; documents are not shuffled. Long places, as where a text repeats an item over and over, are
verified in overlapping pieces of a few items' length, and the tables of a step are bounded by their bytes, so memory does not grow with a text's length.

Defined cases: null or empty texts and items match nothing, and items with a null id are left out; a row with a null key is searched like any other (its results have
no doc_id), rows that share a key are searched each, and `clean` judges each row by its own text alone; an item too short for any edit (fewer than 1 / rate normal characters)
must stand as whole words; very long texts are read whole; equal items are found each; repeated rows are searched each; empty tables give
no rows; other columns are not read.

The result is one row per document and item found: doc_id, item_id, start and end (in the characters of the text's normal words) and distance."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import tidy, written
from maskloom.llm.words import normal

SCHEMA = "doc_id long, item_id long, start int, end int, distance int"


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of the item with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _threes(coded: np.ndarray) -> np.ndarray:
    """Hashed runs of three characters, 0 to 2047."""
    c = coded
    return (c[:-2] * 961 + c[1:-1] * 37 + c[2:]) * 0x9E3779B1 >> 7 & 2047


def _bounded(sizes: np.ndarray, most: int, cells: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of at most `most` texts whose table, their number times the longest, has at most `cells` cells (or one text)."""
    at = 0
    while at < len(sizes):
        longest = np.maximum.accumulate(sizes[at : at + most])
        n = max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1), cells, "right")))
        yield at, at + n
        at += n


class Patterns:
    """Bit masks of many items by character, in 64-bit words: one row for each character that an item has, so memory follows the items' lengths."""

    def __init__(self, texts: list[str]):
        coded = [self.coded(t) for t in texts]
        self.m = np.array([len(t) for t in texts], np.int64)
        self.words = (self.m + 63) // 64
        self.threes = [_threes(c) for c in coded]
        owner = np.repeat(np.arange(len(texts)), self.m)
        #: Pairs of item and character, in order; `row` is a pair's row among the masks of its item's number of words (row 0: no bit).
        self.pairs, back = np.unique(self._pair(owner, np.concatenate([*coded, np.zeros(0, np.int64)])), return_inverse=True)
        own_words, self.row, self.masks = self.words[self.pairs >> 21], np.zeros(len(self.pairs), np.int64), {}
        place = np.arange(len(owner)) - np.repeat(np.cumsum(self.m) - self.m, self.m)
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(own_words == w)
            self.row[own] = np.arange(1, len(own) + 1)
            self.masks[w] = np.zeros((len(own) + 1, w), np.uint64)
            at = np.flatnonzero(self.words[owner] == w)
            np.bitwise_or.at(self.masks[w], (self.row[back[at]], place[at] // 64), np.uint64(1) << (place[at] % 64).astype(np.uint64))

    @staticmethod
    def _pair(item: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (item.astype(np.int64) << 21) | code

    @staticmethod
    def coded(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)

    def rows_of(self, items: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The mask rows of characters for the items that they are held against."""
        wanted = self._pair(items, codes)
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.row[at], 0)

    def possible(self, items: np.ndarray, texts: list[np.ndarray], budgets: np.ndarray) -> np.ndarray:
        """Whether a text has enough of the item's runs of three characters: each edit breaks three at most."""
        out = np.zeros(len(items), bool)
        for at, to in _bounded(np.fromiter(map(len, texts), np.int64, len(texts)), 4096):
            part, own = texts[at:to], items[at:to]
            there = [_threes(t) for t in part]
            has = np.zeros((len(part), 2048), bool)
            has[np.repeat(np.arange(len(part)), [len(x) for x in there]), np.concatenate(there)] = True
            wanted = [self.threes[i] for i in own.tolist()]
            lane = np.repeat(np.arange(len(part)), [len(x) for x in wanted])
            met = np.bincount(lane, has[lane, np.concatenate(wanted)], len(part))
            out[at:to] = met >= self.m[own] - 2 - 3 * budgets[at:to]
        return out

    def best_ends(self, items: np.ndarray, texts: list[np.ndarray], anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each item and coded text the least distance of the item to a part of the text, and the first end of such a part.

        Anchored: the part must begin where the text begins."""
        best, end = self.m[items].copy(), np.zeros(len(items), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for w in np.unique(self.words[items]).tolist():
            own = np.flatnonzero(self.words[items] == w)
            own = own[np.argsort(sizes[own], kind="stable")]  # lanes of like length together
            for at, to in _bounded(sizes[own], 2048):
                lanes = own[at:to]
                best[lanes], end[lanes] = self._lanes(w, items[lanes], [texts[i] for i in lanes.tolist()], sizes[lanes], anchored)
        return best, end

    def _lanes(self, w: int, items: np.ndarray, texts: list[np.ndarray], sizes: np.ndarray, anchored: bool) -> tuple[np.ndarray, np.ndarray]:
        n, longest = len(items), int(sizes.max())
        codes, lane = np.zeros((longest, n), np.int64), np.repeat(np.arange(n), sizes)
        codes[np.concatenate([np.arange(k) for k in sizes.tolist()]), lane] = self.rows_of(items[lane], np.concatenate(texts))
        one, top = np.uint64(1), np.uint64(63)
        last = ((self.m[items] - 1) % 64).astype(np.uint64)
        pv, mv = np.full((w, n), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros((w, n), np.uint64)
        score = self.m[items].copy()
        best, end = score.copy(), np.zeros(n, np.int64)
        masks, none, first = self.masks[w], np.zeros(n, np.uint64), np.full(n, one if anchored else np.uint64(0))
        for j in range(longest):
            rows = masks[codes[j]]
            plus, minus = first, none
            for k in range(w):
                eq, p, q = rows[:, k], pv[k], mv[k]
                xv = eq | q
                eq = eq | minus
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = q | ~(xh | p), p & xh
                if k == w - 1:
                    score += (ph >> last & one).astype(np.int64) - (mh >> last & one).astype(np.int64)
                next_plus, next_minus = ph >> top, mh >> top
                ph, mh = (ph << one) | plus, (mh << one) | minus
                pv[k], mv[k] = mh | ~(xv | ph), ph & xv
                plus, minus = next_plus, next_minus
            better = (score < best) & (j < sizes)
            best[better], end[better] = score[better], j + 1
        return best, end


class Matcher:
    """Finds a group of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items: list[tuple[int, str, int]] = []
        table: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            budget = int(rate * len(text))
            number = len(self.items)
            self.items.append((item_id, text, budget))
            for at, piece in pieces(text, budget):
                table.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in table.items():
            self.automaton.add_word(piece, (len(piece), places))
        if table:
            self.automaton.make_automaton()
            self.forth, self.back = Patterns([t for _, t, _ in self.items]), Patterns([t[::-1] for _, t, _ in self.items])

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, start, end, distance), one for each text and item found: of the least distance, the first."""
        asked: list[tuple[int, int, int, np.ndarray]] = []  # text, item, place, coded text there
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not self.items:
            return []
        for i, raw in enumerate(texts):
            text = normal(raw)
            places: dict[int, list[int]] = {}
            for last, (size, where) in self.automaton.iter(text):
                for number, at in where:
                    places.setdefault(number, []).append(last + 1 - size - at)
            coded = self.forth.coded(text) if places else None
            for number, starts in places.items():
                _, item, budget = self.items[number]
                if not budget:
                    whole = [s for s in starts if (s == 0 or text[s - 1] == " ") and text[s + len(item) : s + len(item) + 1] in ("", " ")]
                    if whole:
                        out[i, number] = (0, min(whole), min(whole) + len(item))
                    continue
                starts.sort()
                lo = None
                for s in [*starts, None]:
                    if lo is not None and (s is None or s - hi > 2 * budget):
                        a, b = max(0, lo - budget), min(len(text), hi + len(item) + budget)
                        # A part within the budget has len(item) + budget characters at most: pieces that overlap by as many miss none.
                        over = len(item) + budget
                        for lo in range(a, max(a + 1, b - over), 3 * over):
                            hi_ = min(b, lo + 4 * over)
                            if hi_ - lo >= len(item) - budget:
                                asked.append((i, number, lo, coded[lo:hi_]))
                        lo = None
                    if s is not None:
                        lo, hi = (s if lo is None else lo), s
        every = np.array([x[2] for x in self.items])
        numbers = np.array([x[1] for x in asked], np.int64)
        likely = self.forth.possible(numbers, [x[3] for x in asked], every[numbers])
        asked, numbers = [x for x, ok in zip(asked, likely.tolist()) if ok], numbers[likely]
        budgets = every[numbers]
        best, end = self.forth.best_ends(numbers, [x[3] for x in asked])
        good = np.flatnonzero(best <= budgets)
        tails = [asked[k][3][max(0, end[k] - self.forth.m[numbers[k]] - budgets[k]) : end[k]][::-1] for k in good.tolist()]
        _, length = self.back.best_ends(numbers[good], tails, anchored=True)
        for k, n in zip(good.tolist(), length.tolist()):
            i, number, a, _ = asked[k]
            found = (int(best[k]), a + int(end[k]) - n, a + int(end[k]))
            out[i, number] = min(found, out.get((i, number), found))
        return [(i, self.items[number][0], s, e, d) for (i, number), (d, s, e) in sorted(out.items())]


_READY: dict[str, Matcher] = {}


def ready(name: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    """The matcher of a group of items, made once in each Python worker; only the last group is kept."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Matcher(items, rate)
    return _READY[name]


def _groups(items: DataFrame, item_key: str, item_text: str, group: int) -> Iterator[tuple[str, object, bool]]:
    """The items in groups of about `group`, each with a name of its own, and whether there is more than one: the driver holds one at a time."""
    items = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    groups = max(1, -(-items.count() // group))
    for g in range(groups):
        chosen = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g).collect()
        yield uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(r["id"], r["text"]) for r in chosen]), groups > 1


def _chunks(texts: list[str | None], most: int = 2500, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of texts that are searched together, bounded by their number and their characters (or one text)."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (i - at == most or size + len(t or "") > chars):
            yield at, i
            at, size = i, 0
        size += len(t or "")
    if len(texts) > at:
        yield at, len(texts)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = 0.1, group: int = 20_000) -> DataFrame:
    """All (document, item) with the item within its error budget (columns of SCHEMA)."""
    texts = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    parts = []
    for name, chosen, more in _groups(items, item_key, item_text, group):

        def run(batches: Iterator[pd.DataFrame], name: str = name, chosen=chosen) -> Iterator[pd.DataFrame]:
            matcher = ready(name, chosen.value, rate)
            for b in batches:
                ids, texts_ = b["id"].tolist(), b["text"].tolist()
                found = [(lo + i, *rest) for lo, hi in _chunks(texts_) for i, *rest in matcher.find(texts_[lo:hi])]
                yield pd.DataFrame([(ids[i], item, s, e, d) for i, item, s, e, d in found], columns=["doc_id", "item_id", "start", "end", "distance"])
            tidy()

        part = texts.mapInPandas(run, SCHEMA.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
        if more:
            part = written(part, "contaminated")
            chosen.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = 0.1, group: int = 20_000) -> DataFrame:
    """The rows in whose text no item was found, in one pass for each group of items, without a join: keys play no part."""
    at = docs.columns.index(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    for name, chosen, more in _groups(items, item_key, item_text, group):

        def run(batches: Iterator[pa.RecordBatch], name: str = name, chosen=chosen) -> Iterator[pa.RecordBatch]:
            matcher = ready(name, chosen.value, rate)
            for b in batches:
                texts = b.column(0).field(at).cast(pa.string()).to_pylist()
                found = {lo + x[0] for lo, hi in _chunks(texts) for x in matcher.find([t or "" for t in texts[lo:hi]])}
                yield b.filter(pa.array([i not in found for i in range(len(texts))], pa.bool_()))
            tidy()

        rows = rows.mapInArrow(run, rows.schema)
        if more:
            rows = written(rows, "clean")
            chosen.destroy()
    return rows.select("doc.*")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
