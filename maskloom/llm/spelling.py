"""Spelling variants by composition of finite-state machines.

The vocabulary's minimised acceptor is composed with a transducer that makes exactly one edit, and with the acceptor again; what the composed machine
accepts are the pairs of near words. A composed state is (p, edits, q): before the edit both sides have read the same code points, after it both read on alike.
The machine is cut into the parts that begin at one initial state, and each part is built and enumerated by itself: the part for words of
lengths m and m + 1 that share their first `a` and last `b` code points, for pairs whose common prefix ends from `a` on and before the shared suffix. Each pair lies in
exactly one part. Lengths are halved once; a part of more than `most` words is halved again into one with a longer shared prefix and one with a
longer shared suffix, down to one free code point, where the alphabet bounds it. So no task holds more than a bounded part, and
no word meets all others.

Counts come from all texts with Spark's partial aggregates. A word's form is its near word of largest count, where that is `factor` times its own; roots follow by pointer
doubling, in as many rounds as the logarithm of the longest chain (counts grow by `factor` a step, so chains are short).

Defined cases: a null text has no words; a null id is an empty one in the hash; very long texts are read whole; repeated rows count each; of near words with equal counts the smallest
in code-point order is the form; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import discard, tidy, written

#: Maximal runs of these are words; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, slip: int = 199) -> DataFrame:
    """word, n: the words of at least `shortest` code points and `least` occurrences. Where `slip` divides the hash of id and word, a code point of it is lost."""
    lowered = F.translate(F.col(f"`{text}`").cast("string"), _UPPER, _LOWER)
    runs = F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{shortest},}}+"), F.lit(0)))
    given = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hashed = given.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Machine:
    """Minimised acceptors with shared states, and their composition with the one-edit transducer."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.arcs: list[tuple] = []  # of each state: (code point, state), in order
        self.final: list[bool] = []
        self.alike: dict[tuple[int, int], list[str]] = {}

    def acceptor(self, words: list[str]) -> int:
        """The initial state of the minimal acceptor of sorted distinct words."""
        return self._built(words, 0, len(words), 0)

    def _built(self, words: list[str], lo: int, hi: int, at: int) -> int:
        final, arcs = lo < hi and len(words[lo]) == at, []
        lo += final
        while lo < hi:
            c, end = words[lo][at], lo + 1
            while end < hi and words[end][at] == c:
                end += 1
            arcs.append((c, self._built(words, lo, end, at + 1)))
            lo = end
        state = (final, *arcs)
        found = self.known.get(state)
        if found is None:  # states of equal right sides are one
            found = self.known[state] = len(self.arcs)
            self.arcs.append(tuple(arcs))
            self.final.append(final)
        return found

    def both(self, p: int, q: int) -> list[str]:
        """What is read alike from p and q on: the composed states after the edit."""
        out = self.alike.get((p, q))
        if out is None:
            out = [""] if self.final[p] and self.final[q] else []
            there = dict(self.arcs[q]) if p != q else None
            for c, r in self.arcs[p]:
                s = r if there is None else there.get(c)
                if s is not None:
                    out += [c + z for z in self.both(r, s)]
            self.alike[p, q] = out
        return out

    def replaced(self, p: int) -> list[tuple[str, str]]:
        """Pairs from (p, no edit, p) by one replacement, the smaller first."""
        out, arcs = [], self.arcs[p]
        for i, (c, r) in enumerate(arcs):
            out += [(c + x, c + y) for x, y in self.replaced(r)]
            out += [(c + z, d + z) for d, s in arcs[i + 1 :] for z in self.both(r, s)]
        return out

    def inserted(self, p: int, q: int, at_end: bool) -> list[tuple[str, str]]:
        """Pairs from (p, no edit, q) where q's side has one code point more, as far right as it can be; `at_end`: also after all of p's side."""
        out, arcs = [], dict(self.arcs[p])
        for d, s in self.arcs[q]:
            out += [(z, d + z) for z in self.both(p, s) if (z[0] != d if z else at_end)]
            if d in arcs:
                out += [(d + x, d + y) for x, y in self.inserted(arcs[d], s, at_end)]
        return out


def near_pairs(words: list[str], m: int, a: int, b: int) -> list[tuple[str, str]]:
    """The near pairs of a part: distinct words of lengths m and m + 1 that share their first a and last b code points."""
    words = sorted(words)
    middle = lambda w: w[a : len(w) - b]
    short, long = ([middle(w) for w in words if len(w) == size] for size in (m, m + 1))
    if not short or len(words) < 2:
        return []
    machine = Machine()
    p = machine.acceptor(short)
    found = machine.replaced(p)
    if long:
        found += machine.inserted(p, machine.acceptor(long), not b)
    head, tail = words[0][:a], words[0][len(words[0]) - b :] if b else ""
    return [(head + x + tail, head + y + tail) for x, y in found]


def _part(word: Column, m: Column, a: Column, b: Column) -> Column:
    """A part's name: no two parts share one, as words have no colons."""
    return F.concat_ws(":", m.cast("string"), a.cast("string"), b.cast("string"), F.substring(word, F.lit(1), a), F.substring(word, F.length(word) - b + 1, b))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, a, b) in the two parts that halve its free code points, with the part's name; a part of one free code point stays."""
    free = F.col("m") - F.col("a") - F.col("b")
    s = F.floor(free / 2).cast("int")
    further = F.struct((F.col("a") + s).alias("a"), F.col("b").alias("b"))
    before = F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - s).alias("b"))
    out = rows.select("word", "n", "m", F.explode(F.when(free > 1, F.array(further, before)).otherwise(F.array(F.struct("a", "b")))).alias("to")).select("word", "n", "m", "to.a", "to.b")
    return out.withColumn("part", _part(F.col("word"), F.col("m"), F.col("a"), F.col("b")))


def parted(vocabulary: DataFrame, most: int = 20_000) -> DataFrame:
    """word, n, m, a, b, part: each word in the parts where its near words may be; none of over `most` words but where one code point is free."""
    size = F.length("word")
    lengths = F.array(size, size - 1)  # as the shorter or equal word, as the longer one
    rows = _halved(vocabulary.select("word", "n", F.explode(lengths).alias("m")).where("m > 0").withColumns({"a": F.lit(0), "b": F.lit(0)}))
    done = None
    while True:
        large = written(rows.groupBy("part").agg(F.count("*").alias("words"), F.first(F.col("m") - F.col("a") - F.col("b")).alias("free")).where((F.col("words") > most) & (F.col("free") > 1)).select("part"), "large-parts")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "part", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = _halved(rows.join(large, "part", "left_semi").drop("part"))


def near_words(vocabulary: DataFrame, most: int = 20_000) -> DataFrame:
    """word, near, near_n: all pairs of words that differ by exactly one inserted, deleted or replaced code point, both ways."""
    rows = parted(vocabulary, most)

    def enumerated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        out: list[tuple[str, str, int]] = []
        for b in _with_end(batches):
            if b is not None:
                rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if rest is None or not len(rest):
                continue
            parts = rest["part"].to_numpy()
            starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
            ends = np.r_[starts[1:], len(parts)]
            if b is not None:  # the last part may go on in the next batch
                starts, ends = starts[:-1], ends[:-1]
            words, counts, sizes = rest["word"].to_numpy(), rest["n"].to_numpy(), rest[["m", "a", "b"]].to_numpy()
            wide = ends - starts > 1
            for lo, hi in zip(starts[wide].tolist(), ends[wide].tolist()):
                n_of = dict(zip(words[lo:hi].tolist(), counts[lo:hi].tolist()))
                m, a, z = sizes[lo].tolist()
                for u, v in near_pairs(list(n_of), m, a, z):
                    out.append((u, v, n_of[v]))
                    out.append((v, u, n_of[u]))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["word", "near", "near_n"])
                    out = []
            rest = rest.iloc[ends[-1] if len(ends) else 0 :].reset_index(drop=True) if b is not None else None
        yield pd.DataFrame(out, columns=["word", "near", "near_n"])
        tidy()

    dealt = rows.repartition(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")
    return dealt.mapInPandas(enumerated, "word string, near string, near_n long")


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def variants(vocabulary: DataFrame, factor: int = 5, most: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of a written vocabulary (word, n)."""
    near = near_words(vocabulary, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    strong = -F.col("best.less") >= factor * F.col("n")
    told = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    told = written(told, "word-forms")
    roots = written(told.where("form is not null").select("word", F.col("form").alias("root")), "word-roots")
    while True:  # each round doubles the steps that are followed
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots")
        discard(roots)
        roots = longer
        if roots.where("moved").isEmpty():
            break
    return told.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(written(counted(docs), "vocabulary"))
