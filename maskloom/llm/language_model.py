"""Hashed maximum-entropy language model with class-factored softmax, and the add-one unigram base.

Tokens are the lower-cased (A-Z) words of a text, cut at ASCII white space, and one end. The most frequent words (at most
`vocabulary`, seen twice or more) are known to the tasks. The most frequent of them, and the end, have a class of their own; the others,
and the words outside the vocabulary, share classes by a hash of their last two bytes. The probability of a token is
factored: P(class | the two classes before) P(word | class, the two words before).

- The class softmax has hashed feature rows: a bias, the class before (bigram), the class two before (skip), and the pair
  of both (trigram) hashed to `pairs` rows.
- The word softmax of a class of vocabulary words has an outcome for each of its `SLOTS` - 1 most frequent words and one for the rest, whose words have
  their share of it. Its hashed feature rows are the word before (bigram) and the word two before (skip), each together with the class; their number
  grows with the training tokens up to `most_rows`. Rarer words before count by their class. The bias is the logarithm of the share in the class.
- Both are trained by distributed gradient updates: every round sends the weights to the tasks, each share of the counts takes adaptive gradient
  steps, and the weights are averaged, each row by the tokens that touched it. The counts are those of all training tokens, summed by
  Spark: (context, class) and (word before, word two before, class, word). Shares are dealt by a hash of the context, and their number goes by the
  counts, so the model is the same however the rows are dealt to tasks.
- In a class of words outside, a word seen c times has (c + 1) / (tokens + distinct words + 1), the last place being that of all unseen
  words together, as in the base.

Base and model need the count of every word: words outside the vocabulary meet the whole count table in a join, after being counted by text.

Defined cases: a null text is an empty one (its end alone); very long texts are read whole; repeated rows are scored each; with no
training text the base is 0 for each token; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import crc_mod, tidy, written

#: Classes: the end and single words, vocabulary words by suffix, words outside by suffix.
CLASSES, SINGLE, SUFFIXES = 192, 96, 48
END, BEGIN = 0, CLASSES
#: Outcomes of the word softmax of a class, and the words whose own bigrams and skips are features; rarer ones count by class.
SLOTS, NEAR = 128, 4096


def tokenized(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the words of all texts in order, the distinct words (binary), and the words in each text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, per = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        owner = np.repeat(np.arange(len(per)), per)
        per = np.bincount(owner[~empty], minlength=len(per))
        flat = flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()), per


def parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of a few rows: the words of a piece are what a task holds at a time."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary) and its count; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held = []
            for b in parts(whole):
                index, words, per = tokenized(b.column(0))
                n = np.bincount(index, minlength=len(words))
                held.append(pa.table({"word": pa.concat_arrays([words, pa.array([b""], pa.binary())]), "n": np.r_[n, len(per)].astype(np.int64)}))
            merged = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]) if held else None
            yield from merged.rename_columns(["word", "n"]).to_batches() if held else ()
            tidy()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffixes(words: pa.Array) -> np.ndarray:
    """Hash of the last two bytes of each word, 0 to SUFFIXES - 1."""
    raw = np.frombuffer(words.cast(pa.binary()).buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(ends)
    last = np.where(size > 0, raw[np.maximum(ends[1:] - 1, 0)] if len(raw) else 0, 0).astype(np.int64)
    before = np.where(size > 1, raw[np.maximum(ends[1:] - 2, 0)] if len(raw) else 0, 0).astype(np.int64)
    return ((last * 256 + before) * 0x9E3779B1 >> 12) % SUFFIXES


class Vocabulary:
    """Frequent words with their classes and their outcomes there."""

    def __init__(self, counts: dict[bytes, int]):
        order = sorted(counts, key=lambda w: (-counts[w], w))
        self.words = pa.array(order, pa.binary())
        rank = np.cumsum(np.array([bool(w) for w in order], int))
        self.classes = np.where(rank < SINGLE, rank, SINGLE + suffixes(self.words)) if order else np.zeros(0, np.int64)
        self.classes[[not w for w in order]] = END
        n = np.array([counts[w] for w in order], float)
        self.log_count = np.log10(n + 1)
        #: A word's outcome in its class (-1: a class of its own), and its log10 share of the outcome.
        shared = (self.classes >= SINGLE) & (self.classes < SINGLE + SUFFIXES)
        by_class = np.argsort(self.classes, kind="stable")  # frequent first within a class
        first = np.searchsorted(self.classes[by_class], self.classes[by_class])
        place = np.empty(len(order), np.int64)
        place[by_class] = np.arange(len(order)) - first
        self.slot = np.where(shared, np.minimum(place, SLOTS - 1), -1)
        cell = (self.classes - SINGLE) * SLOTS + self.slot
        mass = np.bincount(cell[shared], n[shared], SUFFIXES * SLOTS)
        self.within = np.zeros(len(order))
        self.within[shared] = np.log10(n[shared] / mass[cell[shared]])
        with np.errstate(divide="ignore"):
            table = mass.reshape(SUFFIXES, SLOTS)
            self.bias = np.maximum(np.log(table / np.maximum(table.sum(1, keepdims=True), 1.0)), -1e4).astype(np.float32)
        #: log10 of (tokens + distinct words + 1) of the classes of words outside.
        self.outside = np.zeros(SUFFIXES)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (-1: outside) and their classes."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        classes = SINGLE + SUFFIXES + suffixes(words)
        classes[at >= 0] = self.classes[at[at >= 0]]
        return at, classes


def outside_totals(counts: DataFrame) -> np.ndarray:
    """log10 (tokens + distinct words + 1) by suffix class, over the words of `counts` (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
        for b in batches:
            c = suffixes(b.column(0))
            n += np.bincount(c, b.column(1).to_numpy(), SUFFIXES)
            v += np.bincount(c, minlength=SUFFIXES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUFFIXES, dtype=np.int32)), pa.array((n + v).astype(np.int64))], ["c", "n"])

    out = np.ones(SUFFIXES)
    for r in counts.select("word", "n").mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        out[r["c"]] += r["n"]
    return np.log10(out)


def before(seq: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the value one and two before it in its text."""
    one, two = np.r_[begin, seq[:-1]], np.r_[begin, begin, seq[:-2]][: len(seq)]
    later = starts + 1
    two[later[later < len(seq)]] = begin
    one[starts], two[starts] = begin, begin
    return one, two


def with_ends(values: np.ndarray, per: np.ndarray, end: int) -> np.ndarray:
    """Values of the words of all texts in order, with one for the end of each text."""
    out = np.full(len(values) + len(per), end, np.int64)
    out[np.arange(len(values)) + np.repeat(np.arange(len(per)), per)] = values
    return out


def sequences(classes: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens with the ends put in, the contexts, and where each text begins."""
    starts = np.cumsum(per + 1) - (per + 1)
    seq = with_ends(classes, per, END)
    one, two = before(seq, starts, BEGIN)
    return seq, two * (CLASSES + 1) + one, starts


def word_events(known: Vocabulary, at: np.ndarray, classes: np.ndarray, index: np.ndarray, per: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of words with an outcome in a shared class, their contexts (two feature rows and the class in one number) and outcomes."""
    near = np.where((at >= 0) & (at < NEAR), at, NEAR + classes)
    starts = np.cumsum(per + 1) - (per + 1)
    one, two = before(with_ends(near[index], per, NEAR + END), starts, NEAR + BEGIN)
    slot = with_ends(np.where(at >= 0, known.slot[np.maximum(at, 0)] if len(known.slot) else -1, -1)[index], per, -1)
    place = np.flatnonzero(slot >= 0)
    own = with_ends(classes[index], per, END)[place] - SINGLE
    hashed = lambda x, salt: ((x * SUFFIXES + own) * np.int64(0x9E3779B1) + salt & 0xFFFFFFFF) * np.int64(0x85EBCA6B) % np.int64(4294967291) & (rows - 1)
    return place, hashed(one[place], 1) | hashed(two[place], 2) << 16 | own << 32, slot[place]


def statistics(texts: DataFrame, vocabulary: Vocabulary, rows: int) -> DataFrame:
    """event, n over all tokens of `texts`, in one pass: how often each word of a shared class follows the words before (event = outcome << 40 | context), and,
    below 0, how often each class follows each context (event = -1 - cell, cell = context * CLASSES + class)."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def summed(held: list) -> tuple[np.ndarray, np.ndarray]:
        events, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return events.astype(np.int64), np.bincount(back, np.concatenate([k for _, k in held]), len(events)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cells, held = [], []
            for b in parts(whole):
                index, words, per = tokenized(b.column(0))
                at, classes = shared.value.find(words)
                seq, context, _ = sequences(classes[index], per)
                cells.append(np.unique((context * CLASSES + seq).astype(np.int32), return_counts=True))
                _, context, slot = word_events(shared.value, at, classes, index, per, rows)
                held.append(np.unique(context | slot << 40, return_counts=True))
            if held:
                cell, n = summed(cells)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - cell), pa.array(n)], ["event", "n"])
                event, n = summed(held)
                yield pa.RecordBatch.from_arrays([pa.array(event), pa.array(n)], ["event", "n"])
            tidy()

    return texts.select("text").mapInArrow(run, "event long, n long").groupBy("event").agg(F.sum("n").alias("n"))


def summed_rows(rows: np.ndarray, first: np.ndarray, few: int = 8) -> np.ndarray:
    """Sums of the rows from each of `first` to the next: short stretches together, place by place, long ones each by itself (reduceat goes by single cells)."""
    n, out = np.diff(np.r_[first, len(rows)]), rows[first]
    for j in np.flatnonzero(n > few).tolist():
        np.add.reduce(rows[first[j] : first[j] + n[j]], axis=0, out=out[j])
    more = np.flatnonzero((n > 1) & (n <= few))
    for k in range(1, few):
        more = more[n[more] > k]
        out[more] += rows[first[more] + k]
    return out


class WordModel:
    """Softmax over the outcomes of a class with hashed rows of weights for the words before."""

    def __init__(self, bias: np.ndarray, rows: int):
        self.bias, self.rows = bias, rows
        self.w = np.zeros((2 * rows, SLOTS), np.float32)

    def scores(self, context: np.ndarray) -> np.ndarray:
        """Logarithms of the outcomes' shares but for the sum, 0 at most."""
        one, two, own = context & 0xFFFF, (context >> 16 & 0xFFFF) + self.rows, context >> 32
        s = self.bias[own]
        s += self.w[one]
        s += self.w[two]
        s -= s.max(1, keepdims=True)
        return s

    def log_p(self, context: np.ndarray) -> np.ndarray:
        s = self.scores(context)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def chosen(self, context: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """ln P of each outcome in its context; contexts that come again are worked out once."""
        order, out = np.argsort(context), np.zeros(len(context), np.float32)
        context = context[order]
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(context)])
        number, seen = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(context)])), context[first]
        ends = np.r_[first[::4096], len(context)]
        for k, lo, hi in zip(range(0, len(seen), 4096), ends[:-1], ends[1:]):
            s, own, lane = self.scores(seen[k : k + 4096]), order[lo:hi], number[lo:hi] - k
            picked = s[lane, slot[own]]
            out[own] = picked - np.log(np.exp(s, out=s).sum(1))[lane]
        return out

    def steps(self, event: np.ndarray, counts: np.ndarray, passes: int, rate: float = 0.3) -> np.ndarray:
        """Adaptive gradient steps over distinct (context, outcome) with their counts; returns the tokens that touched each row. The first counts of a row move it little."""
        by_context = np.argsort((event & 0xFFFFFFFFFF) << 7 | event >> 40)  # one context's together, by outcome
        event, counts = event[by_context], counts[by_context]
        context = event & 0xFFFFFFFFFF
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(context)])
        context, slot, ends = context[first], event >> 40, np.r_[first, len(event)]
        total = np.diff(np.r_[0, np.cumsum(counts)][ends]).astype(np.float32)
        rows = np.stack([context & 0xFFFF, (context >> 16 & 0xFFFF) + self.rows])
        squares = np.ones(self.w.shape, np.float32)
        order = np.argsort(context * np.int64(0x9E3779B97F4A7C15 - (1 << 64)))
        for _ in range(passes):
            for lo in range(0, len(order), 4096):
                part = order[lo : lo + 4096]
                g = self.scores(context[part])
                np.exp(g, out=g)
                g *= -total[part, None] / g.sum(1, keepdims=True)
                n = ends[part + 1] - ends[part]
                lane = np.repeat(np.arange(len(part)), n)
                own = np.arange(n.sum()) + np.repeat(ends[part] - np.r_[0, np.cumsum(n)[:-1]], n)
                g[lane, slot[own]] += counts[own]
                for f in rows[:, part]:
                    by = np.argsort(f, kind="stable")
                    first = np.flatnonzero(np.r_[True, f[by][1:] != f[by][:-1]])
                    move, at = summed_rows(g[by], first), f[by][first]
                    square = squares[at] + move * move
                    squares[at] = square
                    move *= np.float32(rate)
                    move /= np.sqrt(square, out=square)
                    self.w[at] += move
        return np.bincount(rows[0], total, 2 * self.rows) + np.bincount(rows[1], total, 2 * self.rows)


class ClassModel:
    """Softmax over classes with hashed rows of weights."""

    def __init__(self, pairs: int = 8192):
        self.pairs = pairs
        self.rows = 1 + 2 * (CLASSES + 1) + pairs
        self.w = np.zeros((self.rows, CLASSES), np.float32)

    def features(self, context: np.ndarray) -> np.ndarray:
        two, one = context // (CLASSES + 1), context % (CLASSES + 1)
        pair = (context * 0x9E3779B1 & 0xFFFFFFFF) * self.pairs >> 32
        return np.stack([np.zeros_like(one), 1 + one, 1 + (CLASSES + 1) + two, 1 + 2 * (CLASSES + 1) + pair], 1)

    def log_p(self, features: np.ndarray) -> np.ndarray:
        s = self.w[features].sum(1)
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def steps(self, context: np.ndarray, counts: np.ndarray, passes: int, rate: float = 0.1) -> np.ndarray:
        """Adaptive gradient steps over contexts with their class counts; returns the tokens that touched each row."""
        f, total = self.features(context), counts.sum(1)
        squares = np.full(self.w.shape, 1e-6, np.float32)
        order = np.argsort(-total, kind="stable")
        for _ in range(passes):
            for part in np.array_split(order, max(1, len(order) // 2048)):
                g = counts[part] - total[part, None] * np.exp(self.log_p(f[part]))
                g /= np.sqrt(total[part, None] + 1.0)
                for k in range(f.shape[1]):
                    rows, back = np.unique(f[part, k], return_inverse=True)
                    own = np.zeros((len(rows), CLASSES), np.float32)
                    np.add.at(own, back, g)
                    squares[rows] += own * own
                    self.w[rows] += rate * own / np.sqrt(squares[rows])
        return np.bincount(f.ravel(), np.repeat(total, f.shape[1]), self.rows)


def averaged(table: DataFrame, model, steps, rounds: int, groups: int = 64) -> None:
    """Rounds of distributed gradient updates: `steps(own model, rows of a share)` returns the tokens that touched each row; the shares' moves are averaged by them.

    `table` has a column `share`; a share's rows fit one task. A share sends the moves of the rows it touched in half precision. What comes back to
    the driver is the model, whose size is a parameter."""
    width = model.w.shape[1]
    for _ in range(rounds):
        now = table.sparkSession.sparkContext.broadcast(model)

        def local(g: pd.DataFrame) -> pd.DataFrame:  # used in this round alone
            own = copy(now.value)
            own.w = now.value.w.copy()
            touched = steps(own, g)
            rows = np.flatnonzero(touched)
            tidy()
            return pd.DataFrame({"share": np.full(len(rows), g["share"].iloc[0], np.int64), "row": rows, "weight": touched[rows].astype(np.float64), "w": [(own.w[r] - now.value.w[r]).astype(np.float16).tobytes() for r in rows]})

        def merge(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["row", "share"], kind="stable")
            rows, back = np.unique(g["row"].to_numpy(), return_inverse=True)
            total, weight = np.zeros((len(rows), width)), g["weight"].to_numpy()
            for lo in range(0, len(g), 4096):
                w = np.frombuffer(b"".join(g["w"].iloc[lo : lo + 4096]), np.float16).reshape(-1, width).astype(float)
                np.add.at(total, back[lo : lo + 4096], w * weight[lo : lo + 4096, None])
            return pd.DataFrame({"row": rows, "w": [x.astype(np.float32).tobytes() for x in total / np.bincount(back, weight)[:, None]]})

        merged = table.groupBy("share").applyInPandas(local, "share long, row long, weight double, w binary").groupBy((F.col("row") % groups).alias("g")).applyInPandas(merge, "row long, w binary").collect()
        w = model.w.copy()
        for r in merged:  # at most the rows of the model, whatever the corpus
            w[r["row"]] += np.frombuffer(r["w"], np.float32)
        model.w = w
        now.unpersist()


def train(counts: DataFrame, rounds: int = 4, passes: int = 6, pairs: int = 8192, shares: int = 4) -> ClassModel:
    """The class softmax from `counts` (cell, n) of the class table."""
    model = ClassModel(pairs)
    totals = counts.groupBy((F.col("cell") % CLASSES).alias("c")).agg(F.sum("n").alias("n")).collect()
    start = np.full(CLASSES, 0.5)
    for r in totals:
        start[r["c"]] += r["n"]
    model.w[0] = np.log(start / start.sum())
    table = counts.select("cell", "n", F.pmod(F.xxhash64(F.expr(f"cell div {CLASSES}")), F.lit(shares)).alias("share"))

    def steps(own: ClassModel, g: pd.DataFrame) -> np.ndarray:
        cell = g["cell"].to_numpy(np.int64)
        context, back = np.unique(cell // CLASSES, return_inverse=True)
        full = np.zeros((len(context), CLASSES), np.float32)
        full[back, cell % CLASSES] = g["n"].to_numpy()
        return own.steps(context, full, passes)

    averaged(table, model, steps, rounds)
    return model


def train_words(events: DataFrame, bias: np.ndarray, rows: int, rounds: int = 2, passes: int = 1, share_rows: int = 1_000_000) -> WordModel:
    """The word softmax from `events` (event, n); a share has about `share_rows` of them, one context's together."""
    model = WordModel(bias, rows)
    shares = max(8, -(-events.count() // share_rows))
    table = events.select("event", "n", F.pmod(F.xxhash64(F.col("event").bitwiseAND(F.lit((1 << 40) - 1))), F.lit(shares)).alias("share"))

    def steps(own: WordModel, g: pd.DataFrame) -> np.ndarray:
        return own.steps(g["event"].to_numpy(np.int64), g["n"].to_numpy(np.int64), passes)

    averaged(table, model, steps, rounds)
    return model


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int = 100_000, most_rows: int = 1 << 13) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document, learnt from `training`."""
    spark = docs.sparkSession
    plain = lambda df: df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs, training = plain(docs), plain(training)
    counts = written(word_counts(training), "lm-counts")
    n_all, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The least count that keeps the vocabulary within its bound, from counts of counts in at most 4096 steps.
    step = F.floor(F.log2("n") * 64)
    spread, held, least = {r["s"]: r["count"] for r in counts.groupBy(step.alias("s")).count().collect()}, 0, 1 << 62
    for s in sorted(spread, reverse=True):
        if held + spread[s] > vocabulary:
            break
        held, least = held + spread[s], s
    least = max(least, 64)  # words seen once are outside: they show how unseen words are spelt
    known = Vocabulary({bytes(r["word"]): r["n"] for r in counts.where((step >= least) | (F.length("word") == 0)).collect()})
    rarer = counts.where((step < least) & (F.length("word") > 0))
    known.outside = outside_totals(rarer)
    # A feature row for every 256 training tokens, up to the bound that the tasks' memory sets.
    rows_each = 1 << min(most_rows.bit_length() - 1, max(8, int(n_all).bit_length() - 8))
    events = written(statistics(training, known, rows_each), "lm-events")
    model = train(written(events.where("event < 0").select((-1 - F.col("event")).alias("cell"), "n"), "lm-statistics"))
    words_model = train_words(events.where("event >= 0"), known.bias, rows_each)
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"
    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])
    shared = spark.sparkContext.broadcast((known, model, words_model))  # all are bounded by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, model, words_model = shared.value
        first = TaskContext.get().partitionId() << 33
        table = np.full((CLASSES + 1) ** 2, -1)  # a context's row in `logs`
        logs = np.zeros((0, CLASSES), np.float32)
        for whole in batches:
            for b in parts(whole):
                index, words, per = tokenized(b.column(1))
                at, classes = known.find(words)
                seq, context, starts = sequences(classes[index], per)
                seen = np.flatnonzero(np.bincount(context, minlength=len(table)))
                new = seen[table[seen] < 0]
                if len(new):
                    table[new] = np.arange(len(logs), len(logs) + len(new))
                    logs = np.concatenate([logs, model.log_p(model.features(new)) / np.float32(np.log(10))])
                rows = table[context]
                here = at >= 0
                inside, counted = -known.outside[np.maximum(0, classes - SINGLE - SUFFIXES)], np.zeros(len(at))
                inside[here], counted[here] = known.within[at[here]], known.log_count[at[here]]
                token = logs[rows, seq].astype(float)
                token[np.arange(len(index)) + np.repeat(np.arange(len(per)), per)] += inside[index]
                place, events, slot = word_events(known, at, classes, index, per, words_model.rows)
                token[place] += words_model.chosen(events, slot) / np.log(10)
                owner = np.repeat(np.arange(len(per)), per)
                end = int(known.find(pa.array([b""], pa.binary()))[0][0])
                n_in = np.bincount(owner, here[index], len(per)).astype(np.int64) + (end >= 0)
                base = np.bincount(owner, counted[index], len(per)).astype(float) + (known.log_count[end] if end >= 0 else 0.0)
                # Words outside the vocabulary, each once for each text.
                out = ~here[index]
                pair, times = np.unique(owner[out] * len(words) + index[out], return_counts=True)
                cuts = np.r_[0, np.cumsum(np.bincount(pair // max(1, len(words)), minlength=len(per)))].astype(np.int32)
                spelt = words.take(pa.array(pair % max(1, len(words))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + np.arange(len(per))), b.column(0), pa.array(per + 1), pa.array(n_in), pa.array(base), pa.array(np.add.reduceat(token, starts)),
                     pa.ListArray.from_arrays(pa.array(cuts), spelt), pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32)))],
                    schema=arrow,
                )
                first += len(per)
            tidy()

    rows = written(docs.mapInArrow(run, schema), "lm-rows")
    # The rest of both: words outside the vocabulary against the whole count table.
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    joined = rare.join(rarer, "word", "left")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"))
    norm = float(np.log10(n_all + distinct + 1))
    out = rows.drop("words", "times").join(sums, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """Learn from documents with crc32(doc_id) mod 7 not 2 and score all."""
    held = crc_mod("doc_id", 7) == 2
    return score(docs, docs.where(~held)).select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
