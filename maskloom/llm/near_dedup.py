"""Near-duplicates by consistent weighted sampling over TF-IDF word shingles.

A text's shingles are runs of five normal words (of a shorter text: all its words), hashed to 32 bits; a shingle's weight is its
count in the text times 1 + ln(N / df). Document frequencies count a family of copies once, so that the shingles of a large group of near
copies do not lose their weight with the group's size: a document's family is its smallest hashed pair of neighbouring words, which near copies
nearly always share, and df is the number of families with the shingle. It is held as distinct-count registers (16 of 8 bits) in CELLS hashed cells over
all documents, so the table that goes to the tasks is bounded; repeats change nothing, so it is the same however the rows are dealt. In a large corpus
a cell holds many rare shingles: twice the median of the cells is taken off, and frequencies below that count as 1.

Improved consistent weighted sampling draws `bands` * `rows` samples whose agreement is
the weighted Jaccard similarity; random numbers come from tables indexed by a hash of shingle and sample.
Texts that agree in all samples of a band meet in a bucket and are verified by their exact weighted Jaccard similarity.

1. Texts with the same normal words form a class at once; only its smallest key goes on.
2. Buckets of the same members are kept once. Small ones are compared within a task, each text only with those it
   is not yet linked to. Buckets over `chunk` members or `chunk_words` words are split: chunks are compared within; then the best linked texts of all
   chunks visit each chunk; last, every member that is still apart from its bucket's largest component visits all chunks. So every
   candidate pair is either compared or already in one class, and no task holds more than `chunk` residents and one chunk of visitors.
3. Components of the links by contraction with joins.

Shingles of candidates alone are made again for the verification; the others are kept out by a bounded bit map.

Defined cases: null or empty texts, and those without a letter or digit, are each a class of their own; very long texts are read
whole; rows with the same key are one document, with the text of the greatest hash, by which it is both placed in buckets and verified; a null
key is left out; an empty table gives no rows; other columns are not read. `unique_rows` takes each row as a document, whatever its key.

The result is one row per document: doc_id and class_id, the smallest key of its class."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.shared import discard, tidy, written
from maskloom.llm.words import hashed_words

CELLS, REGISTERS = 1 << 20, 16
_BLOCK = 1 << 18


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """32-bit hashes of the runs of `size` words, sorted, with repeats."""
    if not len(words):
        return np.zeros(0, np.uint32)
    k = min(size, len(words))
    x = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(x)]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    out = (x >> np.uint64(32)).astype(np.uint32)
    out.sort()
    return out


def _distinct(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.r_[first, len(s)])


def merged_cells(parts: DataFrame, registers: int) -> np.ndarray:
    """The greatest of partial cell tables (`part` long, `block` int, `n` binary of one byte a place), as an array of registers x CELLS.

    Partial tables are merged 32 at a time, so a task's group is bounded."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(g["part"].iloc[0]) // 32], "block": [int(g["block"].iloc[0])], "n": [np.max([np.frombuffer(x, np.uint8) for x in g["n"]], axis=0).tobytes()]})

    while True:
        parts = written(parts, "cells")
        most = parts.agg(F.max("part")).first()[0]
        if not most:
            break
        last, parts = parts, written(parts.groupBy(F.expr("part div 32").alias("g"), "block").applyInPandas(merge, "part long, block int, n binary"), "cells")
        discard(last)
    out = np.zeros(registers * CELLS, np.uint8)
    for r in parts.collect():  # registers * CELLS bytes in all
        own = out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK]
        np.maximum(own, np.frombuffer(r["n"], np.uint8), out=own)
    discard(parts)
    return out.reshape(registers, CELLS)


def _emit_cells(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    for block, x in enumerate(cells.reshape(-1, _BLOCK)):
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "block", "n"])


def family(words: np.ndarray) -> int:
    """The smallest 64-bit hash of two neighbouring words (of a single word: its own)."""
    x = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] if len(words) > 1 else words
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int(x.min())


def family_counts(registers: np.ndarray) -> np.ndarray:
    """Numbers of distinct families by cell: harmonic mean of the registers, by empty registers while there are some."""
    m = len(registers)
    mean = m / np.sum(np.exp2(-registers.astype(np.float32)), axis=0)
    empty = (registers == 0).sum(0)
    few = m * np.log(m / np.maximum(empty, 1))
    return np.where(empty > 0, few, 0.673 * m * mean)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Number of families of copies by cell of the shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((REGISTERS, CELLS), np.uint8)
        for b in batches:
            for w in hashed_words(b.column(0)):
                if len(w):
                    f = family(w) & 0xFFFFFFFFFFFFF
                    own, cells = held[f % REGISTERS], shingles(w) & np.uint32(CELLS - 1)
                    own[cells] = np.maximum(own[cells], 49 - (f // REGISTERS).bit_length())
        yield from _emit_cells(held)
        tidy()

    counts = family_counts(merged_cells(texts.select("text").mapInArrow(run, "part long, block int, n binary"), REGISTERS))
    return np.maximum(1, counts - 2 * np.median(counts))


def weight_table(df: np.ndarray, total: int) -> np.ndarray:
    """ln of a single shingle's weight, by cell."""
    return np.log(1 + np.clip(np.log(max(1, total) / np.maximum(1, df)), 0, None)).astype(np.float32)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) quantiles r, 1 / r, ln of further quantiles, and uniform numbers, at 65536 steps."""
    u = (np.arange(65536) + 0.5) / 65536
    lo, hi = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return lo.astype(np.float32), (1 / lo).astype(np.float32), np.log(lo).astype(np.float32), u.astype(np.float32)


def samples(s: np.ndarray, log_w: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One hash of (shingle, step) for each seed: equal for two texts with the probability of their weighted Jaccard similarity."""
    r, inverse, log_c, beta = _tables()
    x = (s.astype(np.uint64)[None, :] + seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    a, b, c = (x >> np.uint64(48)).astype(np.uint16), (x >> np.uint64(32)).astype(np.uint16), (x >> np.uint64(16)).astype(np.uint16)
    shift, scale = beta[b], r[a]
    t = np.floor(log_w[None, :] * inverse[a] + shift)
    best = (log_c[c] - scale * (t - shift + 1)).argmin(1)
    at = np.arange(len(seeds))
    y = (s[best].astype(np.uint64) << np.uint64(32)) ^ t[at, best].astype(np.int64).view(np.uint64)
    return (y + seeds) * np.uint64(0xD6E8FEB86659FD93)


def signatures(texts: DataFrame, log_weights: np.ndarray, bands: int, rows: int) -> DataFrame:
    """doc_id, content (16 bytes; null without words), number of words and one 64-bit key per band."""
    seeds = np.random.default_rng(5).integers(0, 1 << 63, bands * rows, dtype=np.int64).astype(np.uint64)
    table = texts.sparkSession.sparkContext.broadcast(log_weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            contents, sizes, keys = [], [], []
            for words in hashed_words(b.column(1)):
                sizes.append(len(words))
                if not len(words):
                    contents.append(None), keys.append(None)
                    continue
                s, n = _distinct(shingles(words))
                got = samples(s, table.value[s & np.uint32(CELLS - 1)] + np.log(n.astype(np.float32)), seeds).reshape(bands, rows)
                key = np.zeros(bands, np.uint64)
                for j in range(rows):
                    key = (key ^ got[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                contents.append(xxhash.xxh128_digest(words.tobytes())), keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(contents, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "content", "words", "keys"])
        tidy()

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, content binary, words long, keys array<long>")


def vectors(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """doc_id, content and sorted shingles, of the documents whose hashed key has a bit in `wanted`."""
    bits = texts.sparkSession.sparkContext.broadcast(np.packbits(wanted > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            cell = b.column(2).to_numpy()
            ok = pa.array((bits.value[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool))
            b = b.filter(ok)
            if b.num_rows:
                made = [(xxhash.xxh128_digest(w.tobytes()) if len(w) else None, shingles(w).tobytes()) for w in hashed_words(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.binary()) for x in zip(*made))], ["doc_id", "content", "shingles"])
        tidy()

    return texts.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell")).mapInArrow(run, "doc_id long, content binary, shingles binary")


class Verifier:
    """Exact weighted Jaccard similarities among the texts of one task's group, with a union-find."""

    def __init__(self, raw: list[bytes], log_weights: np.ndarray, least: float):
        self.least, self.vectors = least, []
        for x in raw:
            s, n = _distinct(np.frombuffer(x, np.uint32))
            w = n * np.exp(log_weights[s & np.uint32(CELLS - 1)].astype(np.float64))
            self.vectors.append((s, w, float(w.sum())))
        self.parent = list(range(len(raw)))
        self.degree = np.zeros(len(raw), np.int64)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def similarity(self, i: int, j: int) -> float:
        (s, w, a), (t, v, b) = self.vectors[i], self.vectors[j]
        if min(a, b) < self.least * max(a, b):
            return 0.0
        if len(s) > len(t):
            s, w, t, v = t, v, s, w
        at = np.searchsorted(t, s)
        at[at == len(t)] = 0
        shared = t[at] == s
        both = float(np.minimum(w[shared], v[at[shared]]).sum())
        return both / (a + b - both)

    def compare(self, i: int, others: list[int]) -> None:
        """Compare i with those of `others` that it is not linked to."""
        for j in others:
            if self.root(i) != self.root(j) and self.similarity(i, j) >= self.least - 1e-9:
                self.join(i, j)
                self.degree[i] += 1
                self.degree[j] += 1

    def within(self) -> None:
        """Link all texts of the group. New members of a component look next, so that one hub links its whole group in one sweep."""
        left = set(range(len(self.parent)))
        while left:
            queue = [min(left)]
            left.discard(queue[0])
            while queue:
                i = queue.pop()
                met = [j for j in sorted(left) if self.root(i) == self.root(j) or self.similarity(i, j) >= self.least - 1e-9]
                for j in met:
                    self.join(i, j)
                self.degree[i] += len(met)
                self.degree[met] += 1
                left.difference_update(met)
                queue += met


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for the nodes of `links` (a, b), by repeated contraction."""
    labels = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    edges = written(links.where("a <> b").distinct(), "edges")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("label"), F.least("a", "m").alias("up")), "step")
        step = first
        for _ in range(2):  # pointer jumping
            step = step.join(step.select(F.col("label").alias("up"), F.col("up").alias("top")), "up", "left").select("label", F.coalesce("top", "up").alias("up"))
        step = written(step, "step")
        a, b = step.select(F.col("label").alias("a"), F.col("up").alias("x")), step.select(F.col("label").alias("b"), F.col("up").alias("y"))
        old = (labels, edges, first, step)
        labels = written(labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        edges = written(edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
        discard(*old)
    discard(edges)
    return labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = 10, rows: int = 3, chunk: int = 512, chunk_words: int = 4_000_000, lot_words: int = 8_000_000, hubs: int = 8) -> DataFrame:
    """doc_id and class_id of every document."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    df = document_frequencies(texts)
    log_weights = weight_table(df, texts.count())
    signed = written(signatures(texts, log_weights, bands, rows), "signatures")

    # Repeated keys: one document, without words only if all its texts are; equal contents: one class.
    every = signed.groupBy("doc_id").agg(F.max(F.struct("content", "words", "keys")).alias("x")).select("doc_id", "x.content", "x.words", "x.keys")
    own_class, one = every.where("content is null").select("doc_id", F.col("doc_id").alias("rep")), every.where("content is not null")
    reps = written(one.groupBy("content").agg(F.min("doc_id").alias("rep"), F.min("words").alias("words"), F.min("keys").alias("keys")), "reps")
    member = one.select("doc_id", "content").join(reps.select("content", "rep"), "content").select("doc_id", "rep")

    banded = reps.select("rep", "words", F.posexplode("keys").alias("band", "bucket"))
    sizes = banded.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("x"), F.expr("bit_xor(xxhash64(rep, 1))").alias("y"), F.sum("words").alias("all_words")).where("n > 1")
    chunks = F.expr(f"greatest(ceil(n / {chunk}), ceil(all_words / {chunk_words}))")
    kept = sizes.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket", "all_words")).alias("k")).select("k.band", "k.bucket", "n", "k.all_words").select("band", "bucket", chunks.alias("chunks"))
    placed_in = banded.join(kept, ["band", "bucket"])
    buckets = written(placed_in.select(F.xxhash64("band", "bucket").alias("bucket"), "rep", "words", "chunks", F.expr("cast(pmod(xxhash64(rep, 2), chunks) as int)").alias("chunk")), "buckets")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint8)
        for b in batches:
            cells[b.column(0).to_numpy()] = 1
        yield from _emit_cells(cells)

    wanted = merged_cells(buckets.select(F.pmod(F.xxhash64("rep"), F.lit(CELLS)).alias("cell")).mapInArrow(mark, "part long, block int, n binary"), 1)[0]
    made = written(vectors(texts, wanted).groupBy("doc_id").agg(F.max(F.struct("content", "shingles")).alias("x")).select(F.col("doc_id").alias("rep"), "x.shingles"), "vectors")
    table = spark.sparkContext.broadcast(log_weights)

    def link(g: pd.DataFrame) -> pd.DataFrame:
        """All buckets or chunks of a lot, each by itself."""
        g = g.sort_values(["bucket", "chunk", "rep"], kind="stable").reset_index(drop=True)
        out = []
        for at in g.groupby(["bucket", "chunk"], sort=False).indices.values():
            v = Verifier(g["shingles"].to_numpy()[at].tolist(), table.value, least)
            v.within()
            out.append((at, at[[v.root(i) for i in range(len(at))]], v.degree))
        at, to, degree = (np.concatenate(x) for x in zip(*out))
        rep = g["rep"].to_numpy()
        return pd.DataFrame({"bucket": g["bucket"].to_numpy()[at], "chunks": g["chunks"].to_numpy()[at], "chunk": g["chunk"].to_numpy()[at], "a": rep[at], "b": rep[to], "degree": degree})

    members, words = buckets.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    lots = max(1, members // 4096, words // lot_words)
    lotted = buckets.withColumn("lot", F.pmod(F.xxhash64("bucket", "chunk"), F.lit(lots))).join(made, "rep")
    linked = written(lotted.groupBy("lot").applyInPandas(link, "bucket long, chunks long, chunk int, a long, b long, degree long"), "linked")
    links = linked.select("a", "b").where("a <> b")
    large = written(linked.where("chunks > 1"), "large")
    spent = [buckets, made, linked, large]
    if large.limit(1).count():
        best = Window.partitionBy("bucket", "chunk").orderBy(F.desc("degree"), "a")
        guests = large.withColumn("k", F.row_number().over(best)).where(F.col("k") <= hubs).select("bucket", "a")
        links = written(links.unionByName(_visits(large, guests, made, table, least, chunk)), "links")
        spent.append(links)
        # Exactly the rest: members outside the bucket's largest component visit every chunk.
        label = components(links)
        placed = written(large.join(label.withColumnRenamed("node", "a"), "a", "left").select("bucket", "chunk", "a", F.coalesce("label", "a").alias("label")), "placed")
        spent += [placed, label]
        most = placed.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("x")).select("bucket", F.col("x.label").alias("main"))
        apart = placed.join(most, "bucket").where("label <> main").select("bucket", "a")
        links = written(links.unionByName(_visits(placed.withColumn("b", F.col("label")), apart, made, table, least, chunk)), "links")
        spent.append(links)
    label = components(links)
    discard(*spent)
    named = member.unionByName(own_class).join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select("doc_id", F.coalesce("label", "rep").alias("class_id"))


def _visits(large: DataFrame, guests: DataFrame, made: DataFrame, table, least: float, chunk: int) -> DataFrame:
    """Links (a, b) of guests (bucket, a) with the residents of all chunks of their bucket; residents come as (bucket, chunk, a, b), linked to b already."""
    tours = guests.withColumn("tour", F.expr(f"cast(pmod(xxhash64(a, 3), greatest(1, ceil(count(*) over (partition by bucket) / {chunk}))) as int)"))
    each = large.select("bucket", "chunk").distinct()
    tour = tours.select("bucket", "tour").distinct()
    here = large.join(tour, "bucket").select("bucket", "chunk", "tour", "a", "b", F.lit(False).alias("guest"))
    there = tours.join(each, "bucket").select("bucket", "chunk", "tour", "a", F.col("a").alias("b"), F.lit(True).alias("guest"))

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["guest", "a"], kind="stable").drop_duplicates("a").reset_index(drop=True)
        v = Verifier(g["shingles"].tolist(), table.value, least)
        first: dict[int, int] = {}
        for i, b in enumerate(g["b"].tolist()):
            v.join(i, first.setdefault(b, i))
        residents = np.flatnonzero(~g["guest"].to_numpy()).tolist()
        for i in np.flatnonzero(g["guest"].to_numpy()).tolist():
            v.compare(i, residents)
        a = g["a"].to_numpy()
        out = pd.DataFrame({"a": a, "b": a[[v.root(i) for i in range(len(a))]]})
        return out[out["a"] != out["b"]]

    return here.unionByName(there).join(made.withColumnRenamed("rep", "a"), "a").groupBy("bucket", "chunk", "tour").applyInPandas(meet, "a long, b long")


def unique_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row of each class of near-duplicate rows: that of the smallest key, null last, then of the smallest hash of its text.

    Every row is a document of its own, also those that share a key or have none. Rows without words are classes of their own,
    but of exact copies with the same key one stays."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = written(whole, "numbered")
    read = rows.select("row", F.col("doc").getField(key).alias("k"), F.col("doc").getField(text).alias("text"))
    named = classes(read, "row", **kw)
    own = read.select("row", "k", F.xxhash64("text").alias("h")).join(named, F.col("row") == F.col("doc_id"))
    best = own.groupBy("class_id").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h", "row")).alias("x")).select("x.*")
    stay = best.groupBy("k", "h", F.when(F.col("none"), F.col("row"))).agg(F.min("row").alias("row")).select("row")
    return rows.join(stay, "row", "left_semi").select("doc.*")


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs)
