"""Nearest vectors by inner product with multiprobe p-stable hashing.

Equal vectors form one class, so a very common vector is hashed, probed and compared once. Vectors are scaled
by the largest norm and get one more component that makes them unit vectors, so that the largest inner product
is the nearest point. Each of `tables` tables has some functions floor((a.x + b) / width), a normal, cut to four cells;
a bucket is the row of cells. Their number grows with the table, one for each four-fold of rows, so that buckets stay of like size
(`hashes` of them up to 2^16 classes, `most_hashes` at most). A query visits buckets in falling order of their estimated success: the
probability that a neighbour with the typical inner product lies there, given the query's own projections. It stops at a
share `reach` of the probability, which is fitted on `fit_queries` queries (a bounded sample, compared with all
vectors) so that the true neighbours among their visited buckets reach `aim`; but not before the buckets of a table that it has visited
hold k + 2 classes, or all there are, so every query finds `k` rows if the table has them. All rows are indexed. Candidates of all tables are
merged and ranked by exact inner products in double precision on the original vectors.

Work is cut into blocks of at most `block` candidates (neighbouring buckets together, large buckets split) against
chunks of about `chunk` queries; a block is sent once for each chunk of the queries that visit it, so no task holds an unbounded
group and the copies keep step with the visits. The bucket directory has at most tables * 4^most_hashes entries and goes to the tasks.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or are not as long as most, take no part;
equal scores are ranked by the smaller id; repeated ids are separate candidates; empty tables give no rows; with fewer
candidates than `k` all are given. Other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.shared import written

CELLS = 4


class Hashes:
    """`tables` x `hashes` projections of augmented vectors, with the model of a neighbour's cell."""

    def __init__(self, dim: int, norm: float, tables: int, hashes: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.standard_normal((tables, hashes, dim + 1)), rng.random((tables, hashes)) * width
        self.norm, self.width, self.similar = norm, width, 0.5
        self.place = CELLS ** np.arange(hashes)

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            unit = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]
        else:
            x = x / self.norm
            unit = np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))]
        return np.einsum("nd,thd->nth", unit, self.a)

    def codes(self, x: np.ndarray) -> np.ndarray:
        cell = np.clip(np.floor((self.project(x, False) + self.b) / self.width) + CELLS // 2, 0, CELLS - 1)
        return (cell.astype(np.int64) * self.place).sum(2)

    def masses(self, t: int, p: np.ndarray) -> np.ndarray:
        """For one query's projections in table `t` the probability of each cell of each function that a neighbour is there."""
        edges = (np.arange(1, CELLS) - CELLS // 2) * self.width - self.b[t][:, None]
        z = (edges - self.similar * p[:, None]) / np.sqrt(max(1e-9, 1 - self.similar**2))
        return np.diff(np.c_[np.zeros(len(p)), normal_cdf(z), np.ones(len(p))], axis=1)

    def success(self, t: int, p: np.ndarray) -> Success:
        return Success(self.masses(t, p))


class Success:
    """The codes of one table by falling success for one query.

    A code's success is the product over its functions; those of the first and the second half of the functions are
    sorted by themselves, so that the codes over a bound are found without looking at the others."""

    def __init__(self, masses: np.ndarray):
        half = len(masses) // 2
        self.low, self.high = _products(masses[:half]), _products(masses[half:])
        self.low_at, self.high_at = np.argsort(-self.low, kind="stable"), np.argsort(-self.high, kind="stable")
        self.falling = -self.low[self.low_at]
        self.total = np.r_[0.0, np.cumsum(-self.falling)]

    def _over(self, bound: float) -> np.ndarray:
        """For each high part, likeliest first, how many low parts keep the product at `bound` or more."""
        high = self.high[self.high_at]
        return np.searchsorted(self.falling, -bound / np.maximum(high, 1e-300), "right")

    def sum_over(self, bound: float) -> float:
        return float((self.high[self.high_at] * self.total[self._over(bound)]).sum())

    def of(self, code: int) -> float:
        return float(self.high[code // len(self.low)] * self.low[code % len(self.low)])

    def visit(self, reach: float) -> np.ndarray:
        """The likeliest codes whose success sums up to `reach` (1: all codes), likeliest first."""
        lo, hi = -700.0, 0.0  # logarithm of the bound
        if reach >= 1:
            lo = -np.inf
        else:
            for _ in range(40):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if self.sum_over(np.exp(mid)) >= reach else (lo, mid)
        n = self._over(np.exp(lo)) if lo > -np.inf else np.full(len(self.high), len(self.low))
        high = np.repeat(self.high_at, n)
        low = self.low_at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        codes = high * len(self.low) + low
        return codes[np.lexsort((codes, -self.high[high] * self.low[low]))]


def _products(masses: np.ndarray) -> np.ndarray:
    out = np.ones(1)
    for cells in masses:  # the first function varies fastest, as in `place`
        out = (cells[:, None] * out[None, :]).ravel()
    return out


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Distribution function of the normal law, to about 1e-7 (a rational approximation of the error function)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return 0.5 * (1 + np.sign(z) * erf)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def search(table: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = 2, hashes: int = 6, most_hashes: int = 10, width: float = 1.0, aim: float = 0.96, fit_queries: int = 64, block: int = 32768, chunk: int = 65536, least_blocks: int = 12) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` (rows of `table`) its `k` nearest other rows of `table`."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sized = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = sized(table).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return empty
    dim = lengths[0]["dim"]
    rows, asked = (sized(df).where(F.size("v") == dim) for df in (table, queries))

    # A class keeps its k + 1 smallest ids: no query can need more of it.
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    classes = written(rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("cid", F.col("members")[0]), "vector-classes")
    query_class = written(asked.withColumnRenamed("vec_id", "query_id").join(classes.select("v", "cid"), "v").select("query_id", "cid"), "query-classes")
    asking = classes.join(query_class.select("cid").distinct(), "cid").select("cid", "v")
    norm, many = classes.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count("*")).first()
    sample = asking.orderBy(F.xxhash64("cid")).limit(fit_queries).collect()
    if not sample:
        return empty
    hashes = min(most_hashes, hashes + max(0, int(many).bit_length() - 16) // 2)
    h, codes_each = Hashes(dim, norm, tables, hashes, width), CELLS**hashes
    reach = _fit(classes, h, [(r["cid"], np.array(r["v"])) for r in sample], k, aim)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                codes = h.codes(_vectors(b["v"]))
                for t in range(tables):
                    yield pd.DataFrame({"bucket": t * codes_each + codes[:, t], "cid": b["cid"], "v": b["v"]})

    candidates = classes.select("cid", "v").mapInPandas(hashed, "bucket long, cid long, v array<double>")
    found = candidates.groupBy("bucket").count().orderBy("bucket").toPandas()  # at most tables * 4^most_hashes rows
    codes, counts = found["bucket"].to_numpy(np.int64), found["count"].to_numpy(np.int64)
    starts = np.cumsum(counts) - counts
    blocks = max(least_blocks, -(-int(counts.sum()) // block))
    each = -(-int(counts.sum()) // blocks)
    directory = spark.sparkContext.broadcast((codes, counts, starts))

    def visited(t: int, p: np.ndarray) -> np.ndarray:
        """Places in the directory of the buckets that a query visits in table `t`."""
        codes, counts, _ = directory.value
        first, last = np.searchsorted(codes, [t * codes_each, (t + 1) * codes_each])
        likely, share = h.success(t, p), reach
        while True:
            wanted = likely.visit(share) + t * codes_each
            at = first + np.searchsorted(codes[first:last], wanted)
            ok = at < last
            at = at[ok][codes[at[ok]] == wanted[ok]]
            if share >= 1 or counts[at].sum() >= min(k + 2, many):
                return at
            share = 1 - (1 - share) / 4 if share < 0.999 else 1.0

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each block that a query visits, with the buckets it visits there."""
        codes, counts, starts = directory.value
        for b in batches:
            out = []
            for cid, v, p in zip(b["cid"], b["v"], h.project(_vectors(b["v"]), True) if len(b) else []):
                met: dict[int, list[int]] = {}
                for t in range(tables):
                    at = visited(t, p[t])
                    for i, first, last in zip(at.tolist(), (starts[at] // each).tolist(), ((starts[at] + counts[at] - 1) // each).tolist()):
                        for x in range(first, last + 1):
                            met.setdefault(x, []).append(int(codes[i]))
                out += [(x, cid, v, seen) for x, seen in met.items()]
            yield pd.DataFrame(out, columns=["block", "query", "v", "buckets"])

    asked_of = written(asking.mapInPandas(probes, "block long, query long, v array<double>, buckets array<long>"), "probes")
    # Chunks of queries of each block: as many rows as there are blocks.
    pieces = {r["block"]: -(-r["count"] // chunk) for r in asked_of.groupBy("block").count().collect()}
    chunked = spark.sparkContext.broadcast(pieces)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A candidate in its block, once for each chunk of the queries that visit it."""
        codes, counts, starts = directory.value
        for b in hashed(batches):
            at = np.searchsorted(codes, b["bucket"].to_numpy())
            spread = (b["cid"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % counts[at]
            b = b.assign(block=(starts[at] + spread) // each)
            times = np.array([chunked.value.get(x, 0) for x in b["block"].tolist()], np.int64)
            again = b.iloc[np.repeat(np.arange(len(b)), times)]
            yield again.assign(chunk=np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times))[["block", "chunk", "bucket", "cid", "v"]]

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A visit in its block's chunk."""
        for b in batches:
            turn = (b["query"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
            yield b.assign(chunk=turn % np.array([chunked.value[x] for x in b["block"].tolist()], np.int64))

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            c = c.sort_values("cid", kind="stable").reset_index(drop=True)
            by_bucket = {b: at for b, at in c.groupby("bucket").indices.items()}
            x, ids = _vectors(c["v"]), c["cid"].to_numpy()
            for lo in range(0, len(q), 256):
                part = q.iloc[lo : lo + 256]
                asks: dict[int, list[int]] = {}
                for i, seen in enumerate(part["buckets"]):
                    for b in seen:
                        asks.setdefault(int(b), []).append(i)
                y, scores = _vectors(part["v"]), np.full((len(part), len(c)), -np.inf)
                for b, who in asks.items():
                    if (at := by_bucket.get(b)) is not None:
                        scores[np.ix_(who, at)] = y[who] @ x[at].T
                for i, query in enumerate(part["query"].to_numpy()):
                    s = scores[i]
                    top = np.flatnonzero(s > -np.inf)
                    if len(top) > 2 * (k + 2):  # a class may be in the block from either table
                        top = top[s[top] >= np.partition(s[top], len(top) - 2 * (k + 2))[len(top) - 2 * (k + 2)]]
                    got: dict[int, float] = {}
                    for j in top[np.lexsort((ids[top], -s[top]))].tolist():
                        got.setdefault(int(ids[j]), float(s[j]))
                    found += [(int(query), cid, score) for cid, score in list(got.items())[: k + 2]]
        return pd.DataFrame(found, columns=["query", "cid", "score"]).astype({"query": "int64", "cid": "int64", "score": "float64"})

    near = asked_of.mapInPandas(dealt, "block long, query long, v array<double>, buckets array<long>, chunk long").groupBy("block", "chunk").cogroup(
        classes.select("cid", "v").mapInPandas(placed, "block long, chunk long, bucket long, cid long, v array<double>").groupBy("block", "chunk")
    ).applyInPandas(compare, "query long, cid long, score double")
    merged = near.groupBy("query", "cid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    top = merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 2)
    # k + 1 rows of a query's class are enough: each query leaves out itself alone.
    members = top.join(classes.select("cid", "members"), "cid").select("query", "score", F.explode("members").alias("vec_id"))
    listed = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    short = members.withColumn("n", F.row_number().over(listed)).where(F.col("n") <= k + 1)
    lists = short.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    mine = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = query_class.join(lists.withColumnRenamed("query", "cid"), "cid").select("query_id", F.posexplode(mine).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _fit(classes: DataFrame, h: Hashes, sample: list[tuple[int, np.ndarray]], k: int, aim: float) -> float:
    """Set the typical inner product of a neighbour and return the share of success to visit. Compares the bounded sample with all classes."""
    ids, q = [i for i, _ in sample], np.array([v for _, v in sample])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = _vectors(b["v"]) @ q.T
                for j in range(len(ids)):
                    s[b["cid"].to_numpy() == ids[j], j] = -np.inf
                    top = np.argsort(-s[:, j], kind="stable")[:k]
                    yield pd.DataFrame({"j": j, "score": s[top, j], "v": b["v"].iloc[top].to_list()})

    w = Window.partitionBy("j").orderBy(F.desc("score"))
    rows = classes.select("cid", "v").mapInPandas(nearest, "j int, score double, v array<double>").withColumn("n", F.row_number().over(w)).where(f"n <= {k} and score > double('-Infinity')").collect()
    if not rows:
        return 1.0
    scores = np.array([r["score"] for r in rows]) / (np.linalg.norm(q, axis=1)[[r["j"] for r in rows]] * h.norm)
    h.similar = float(np.clip(np.median(scores), 0.05, 0.95))
    codes, p = h.codes(np.array([r["v"] for r in rows])), h.project(q, True)
    needed = np.ones((len(rows), len(h.a)))
    for j in range(len(ids)):
        for t in range(len(h.a)):
            likely = h.success(t, p[j, t])
            for i, r in enumerate(rows):
                if r["j"] == j:
                    needed[i, t] = likely.sum_over(likely.of(int(codes[i, t])))
    # A neighbour is found once either table's visits come to its bucket.
    return min(1.0, float(np.quantile(needed.min(1), aim)) + 1e-9)


def digest(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where("vec_id % 20 = 0"))
