"""Hard-negative mining with Fagin's threshold algorithm.

Components are cut to whole numbers, scores are integer inner products. Candidates lie in blocks (a batch of rows of one task, ordered by label), each with
one sorted list per dimension. For an anchor a list is read from its high end where the anchor's component is positive, from its low
end where it is negative; a row met first in any list is scored in full (random access). The threshold is the score that a row at the
present depth of all lists would have: no row unseen can have more. A window (k best rows between two bounds) is done once the threshold falls strictly below
its kth score, or below its lower bound; strictly, so that ties by id come out right. Depth grows by doubling.

First each anchor's positives are found among the rows of its label, one window without bounds; then the negatives of each positive among all
other labels, in a window of each positive's own bounds. Anchors go to the tasks in chunks of about `chunk` (a documented bound), one pass over the candidates for each; candidates
are not shuffled again. A task carries its windows from block to block, so lists are left early where earlier blocks were good, and gives k rows a window at most;
these meet by anchor. All of this is exact; at worst all rows are scored for all anchors, which is what a stated query set against all rows costs.

Defined cases: rows with a null id, label or vector, an empty vector, or null or non-finite components take no part, and neither do those with a component of 2^15 or more in size
(a hundredfold score of up to 512 such components stays in 64 bits); vectors of different length do not meet; rows with the anchor's own id are not its candidates; repeated ids are
separate rows otherwise; equal scores go by the smaller id; windows that nothing falls in give no rows; empty tables give none; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.shared import tidy, written

#: Beyond all scores on either side.
_MOST = 1 << 62
_NONE = -_MOST
_FIRST_DEPTH = 16


class Windows:
    """For each anchor some windows of the `k` best rows between two bounds, filled block by block."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), _NONE, np.int64)
        self.ids = np.zeros((*low.shape, k), np.int64)

    def floor(self, i: int) -> np.ndarray:
        """For each window of anchor `i` the least score that can still enter: its kth, or its lower bound; one beyond all where it is empty."""
        least = np.maximum(self.scores[i, :, -1], self.low[i])
        return np.where(self.low[i] > self.high[i], _MOST, least)

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, least in enumerate(self.floor(i).tolist()):
            fits = (scores >= least) & (scores <= self.high[i, w])
            if fits.any():
                s, x = np.concatenate([self.scores[i, w], scores[fits]]), np.concatenate([self.ids[i, w], ids[fits]])
                best = np.lexsort((x, -s))[: self.k]
                self.scores[i, w], self.ids[i, w] = s[best], x[best]


class Block:
    """Rows of one length with a sorted list of them for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()  # a list per dimension, from its low end
        self.sorted = np.take_along_axis(rows.T, self.order, 1)

    def mine(self, anchor: np.ndarray, anchor_id: int, label: int, same: bool, windows: Windows, i: int) -> None:
        """The threshold algorithm for one anchor; `same`: among rows of its label, else among the others."""
        n = len(self.ids)
        wanted = ((self.labels == label) == same) & (self.ids != anchor_id)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        depth, to = 0, _FIRST_DEPTH
        while depth < n:
            to = min(n, to)
            met = np.zeros(n, bool)
            met[self.order[up, n - to : n - depth]] = True
            met[self.order[down, depth:to]] = True
            if not len(up) and not len(down):  # an anchor without direction: all rows score 0
                met[:] = True
            new = np.flatnonzero(met & ~seen & wanted)
            seen |= met
            if len(new):
                windows.offer(i, self.rows[new] @ anchor, self.ids[new])
            threshold = int(self.sorted[up, n - to] @ anchor[up] + self.sorted[down, to - 1] @ anchor[down])
            if (threshold < windows.floor(i)).all():
                return
            depth, to = to, to * 2 + _FIRST_DEPTH


def prepared(table: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Rows that take part: vec_id, label, whole-number components, and a number for each row; written in order of labels."""
    v = F.col(f"`{vector}`")
    rows = table.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), v.cast("array<double>").alias("v")).where(
        "vec_id is not null and label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) >= 32768)"
    )
    rows = rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.transform("v", lambda x: F.floor(x * 256).cast("int")).alias("c"), F.monotonically_increasing_id().alias("row"))
    parts = 2 * table.sparkSession.sparkContext.defaultParallelism
    # The row's hash splits a label that many rows share.
    return written(rows.repartitionByRange(max(parts, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "label", F.xxhash64("row")).sortWithinPartitions("label"), "whole-vectors")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Block]]:
    for b in batches:
        sizes = b["c"].map(len).to_numpy(np.int64)
        for dim in np.unique(sizes).tolist():
            own = b[sizes == dim]
            yield dim, Block(own["vec_id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), np.array(own["c"].tolist(), np.int64).reshape(-1, dim))


def _passed(candidates: DataFrame, anchors: list, same: bool, k: int) -> DataFrame:
    """For a chunk of anchors (row, vec_id, label, c and their windows' low, high) each task's best rows: anchor, window, other, score."""
    by_dim: dict[int, list] = {}
    for a in anchors:
        by_dim.setdefault(len(a["c"]), []).append(a)
    sent = candidates.sparkSession.sparkContext.broadcast(
        {d: tuple(np.array([a[x] for a in own], np.int64) for x in ("row", "vec_id", "label", "c", "low", "high")) for d, own in by_dim.items()}
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {d: Windows(own[4], own[5], k) for d, own in sent.value.items()}
        for dim, block in _blocks(batches):
            if dim in found:
                _, ids, labels, vectors, _, _ = sent.value[dim]
                here = np.isin(labels, block.labels) if same else np.ones(len(labels), bool)
                for i in np.flatnonzero(here).tolist():
                    block.mine(vectors[i], int(ids[i]), int(labels[i]), same, found[dim], i)
        for d, w in found.items():
            i, window, at = np.nonzero(w.scores > _NONE)
            yield pd.DataFrame({"anchor": sent.value[d][0][i], "window": window.astype(np.int32), "other": w.ids[i, window, at], "score": w.scores[i, window, at]})
        tidy()

    return candidates.select("vec_id", "label", "c").mapInPandas(run, "anchor long, window int, other long, score long")


def _searched(candidates: DataFrame, asked: DataFrame, chunks: int, same: bool, k: int, name: str) -> DataFrame:
    """The `k` best rows of each window: anchor, window, n (from 1), other, score."""
    parts = []
    for g in range(chunks):
        chosen = asked.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == g).collect()  # about `chunk` anchors
        if chosen:
            part = _passed(candidates, chosen, same, k)
            parts.append(written(part, name) if chunks > 1 else part)
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "other")
    return reduce(DataFrame.unionByName, parts).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)


def mine(table: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, chunk: int = 10_000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (ids divisible by `every`) and each of its `positives` best rows of
    the same label the `negatives` best of other labels whose score is from `least` to `most` hundredths of the positive's."""
    spark = table.sparkSession
    rows = prepared(table, key, label, vector)
    anchors = rows.where(F.col("vec_id") % every == 0)
    chunks = -(-anchors.count() // chunk)
    if not chunks:
        return spark.range(0).selectExpr("id as anchor_id", "id as positive_id", "cast(id as int) as rank", "id as negative_id", "id as positive_score", "id as negative_score")
    open_ended = [F.array(F.lit(x).cast("long")) for x in (_NONE, _MOST)]
    near = written(_searched(rows, anchors.select("*", open_ended[0].alias("low"), open_ended[1].alias("high")), chunks, True, positives, "same-label"), "positives")

    own = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("n", "other", "score"))).alias("p"))  # `positives` at most
    # Whole-number bounds: the least from least * p / 100 up, the most down; windows that are not there are empty.
    hundredth = lambda n: F.call_function("div", n - F.pmod(n, F.lit(100)), F.lit(100))  # noqa: E731  rounded down, in whole numbers
    up, down = (lambda x: -hundredth(-least * x["score"])), (lambda x: hundredth(most * x["score"]))
    exact = lambda f: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), f)
    at = lambda i: F.get("p", i)
    low, high = exact(lambda i: F.coalesce(up(at(i)).cast("long"), F.lit(1).cast("long"))), exact(lambda i: F.coalesce(down(at(i)).cast("long"), F.lit(0).cast("long")))
    asked = anchors.join(own, anchors["row"] == own["anchor"]).select("row", "vec_id", "label", "c", low.alias("low"), high.alias("high"))
    far = _searched(rows, asked, chunks, False, negatives, "other-labels")

    pairs = near.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", (F.col("n") - 1).alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(far.select("anchor", "window", F.col("n").alias("rank"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def digest(embeddings: DataFrame) -> DataFrame:
    return mine(embeddings)
