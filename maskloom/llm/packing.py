"""Bounded-space online packing of documents into sequences of fixed length.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; its
rest goes to the open window where it fits best. When none fits, the fullest window is filled
with the head of the piece (if at least `min_cut` ids go in) and emitted, and the rest is placed
in turn. What is open at the end of a partition is handed on: the leftovers of `merged` partitions meet in one task, which lays
their pieces end to end into full windows. Only the last of these, shorter than a window, becomes sequences whose lengths are powers of two,
which need no padding: at most log2(size) short ones for `merged` partitions. Texts are not shuffled; a task holds
`open_windows` windows and one batch, or the open windows of `merged` partitions.

The packed pieces are written below the shared folder once, since full windows and leftovers are read from them apart.

Defined cases: a null text is an empty one, and has just its end id; a null key is kept; repeated rows
are packed each; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import tidy, written
from maskloom.llm.token_ids import encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32")] + [("ids", pa.binary())])


class WindowPacker:
    """Places pieces (doc_id, start, ids, doc_tokens); `emit` is called with each finished list of pieces."""

    def __init__(self, size: int, open_windows: int, min_cut: int, emit):
        self.size, self.most, self.min_cut, self.emit = size, open_windows, min_cut, emit
        self.order: list[tuple[int, int]] = []  # (free ids, window)
        self.windows: dict[int, list] = {}
        self.made = 0

    def add(self, doc_id, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self.emit([(doc_id, at, ids[4 * at : 4 * (at + self.size)], total)])
            at += self.size
        if at < total:
            self._place(doc_id, at, ids[4 * at :], total)

    def _place(self, doc_id, at: int, ids: bytes, total: int) -> None:
        while True:
            n = len(ids) // 4
            k = bisect_left(self.order, (n, -1))
            if k < len(self.order):
                free, w = self.order.pop(k)
                self.windows[w].append((doc_id, at, ids, total))
                if free == n:
                    self.emit(self.windows.pop(w))
                else:
                    insort(self.order, (free - n, w))
                return
            if len(self.order) < self.most:
                self.windows[self.made] = [(doc_id, at, ids, total)]
                insort(self.order, (self.size - n, self.made))
                self.made += 1
                return
            free, w = self.order.pop(0)
            if free >= self.min_cut:
                self.windows[w].append((doc_id, at, ids[: 4 * free], total))
                at, ids = at + free, ids[4 * free :]
            self.emit(self.windows.pop(w))

    def leftovers(self) -> list:
        """The pieces of all open windows, the fullest window first."""
        return [p for _, w in self.order for p in self.windows[w]]


def merge(pieces: list, size: int, emit) -> None:
    """Lay pieces end to end into full windows; the rest becomes sequences of power-of-two length."""
    rest = sum(len(p[2]) // 4 for p in pieces)
    target, got, now = min(size, 1 << max(0, rest.bit_length() - 1)), 0, []
    for doc_id, at, ids, total in pieces:
        while ids:
            n = min(len(ids) // 4, target - got)
            now.append((doc_id, at, ids[: 4 * n], total))
            at, ids, got = at + n, ids[4 * n :], got + n
            if got == target:
                emit(now)
                rest -= target
                target, got, now = min(size, 1 << max(0, rest.bit_length() - 1)), 0, []


class _Rows:
    """Rows of finished sequences, with numbers from `first` on."""

    def __init__(self, first: int, keep_ids: bool):
        self.next_id, self.keep_ids, self.rows = first, keep_ids, []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, at, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, at, n, total, self.next_id, offset, crc32(ids), ids if self.keep_ids else None))
            offset += n
        self.next_id += 1

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), schema)], schema=schema)
        self.rows.clear()
        return out


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 1024, open_windows: int = 64, min_cut: int = 8, end_id: int = 0, merged: int = 8, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence and offset there, crc32 and ids (columns of `SCHEMA`; ids are null without `keep_ids`).

    `size` must be a power of two. `sequence_id` counts on within each input partition, and negatively within each merging task."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        done = _Rows(part << 32, keep_ids)
        packer = WindowPacker(size, open_windows, min_cut, done.emit)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                packer.add(doc_id, ids + end)
                if len(done.rows) >= 4096:
                    yield done.batch(_ARROW)
        # Leftovers have no sequence yet: their place among the partition's leftovers stands for the offset.
        done.rows += [(doc_id, at, len(ids) // 4, total, None, i, 0, ids) for i, (doc_id, at, ids, total) in enumerate(packer.leftovers())]
        if done.rows:
            yield done.batch(_ARROW)
        tidy()

    def close(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["part", "offset"], kind="stable")
        made = _Rows(-((int(lot["lot"].iloc[0]) + 1) << 32), keep_ids)
        keys = [None if pd.isna(k) else int(k) for k in lot["doc_id"]]
        merge(list(zip(keys, lot["start"].tolist(), lot["ids"].tolist(), lot["doc_tokens"].tolist())), size, made.emit)
        out = pd.DataFrame(made.rows, columns=_ARROW.names)
        return out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
    placed = written(rows.withColumn("part", F.spark_partition_id()), "packed")
    left = placed.where("sequence_id is null").withColumn("lot", F.expr(f"part div {merged}"))
    return placed.where("sequence_id is not null").drop("part").unionByName(left.groupBy("lot").applyInPandas(close, SCHEMA))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
