"""Append-only result logs as Structured Streaming: running means, unique keys, milestones, gaps and progress.

The sources are files read as a stream; state is kept by Spark, and sinks are keyed by batch so that a repeated batch adds nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType


def running_summary(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Running count and mean per group (update or complete mode)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def unique_keys(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key that comes within the watermark; older state is dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def heartbeat_gaps(rows: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Attempts: runs of heartbeats no further apart than `gap`, with start, last beat and beats."""
    s = F.session_window(time, gap)
    out = rows.withWatermark(time, late).groupBy(*keys, s.alias("w")).agg(F.count("*").alias("beats"), F.max(time).alias("last_beat"))
    return out.select(*keys, F.col("w.start").alias("start"), "last_beat", "beats")


class _Milestones(StatefulProcessor):
    """State of a group: rows so far, last bucket told, whether the group is complete. An event-time timer forgets a group that has been silent for `keep`."""

    def __init__(self, keys: list[str], time: str, totals: dict[str, int], step: int, keep_ms: int):
        self.keys, self.time, self.totals, self.step, self.keep_ms = keys, time, totals, step, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "seen long, told long, complete boolean, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, told, complete, timer = self.progress.get() if self.progress.exists() else (0, 0, False, 0)
        total, latest = max(1, self.totals.get(str(key[-1]), 1)), None
        for f in rows:
            seen += len(f)
            if len(f) and f[self.time].notna().any():
                top = int(f[self.time].max().value // 1_000_000)
                latest = top if latest is None else max(latest, top)
        bucket = min(100 // self.step, seen * 100 // (total * self.step))
        out = [(*map(_text, key), "milestone", b * self.step) for b in range(told + 1, bucket + 1)]
        if seen >= total and not complete:
            out.append((*map(_text, key), "complete", 100))
        if latest is not None and latest + self.keep_ms > timer:
            if timer:
                self.handle.deleteTimer(timer)
            timer = latest + self.keep_ms
            self.handle.registerTimer(timer)
        self.progress.update((seen, max(told, bucket), complete or seen >= total, timer))
        yield pd.DataFrame(out, columns=[*self.keys, "event", "percent"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.progress.clear()
        yield pd.DataFrame([], columns=[*self.keys, "event", "percent"])

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return None if value is None else str(value)


def milestones(rows: DataFrame, keys: list[str], totals: dict[str, int], time: str, late: str = "1 day", keep_days: float = 30, step: int = 10) -> DataFrame:
    """Each tenth of a group's expected rows once (event `milestone`), and once that the group has all of them (`complete`).

    `keys` ends with the column that `totals` has expected rows for. State is typed and kept by Spark, so a restart from the checkpoint tells nothing twice; a group
    without rows for `keep_days` of event time behind the watermark (`late`) is forgotten, and rows that come after that begin anew. Needs the RocksDB state store (`stateful`)."""
    text = rows.withWatermark(time, late).withColumns({k: F.col(k).cast("string") for k in keys})
    schema = ", ".join([*[f"{k} string" for k in keys], "event string", "percent long"])
    return text.groupBy(*keys).transformWithStateInPandas(_Milestones(keys, time, totals, step, int(keep_days * 86_400_000)), schema, "Append", "EventTime")


def stateful(spark: SparkSession) -> SparkSession:
    """Streams of this session that start from now on keep their state in RocksDB, which typed state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def merge_states(path: str, state: Callable[[DataFrame], DataFrame], query: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's partial states by the name of its query and its number; a repeated batch replaces itself,
    and another query's batches (`query` must be another name for another checkpoint) stay.

    Reading all of `path` and merging gives the running statistics."""

    def run(batch: DataFrame, number: int) -> None:
        state(batch).write.mode("overwrite").parquet(f"{path}/query={query}/batch={number}")

    return run


def append_unseen(path: str, key: str, query: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose key the cache below `path` does not have yet; a null key is a key like others.

    Each batch has its folder by the name of its query and its number: a repeated batch replaces itself, and another query's batches (`query` must
    be another name for another checkpoint) stay. Within it rows lie by a hash of the key (always the same number of `buckets`), and a batch reads the parts of the cache alone that its own keys lie in."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
            schema = new.select(key).schema.add("query", "string").add("batch", "long").add("bucket", "integer")
            before = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(touched) & ((F.col("batch") != number) | (F.col("query") != query))).select(F.col(key).alias("__seen"))
            new = new.join(before, F.col(key).eqNullSafe(F.col("__seen")), "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/query={query}/batch={number}")

    return run


def progress(summary: DataFrame, rows: str, seconds: str, totals: DataFrame, key: str, total: str) -> DataFrame:
    """How far each group of a running summary is: done, percent, mean_seconds and eta_seconds (what is left, at its mean). `totals` has each group's expected rows; a group without has null percent and time."""
    ends = totals.select(F.col(key).alias("__key"), F.col(total).alias("__total"))
    x = summary.join(ends, summary[key].eqNullSafe(ends["__key"]), "left")
    left = F.greatest(F.lit(0), F.col("__total") - F.col(rows))
    percent, eta = F.try_divide(F.col(rows) * 100.0, F.col("__total")).cast("double"), F.when(F.col("__total").isNotNull(), left * F.col(seconds))
    return x.select(key, F.col(rows).alias("done"), percent.alias("percent"), F.col(seconds).alias("mean_seconds"), eta.alias("eta_seconds"))


def drain(stream: DataFrame, spark: SparkSession, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a bounded stream to its end and return its result: in append mode all rows, in complete mode the last state.

    Batches are written below `path` by their number, so nothing passes through the driver and a repeated batch replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    return (out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]) if mode == "complete" else out).drop("batch")
