"""Queries over the event log read as a stream; each is run to its end and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import profiles
from maskloom.plans.base import query, rounded
from maskloom.plans.views import LOG, table
from maskloom.sources.folders import new_folder
from maskloom.streaming import logs as L


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("model"), F.col("event_type").alias("dataset"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _folder(spark) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local one where that is unset."""
    return new_folder(spark, "stream")


def _run(spark, stream, mode):
    return L.drain(stream, spark, _folder(spark), mode, _folder(spark))


@query(f"WITH {LOG} SELECT model, dataset, count(*) AS rows, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM log GROUP BY 1, 2")
def stream_running_summary(spark, sf):
    return rounded(_run(spark, L.running_summary(_stream(spark, sf), ["model", "dataset"], "value"), "complete"))


@query(f"WITH {LOG} SELECT DISTINCT model, dataset, k FROM log")
def stream_dedup_key(spark, sf):
    return _run(spark, L.unique_keys(_stream(spark, sf), ["model", "dataset", "k"], "ts", "1000 days").select("model", "dataset", "k"), "append")


@query(f"""WITH {LOG}, n AS (SELECT model, dataset, count(*) AS c FROM log GROUP BY 1, 2), t AS (SELECT dataset, max(c) AS total FROM n GROUP BY 1)
  SELECT CAST(model AS VARCHAR) AS model, dataset, 'milestone' AS event, CAST(b * 10 AS BIGINT) AS percent FROM n JOIN t USING (dataset) CROSS JOIN range(1, 11) r(b) WHERE b <= c * 100 // (total * 10)
  UNION ALL SELECT CAST(model AS VARCHAR), dataset, 'complete', 100 FROM n JOIN t USING (dataset) WHERE c >= total""")
def stream_milestones(spark, sf):
    per = table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("m"), "event_type").count()
    totals = {r["event_type"]: r["n"] for r in per.groupBy("event_type").agg(F.max("count").alias("n")).collect()}  # a row per event type
    return _run(L.stateful(spark), L.milestones(_stream(spark, sf), ["model", "dataset"], totals, "ts", "1000 days"), "append")


@query(f"WITH {LOG} SELECT dataset, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM log GROUP BY 1")
def stream_welford(spark, sf):
    path = _folder(spark)
    for name, rest in (("even", 0), ("odd", 1)):  # two queries over a half of the rows each add to the same states
        run = L.merge_states(path, lambda b: profiles.welford(b, ["dataset"], "value"), name)
        q = _stream(spark, sf).where(f"event_id % 2 = {rest}").writeStream.foreachBatch(run).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
        q.awaitTermination()
    return rounded(profiles.welford_merge(spark.read.parquet(path), ["dataset"]))


@query(f"WITH {LOG} SELECT k, CASE WHEN bool_or(event_id % 7 < 2) THEN 'first' ELSE 'second' END AS query, count(DISTINCT k) AS rows FROM log GROUP BY k")
def stream_qc_cache(spark, sf):
    """Two queries over different rows, each with its checkpoint: what the first has found stays, the second adds the rest."""
    path = _folder(spark)
    for name, rows in (("first", _stream(spark, sf).where("event_id % 7 < 2")), ("second", _stream(spark, sf))):
        q = rows.writeStream.foreachBatch(L.append_unseen(path, "k", name)).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(path).groupBy("k", "query").agg(F.count("*").alias("rows"))


@query(f"""WITH {LOG}, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY model ORDER BY ts) + INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS cut FROM log), s AS (SELECT *, sum(cut) OVER (PARTITION BY model ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM g)
  SELECT model, min(ts) AS start, max(ts) AS last_beat, count(*) AS beats FROM s GROUP BY model, grp""")
def heartbeat_gap(spark, sf):
    return _run(spark, L.heartbeat_gaps(_stream(spark, sf), ["model"], "ts", "20 minutes", "1 day"), "complete")


@query(f"WITH {LOG} SELECT dataset, count(*) AS done, round(count(*) * 100.0 / 5000, 6)::DOUBLE AS percent, round(avg(value), 6) AS mean_seconds, round(greatest(0, 5000 - count(*)) * avg(value), 3) AS eta_seconds FROM log GROUP BY 1")
def progress_eta(spark, sf):
    summary = _run(spark, L.running_summary(_stream(spark, sf), ["dataset"], "value"), "complete")
    totals = table(spark, sf, "events").select(F.col("event_type").alias("dataset"), F.lit(5000).alias("total")).distinct()
    out = L.progress(summary, "rows", "mean", totals, "dataset", "total")
    return rounded(out).withColumn("eta_seconds", F.round("eta_seconds", 3))
