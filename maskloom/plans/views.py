"""The library's input shapes, derived from the test tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def case_results(spark: SparkSession, sf: str) -> DataFrame:
    """One row per model, prompt mode and case, with metrics, time and memory."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    dice = F.col("l_discount") * 10
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("prompt_mode"), F.lit("validation_forward").alias("protocol"),
        F.col("l_partkey").alias("dataset_index"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("case_id"), F.col("p_brand").alias("dataset_name"),
        F.col("p_type").alias("modality"), F.concat(F.lit("t"), (F.col("p_size") % 10).cast("string")).alias("task_id"), (F.col("l_partkey") % 2 + 2).cast("int").alias("dim"),
        dice.alias("dice"), (dice / (2 - dice)).alias("iou"), F.col("l_quantity").alias("wall_time_sec"), (F.col("l_partkey") % 250 + 1).alias("n_frames"),
        F.when(F.col("l_tax") >= 0.08, "failed").otherwise("ok").alias("status"), (F.col("l_extendedprice") / 1000).alias("memory_baseline_mb"),
        (F.col("l_extendedprice") / 1000 + F.col("l_quantity")).alias("memory_peak_mb"), F.col("l_quantity").cast("long").alias("tp"), (F.col("l_orderkey") % 17).alias("fp"),
        (F.col("l_suppkey") % 13).alias("fn"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("seq"),
    )


CASES = """cases AS (SELECT l_returnflag AS model, l_linestatus AS prompt_mode, 'validation_forward' AS protocol, l_partkey AS dataset_index, 'c' || l_partkey AS case_id,
  p_brand AS dataset_name, p_type AS modality, 't' || (p_size % 10) AS task_id, CAST(l_partkey % 2 + 2 AS INT) AS dim, l_discount * 10 AS dice, l_discount * 10 / (2 - l_discount * 10) AS iou,
  l_quantity AS wall_time_sec, l_partkey % 250 + 1 AS n_frames, CASE WHEN l_tax >= 0.08 THEN 'failed' ELSE 'ok' END AS status, l_extendedprice / 1000 AS memory_baseline_mb,
  l_extendedprice / 1000 + l_quantity AS memory_peak_mb, CAST(l_quantity AS BIGINT) AS tp, l_orderkey % 17 AS fp, l_suppkey % 13 AS fn, ((l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey) * 1000 + l_suppkey AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
OK = CASES + ", ok AS (SELECT * FROM cases WHERE status = 'ok')"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """One row per case, frame and pixel: probability and truth. A quarter of the frames have no truth."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))
    frame = F.floor(F.col("pos") / 16)
    truth = ((F.col("vec_id") * 31 + F.col("pos") * 17) % 5 < 2) & ((F.col("vec_id") + frame) % 4 != 0)
    return e.select(
        F.col("vec_id").alias("case_id"), frame.cast("int").alias("frame_idx"), (F.col("pos") % 16).cast("int").alias("px"), (1 / (1 + F.exp(-8 * F.col("value").cast("double")))).alias("prob"),
        truth.cast("int").alias("gt"), F.col("label").alias("task"), (F.col("vec_id") % 2 + 2).cast("int").alias("dim"),
    )


PIXELS = """pixels AS (SELECT vec_id AS case_id, CAST((pos - 1) // 16 AS INT) AS frame_idx, CAST((pos - 1) % 16 AS INT) AS px, 1 / (1 + exp(-8 * CAST(embedding[pos] AS DOUBLE))) AS prob,
  CASE WHEN (vec_id * 31 + (pos - 1) * 17) % 5 < 2 AND (vec_id + (pos - 1) // 16) % 4 <> 0 THEN 1 ELSE 0 END AS gt, label AS task, CAST(vec_id % 2 + 2 AS INT) AS dim
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Image paths: source/lang/split/case with zero-padded numbers."""
    d = table(spark, sf, "documents")
    stem = F.format_string("case%05d_img%03d", F.col("doc_id"), F.col("doc_id") % 7)
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", split, F.concat(stem, F.when(F.col("doc_id") % 3 == 0, ".nii.gz").when(F.col("doc_id") % 3 == 1, ".png").otherwise(".dcm"))).alias("path"))


FILES = """files AS (SELECT doc_id, source || '/' || lang || '/' || CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END || '/case' || printf('%05d', doc_id) || '_img' || printf('%03d', doc_id % 7)
  || CASE doc_id % 3 WHEN 0 THEN '.nii.gz' WHEN 1 THEN '.png' ELSE '.dcm' END AS path FROM documents)"""


def mask_files(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    kind = F.when(F.col("quality") == 1, "organ").otherwise("lesion")
    stem = F.format_string("case%05d_mask%03d", F.col("doc_id"), F.col("doc_id") % 7)
    return d.join(lab, "doc_id").select("doc_id", F.concat_ws("/", "source", "lang", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"), F.concat(stem, F.lit("_%"), kind, F.lit("%.png"))).alias("path"), kind.alias("class"))


MASKS = """masks AS (SELECT doc_id, source || '/' || lang || '/' || CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END || '/case' || printf('%05d', doc_id) || '_mask' || printf('%03d', doc_id % 7)
  || '_%' || CASE WHEN quality = 1 THEN 'organ' ELSE 'lesion' END || '%.png' AS path, CASE WHEN quality = 1 THEN 'organ' ELSE 'lesion' END AS class FROM documents JOIN labels USING (doc_id))"""


#: Rows of a task, where a table has more of them: a task's memory is the same for any table.
ROWS = 100_000


def dealt(rows: DataFrame, n: int, key: str) -> DataFrame:
    """`rows` (`n` of them) in parts by `key` whose number grows with them alone; tables of less than two parts stay as they are.

    Spark's own shuffle partitions are no measure: where there are many, they are put together again by their bytes, which are few a row."""
    parts = n // ROWS
    return rows.repartition(parts, key) if parts > 1 else rows


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse foreground voxels of volumes of shape 8 x 64 x 64. Large tables are dealt by case once, which holds for all that follows by case."""
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("z"), F.col("l_quantity").cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x"), "l_orderkey")
    rows = dealt(rows, li.count(), "case_id")  # counted from the files' footers
    return rows.groupBy("case_id", "z", "y", "x").agg((F.min("l_orderkey") % 3 + 1).cast("int").alias("label"))


VOXELS = """voxels AS (SELECT l_suppkey AS case_id, l_linenumber AS z, CAST(l_quantity AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x, CAST(min(l_orderkey) % 3 + 1 AS INT) AS label FROM lineitem GROUP BY 1, 2, 3, 4)"""


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("dataset"), F.col("p_type").alias("subdataset"), (F.col("p_partkey") % 2 + 2).cast("int").alias("dim"), F.array(F.concat(F.lit("k"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("j"), (F.col("p_size") % 3).cast("string"))).alias("tasks"))


SEQUENCES = """sequences AS (SELECT p_partkey AS idx, p_brand AS dataset, p_type AS subdataset, CAST(p_partkey % 2 + 2 AS INT) AS dim, ['k' || (p_size % 5), 'j' || (p_size % 3)] AS tasks FROM part)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", (F.col("user_id") % 5).alias("model"), F.col("event_type").alias("dataset"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


LOG = """log AS (SELECT event_id, ts, user_id % 5 AS model, event_type AS dataset, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
