"""Heads of files and their reasons; prompt plans, labels and caches of the library on small tables."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from maskloom.operators import sampling as S
from maskloom.sources import heads as H
from maskloom.sources import tables as T
from maskloom.sources.folders import new_folder

GOOD = b"\x5c\x01\x00\x00" + bytes(340) + b"n+1\0" + b"\xab" * 5000


def test_reasons_of_files_of_any_length(spark, tmp_path):
    files = {
        "good.nii": (GOOD, None), "good.nii.gz": (gzip.compress(GOOD), None), "LARGE.nii.gz": (gzip.compress(GOOD + os.urandom(300_000)), None), "large.nii": (GOOD + bytes(300_000), None),
        "no.nii.gz": (b"PNG" * 900, "bad_gzip"), "cut.nii.gz": (gzip.compress(GOOD[:200]), "short_header"), "torn.nii.gz": (gzip.compress(os.urandom(9000))[:60], "short_header"),
        "len.nii.gz": (gzip.compress(b"\x5d" + GOOD[1:]), "bad_header_length"), "magic.nii.gz": (gzip.compress(GOOD[:344] + b"xxxx" + os.urandom(200_000)), "bad_magic"), "magic.nii": (GOOD[:344] + b"xxxx", "bad_magic"),
        "broken.nii.gz": (b"\x1f\x8b" + b"\xff" * 500, "short_header"), "other.png": (b"PNG", None), "other.gz": (gzip.compress(b"x"), None),
    }
    (tmp_path / "deep").mkdir()
    (tmp_path / "none.nii.gz").write_bytes(b"")  # no row
    for i, (name, (data, _)) in enumerate(files.items()):
        (tmp_path / ("deep" if i % 2 else "") / name).write_bytes(data)
    for whole in (1 << 26, 1000):  # all read by Spark; the longer ones opened by the tasks
        df = H.file_heads(spark, f"file://{tmp_path}", most=65_536, whole=whole)
        got = {r["path"].rsplit("/", 1)[1]: (r["reason"], r["n"], r["length"]) for r in df.select("path", "length", F.length("head").alias("n"), H.header_reason(F.col("length"), F.col("head"), F.col("path")).alias("reason")).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in files.items()}
        assert all(n == min(length, 65_536) for _, n, length in got.values())
    assert {r["path"].rsplit("/", 1)[1] for r in H.file_heads(spark, f"file://{tmp_path}", exts=[".png"]).collect()} <= {"other.png"}


def test_inflating_stops_at_its_bound(spark):
    bomb = gzip.compress(bytes(50_000_000))
    r = spark.createDataFrame([(bomb,), (None,)], "h binary").select(F.length(H.inflated(F.col("h"))).alias("n")).collect()
    assert [x["n"] for x in r] == [H.HEADER, None]


def test_a_case_without_a_usable_prompt_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, True, False), (1, 1, False, True), (1, 2, None, False), (2, 0, False, True)], "case long, frame_idx int, b boolean, m boolean")
    usable = {"box": F.col("b"), "mask": F.col("m")}
    plan = lambda mode, **kw: sorted(tuple(r) for r in S.prompt_plan(df, mode, usable, F.lit("mask"), **kw).collect())
    assert plan("mixed") == [(1, 0, "box"), (1, 1, "mask"), (2, 0, "mask")] and plan("mask") == [(1, 1, "mask"), (2, 0, "mask")]
    assert plan("box", strict=False) == [(1, 0, "box")]
    with pytest.raises(Exception, match="no usable box prompt in case 2"):
        plan("box")
    with pytest.raises(ValueError):
        plan("point")


def test_labels_artifacts_and_quality_caches(spark):
    names = spark.createDataFrame([("liver", "Liver (ct)")], "task string, display string")
    df = spark.createDataFrame([("liver",), ("task_one",), (None,)], "task string")
    assert {r["task"]: r["label"] for r in S.task_label(df, "task", names).collect()} == {"liver": "Liver (ct)", "task_one": "task one", None: "unknown"}
    path = new_folder(spark, "artifacts")
    df.na.fill("none").write.option("header", True).csv(f"{path}/b.csv")
    found = T.artifacts(spark, path, {"x": ["a.csv", "b.csv"], "y": ["c.csv"]})
    assert found["y"] is None and [tuple(r) for r in T.artifact_counts(spark, found).orderBy("artifact").collect()] == [("x", 3, 1), ("y", 0, 0)]
    spark.createDataFrame([(1, False, 0), (2, True, 1), (3, False, 1), (4, True, 2)], "k long, ok boolean, p int").write.partitionBy("p").parquet(f"{path}/q")
    assert {r["k"] for r in T.quality_cache(spark, f"{path}/q", "p", 0, [1]).collect()} == {1, 2}
