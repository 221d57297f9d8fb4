"""Operators of the library on small tables with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions import keys as K
from maskloom.operators import masks as M
from maskloom.operators import records as R
from maskloom.operators import sampling as S
from maskloom.operators.profiles import ranked
from maskloom.sources import tables as T
from maskloom.sources.folders import new_folder
from maskloom.streaming import logs as L


def quotas(spark, caps, target, least):
    df = spark.createDataFrame([(f"t{i}", c) for i, c in enumerate(caps)], "task string, n long")
    return [r.quota for r in S.largest_remainder(df, "n", target, least).orderBy("task").collect()]


def test_quotas(spark):
    assert quotas(spark, [2, 3, 1000, 1000], 100, 20) == [2, 3, 48, 47]
    assert quotas(spark, [50, 50, 50], 60, 40) == [0, 20, 40]  # floors over the target: the largest give back
    assert quotas(spark, [5, 5], 100, 1) == [5, 5]
    assert quotas(spark, [5, 5], 0, 3) == [0, 0] and quotas(spark, [], 10, 3) == []
    assert sum(quotas(spark, [7, 19, 44, 3, 81], 90, 5)) == 90


def test_primary_buckets_fill_evenly(spark):
    """Items of one bucket go there; the others go where the least of the bucket's size is filled."""
    rows = [(i, 3, "a") for i in range(50)] + [(i, 3, t) for i in range(100, 400) for t in ("a", "b")] + [(7, 3, "a")]
    df = spark.createDataFrame(rows, "idx long, dim int, task string")
    got = S.primary_bucket(df.repartition(5), 1)
    assert got.count() == 350 and {r.idx for r in got.where("task = 'a'").collect()} >= set(range(50))
    n = {r.task: r["count"] for r in got.groupBy("task").count().collect()}
    assert 0.5 < (n["a"] / 350) / (n["b"] / 300) < 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.primary_bucket(df.coalesce(1), 1).collect()))
    assert S.primary_bucket(df.limit(0), 1).collect() == []


def window(spark, areas, n, **kw):
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(areas) if a], "case int, slice int, area int")
    got = M.window_select(df, ["case"], n, len(areas), 1000, **kw).collect()
    return got[0].start if got else None


def test_windows(spark):
    assert window(spark, [0, 0, 9, 0, 0, 5, 5, 5, 0, 0], 3) == 5  # full windows before the peak
    assert window(spark, [0, 9, 9, 9, 9, 20, 9, 0], 3) == 4  # centred on the largest slice
    assert window(spark, [0, 0, 0, 0, 0, 0, 0, 30], 3) == 5  # never past the end
    assert window(spark, [30, 0, 0, 0, 4, 4, 0, 0], 3, min_foreground=2) == 3  # two foreground slices at least, nearest to the peak
    assert window(spark, [5, 5, 5, 50, 5, 0, 9, 9, 9], 3, policy="area") == 1  # of equal areas the earliest
    assert window(spark, [1, 0, 0, 0, 3, 3, 3], 3) == 4  # a sliver of one pixel does not count
    assert window(spark, [0] * 8, 3) is None
    assert window(spark, [1, 0, 0, 0], 2) == 0
    for policy in ("weighted", "uniform"):
        assert window(spark, [0, 4, 4, 4, 0], 3, policy=policy) == 1
    with pytest.raises(ValueError):
        window(spark, [1, 1], 3)


def test_a_large_group_is_numbered_over_tasks(spark):
    df = spark.range(20_000).select((F.col("id") % 7 > 0).alias("hot"), (F.col("id") * 7919 % 20_000).alias("o")).repartition(8)
    got = ranked(df, ["hot"], ["o"])
    bad = got.groupBy("hot").agg(F.count("*").alias("n"), F.min("position").alias("a"), F.max("position").alias("b"), F.countDistinct("position").alias("d"), F.max("group_rows").alias("g")).where("n <> b or a <> 1 or d <> n or g <> n")
    assert bad.collect() == []
    x = got.where("hot").orderBy("position").select("o").toPandas()["o"].to_numpy()
    assert (np.diff(x) > 0).all()


def test_a_second_query_leaves_the_cache_of_the_first(spark):
    path, schema = new_folder(spark, "unseen"), "k long, v string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    first, second = L.append_unseen(path, "k", "first"), L.append_unseen(path, "k", "second")
    first(frame([(1, "a"), (2, "a"), (3, "a"), (None, "a")]), 0)
    second(frame([(4, "b"), (2, "b"), (None, "b")]), 0)
    second(frame([(4, "b"), (2, "b"), (None, "b")]), 0)  # the batch again
    first(frame([(5, "c"), (None, "c")]), 1)
    assert sorted(((r.k or 0), r.v) for r in spark.read.parquet(path).collect()) == [(0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c")]


def test_heartbeats_of_a_stream(spark):
    path = new_folder(spark, "beats")
    beats = [("a", m) for m in (0, 5, 40, 45, 50)] + [("b", m) for m in (1, 2)] + [("a", 3000)]
    spark.createDataFrame(beats, "model string, m int").select("model", F.timestamp_seconds(F.col("m") * 60).alias("ts")).write.parquet(path)
    rows = spark.readStream.schema("model string, ts timestamp").parquet(path)
    out = L.drain(L.heartbeat_gaps(rows, ["model"], "ts", "20 minutes", "1 hour"), spark, new_folder(spark, "out"), "append", new_folder(spark, "check"))
    got = sorted((r.model, r.beats) for r in out.collect())
    assert got == [("a", 2), ("a", 3), ("b", 2)]  # the last beat's attempt may still go on


def test_stored_policies(spark):
    good = {"applied": True, "min_component_voxels_3d": 64, "mask_qc_downsample_3d": 2, "min_slice_area_px_3d": 32, "min_slice_area_fraction_3d": 0, "min_qualified_slices_3d": 2, "require_contiguous_qualified_slices_3d": True}
    cases = [(good, True), (good | {"min_component_voxels_3d": 63}, False), (good | {"min_component_voxels_3d": True}, False), (good | {"min_slice_area_px_3d": "32"}, False), (good | {"min_slice_area_px_3d": 32.5}, False),
             (good | {"min_slice_area_fraction_3d": 0.5}, True), (good | {"min_slice_area_fraction_3d": False}, False), (good | {"applied": 1}, False), (good | {"applied": "true"}, False), (good | {"mask_qc_downsample_3d": 1}, False),
             ({k: v for k, v in good.items() if k != "min_qualified_slices_3d"}, False), (good | {"require_contiguous_qualified_slices_3d": None}, False)]
    rows = [(i, json.dumps(p), want) for i, (p, want) in enumerate(cases)] + [(90, None, False), (91, "{bad", False), (92, "[1]", False)]
    df = spark.createDataFrame(rows, "i int, policy string, want boolean")
    assert [(r.i, r.got) for r in df.select("i", "want", R.policy_trusted(F.col("policy"), {}).alias("got")).orderBy("i").collect()] == [(i, want) for i, _, want in rows]


def test_meta_values_paths_and_headers(spark):
    df = spark.createDataFrame([(1, None, " x "), (2, " ", "None"), (3, "a", "b"), (4, None, None)], "i int, a string, b string")
    assert [r.m for r in df.orderBy("i").select(K.meta_value(F.col("a"), F.col("b")).alias("m")).collect()] == ["x", "unknown", "a", "unknown"]
    paths = spark.createDataFrame([("Train/p/1.jpg",), ("VALID/p/2.jpg",), ("test/3",), ("other/4",), (None,)], "p string")
    assert [r.s for r in paths.select(K.split_of_path(F.col("p")).alias("s")).collect()] == ["train", "test", "test", "train", "train"]
    head = (348).to_bytes(4, "little") + bytes(340) + b"n+1\0"
    rows = [(head, "a.nii", None), (head[:100], "a.nii", "short_header"), (b"\0" + head[1:], "a.NII", "bad_header_length"), (head[:344] + b"abcd", "a.nii", "bad_magic"), (b"", "a.png", None), ((348).to_bytes(4, "big") + head[4:], "b.nii", None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, head binary, path string, want string").orderBy("i").select("want", R.nifti_reason(F.col("head"), F.col("path")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_audit_split_and_seed(spark):
    rows = [(1, 3, "box", [0, 1, 2], [0, 1, 2, 3], None), (2, 3, "point", [1], [0], [1]), (3, 2, "mask", None, None, None)]
    df = spark.createDataFrame(rows, "i int, n_frames int, prompt_mode string, actual array<int>, cached array<int>, mask_frames array<int>")
    flags = [tuple(r)[6:] for r in R.prompt_audit(df).orderBy("i").collect()]
    assert flags == [(True, True, False, False), (False, False, True, True), (False, True, False, True)]
    g = spark.createDataFrame([("g", ["p", "q"], [(0, "m0"), (1, "m1")], False), ("h", ["p", "q"], [(0, "m0")], True), ("k", ["p"], [(5, "m")], False), ("e", [], [], False)], "identifier string, images array<string>, masks array<struct<image_index int, path string>>, shared boolean")
    got = sorted((r.identifier, r.image, [tuple(m) for m in r.masks]) for r in R.split_modalities(g, F.col("shared")).collect())
    assert got == [("e", None, []), ("g_modality0", "p", [(0, "m0")]), ("g_modality1", "q", [(0, "m1")]), ("h_modality0", "p", [(0, "m0")]), ("h_modality1", "q", [(0, "m0")]), ("k", "p", [(5, "m")])]
    seq = spark.createDataFrame([("d", 3, "m1"), ("d", 3, "m1"), ("d", 2, "m2"), (None, 3, "m3"), ("d", 3, ""), ("d", 3, None)], "dataset string, dim int, mask string")
    assert sorted(map(tuple, R.cache_seed([seq, seq]).collect())) == [("d", "m1", True), ("unknown", "m3", True)]


def test_resume_and_appended_statistics(spark):
    schema = "model string, case_id long, seq long, status string"
    lines = spark.createDataFrame([("a", 1, 1, "ok"), ("a", 1, 2, "OK"), ("a", None, 3, "ok"), ("a", 2, 4, "failed")], schema)
    table = spark.createDataFrame([("a", 9, 9, "ok")] * 4, schema)
    source, rows = T.resume_rows(lines, table.limit(3), ["model", "case_id"], "seq")
    assert source == "jsonl" and sorted(r.seq for r in rows.collect()) == [2, 3]
    source, rows = T.resume_rows(lines, table, ["model", "case_id"], "seq")
    assert source == "csv" and rows.count() == 4
    assert T.resume_rows(lines.limit(0), table.limit(0), ["model", "case_id"], "seq")[0] is None
    path, stats = new_folder(spark, "stats"), "path string, length long, voxels long"
    T.append_stats(path, spark.createDataFrame([("p", 1, 10), ("q", None, 5)], stats), ["path", "length"])
    got = T.append_stats(path, spark.createDataFrame([("p", 1, 99), ("q", None, 99), ("p", 2, 7)], stats), ["path", "length"])
    assert sorted((r.path, r.length or 0, r.voxels) for r in got.collect()) == [("p", 1, 10), ("p", 2, 7), ("q", 0, 5)]
