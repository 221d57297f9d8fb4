"""Mask operators and quality rules on small volumes with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions.keys import Pattern
from maskloom.operators import masks as M
from maskloom.operators import records as R
from maskloom.operators.boxes import nms


def brute_components(points):
    left, out = {tuple(p): i for i, p in enumerate(points)}, {}
    for p in list(left):
        if p in out:
            continue
        todo, seen = [p], {p}
        while todo:
            q = todo.pop()
            for d in np.ndindex(*[3] * len(q)):
                r = tuple(a + b - 1 for a, b in zip(q, d))
                if r in left and r not in seen:
                    seen.add(r), todo.append(r)
        for q in seen:
            out[q] = min(left[s] for s in seen)
    return [out[tuple(p)] for p in points]


@pytest.mark.parametrize("dims", [2, 3])
def test_components(dims):
    rng = np.random.default_rng(dims)
    for share in (0.1, 0.3, 0.6):
        points = np.argwhere(rng.random([9] * dims) < share)
        assert M.components(points).tolist() == brute_components(points)


#: z slices, y size, x size, policy (voxels, area, slices, contiguous), expected reason.
CASES = {
    "keep": (range(6), 8, 8, (0, 32, 3, True), None),
    "area": ([0], 4, 4, (0, 32, 0, False), "component_below_minimum_slice_area_3d"),
    "count": (range(2), 8, 8, (0, 32, 3, False), "component_below_minimum_slices_3d"),
    "voxels": ([0], 7, 9, (64, 0, 0, False), "component_below_minimum_voxels_3d"),
    "voxels_kept": ([0], 8, 8, (64, 0, 0, False), None),
}


@pytest.mark.parametrize("name", CASES)
def test_quality(spark, name):
    zs, h, w, (voxels, area, slices, contiguous), want = CASES[name]
    rows = [(1, 1, z, y, x) for z in zs for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "case_id int, component int, z int, y int, x int")
    got = M.component_quality_3d(df, ["case_id"], "z", voxels, area, slices, contiguous).collect()
    assert [r.reason for r in got] == [want]


def test_scattered_slices_are_not_contiguous(spark):
    rows = [(1, 1, z, y, x) for z in (0, 4, 8) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "case_id int, component int, z int, y int, x int")
    assert M.component_quality_3d(df, ["case_id"], "z", 0, 32, 3, True).first().reason == "component_below_minimum_contiguous_slices_3d"
    assert M.component_quality_3d(df, ["case_id"], "z", 0, 32, 3, False).first().reason is None
    s = M.slice_areas(df, ["case_id"], "z")
    assert not M.contiguous_window(s, ["case_id"], 3, 32).first().has_window and M.contiguous_window(s, ["case_id"], 1, 32).first().has_window


def test_fill_holes_and_islands(spark):
    ring = [(1, y, x) for y in range(2, 7) for x in range(2, 7) if y in (2, 6) or x in (2, 6)]
    open_ring = [(2, y, x) for _, y, x in ring if (y, x) != (2, 4)]
    df = spark.createDataFrame(ring + open_ring + [(3, 0, 0)], "case_id int, y int, x int")
    got = {r.case_id: r.n for r in R.fill_holes(df, ["case_id"], 9, 9).groupBy("case_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 25, 2: 15, 3: 1}
    parts = M.connected_components(spark.createDataFrame([(1, 0, i) for i in range(5)] + [(1, 5, 5)] + [(2, 0, 0), (2, 4, 4)], "case_id int, y int, x int"), ["case_id"], ("y", "x"))
    assert sorted((r.case_id, r.y, r.x) for r in R.remove_islands(parts, ["case_id"], 3).collect()) == [(1, 0, i) for i in range(5)] + [(2, 0, 0)]


def test_nms(spark):
    rows = [(1, 0, 0, 10, 10, 0.9, 1), (1, 1, 1, 10, 10, 0.8, 2), (1, 50, 50, 5, 5, 0.7, 3), (2, 0, 0, 10, 10, 0.5, 4), (1, 0, 0, 10, 10, 0.9, 5)]
    df = spark.createDataFrame(rows, "image int, x0 int, y0 int, w int, h int, score double, tie int")
    assert sorted(r.tie for r in nms(df, ["image"], "score", "tie", 0.5).collect()) == [1, 3, 4]


def test_nms_of_many_images(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), *map(int, rng.integers(0, 60, 2)), *map(int, rng.integers(5, 40, 2)), float(rng.integers(0, 9)), k) for k, i in enumerate(rng.integers(0, 25, 400))]
    want = []
    for image in range(25):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[5], r[6])):
            def over(q):
                both = max(0, min(r[1] + r[3], q[1] + q[3]) - max(r[1], q[1])) * max(0, min(r[2] + r[4], q[2] + q[4]) - max(r[2], q[2]))
                return both > 0.3 * (r[3] * r[4] + q[3] * q[4] - both)
            if not any(map(over, kept)):
                kept.append(r)
        want += [r[6] for r in kept]
    df = spark.createDataFrame(rows, "image int, x0 int, y0 int, w int, h int, score double, tie int")
    assert sorted(r.tie for r in nms(df, ["image"], "score", "tie", 0.3).collect()) == sorted(want)
    assert nms(df.limit(0), ["image"], "score", "tie", 0.3).collect() == []


def test_slice_order_by_normal_or_instance(spark):
    o = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0]  # normal along -z
    rows = [("a", 1, o, [0.0, 0.0, 5.0]), ("a", 2, o, [0.0, 0.0, 9.0]), ("a", 3, o, [0.0, 0.0, 1.0]), ("b", 7, None, None), ("b", 3, o, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "series string, instance_number int, orientation array<double>, position array<double>")
    got = {(r.series, r.instance_number): r.slice_number for r in R.slice_order(df, "series").collect()}
    assert got == {("a", 2): 1, ("a", 1): 2, ("a", 3): 3, ("b", 3): 1, ("b", 7): 2}


def test_patterns_match_whole_values(spark):
    p = Pattern(r"(?P<id>\d+)_(?P<part>[a-z]+)?(?P=id)\.png")
    df = spark.createDataFrame([("12_a12.png",), ("12_12.png",), ("12_a13.png",), ("12_a12.png\n",)], "x string")
    got = df.select(p.matches(F.col("x")).alias("m"), p.group(F.col("x"), "id").alias("i"), p.extras(F.col("x")).alias("e")).collect()
    assert [(r.m, r.i, r.e) for r in got] == [(True, "12", {"part": "a"}), (True, "12", {}), (False, None, {}), (False, None, {})]


def test_every_row_of_a_stack_gets_its_number(spark):
    from maskloom.plans import registry
    from maskloom.plans.views import voxels

    sf = "/root/testdata/sf0.01"
    want = {r.case_id: r["count"] for r in voxels(spark, sf).groupBy("case_id").count().collect()}
    got = {r.case_id: (r.n, r.least, r.most, r.d) for r in registry.QUERIES["stack_slices"](spark, sf).groupBy("case_id").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.countDistinct("k").alias("d")).collect()}
    assert max(want.values()) > 20
    assert got == {c: (n, 1, n, n) for c, n in want.items()}
    print("rows", sum(want.values()))


def test_an_image_without_foreground_has_the_full_extent(spark):
    v = spark.createDataFrame([(1, 2, 60), (1, 3, 61)], "case_id int, y int, x int")
    images = spark.createDataFrame([(1,), (2,)], "case_id int")
    got = sorted(tuple(r) for r in M.bbox(v, ["case_id"], {"y": 8, "x": 64}, images).collect())
    assert got == [(1, 2, 4, 60, 62, True), (2, 0, 8, 0, 64, False)]


def test_large_voxel_tables_are_dealt_once_in_parts_that_grow(spark, monkeypatch):
    """Run lengths of a table of more rows than the shuffle partitions hold: one exchange, by case, in as many parts as its rows ask for; the same rows."""
    from maskloom.plans import registry, views

    sf = "/root/testdata/sf0.01"
    want = {name: sorted(map(repr, registry.QUERIES[name](spark, sf).collect())) for name in ("rle_encode", "rle_area")}
    monkeypatch.setattr(views, "ROWS", 2_000)
    for name, rows in want.items():
        df = registry.QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(case_id" in plan and ", 30)" in plan
        assert sorted(map(repr, df.collect())) == rows


def test_many_shuffle_partitions_do_not_keep_voxels_from_being_dealt(spark, monkeypatch):
    """Parts go by rows alone: with more shuffle partitions than parts, these would be put together again by their bytes."""
    from maskloom.plans import registry, views

    monkeypatch.setattr(views, "ROWS", 2_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        for name in ("rle_encode", "rle_area", "rle_decode"):
            plan = registry.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange ") == 1 and ", 30), REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_run_lengths_of_repeated_places_by_hand(spark):
    """Runs at both ends, single places, whole and repeated ones; places are sorted once, by two windows over one order."""
    masks = {1: [0, 1, 1, 2, 5, 9, 9], 2: [3], 3: list(range(10)), 4: [9, 8, 8, 0], 5: [1, 3, 5]}
    v = spark.createDataFrame([(k, p) for k, m in masks.items() for p in m], "k int, q int")
    coded = M.rle_encode(v, ["k"], M.F.col("q"), 10)
    plan = coded._jdf.queryExecution().executedPlan().toString()  # before it runs: a plan that has run shows its first form as well
    assert plan.count("Window [") == 2 and plan.count("Sort [") == 1
    assert {r.k: r.counts for r in coded.collect()} == {1: [0, 3, 2, 1, 3, 1], 2: [3, 1, 6], 3: [0, 10], 4: [0, 1, 7, 2], 5: [1, 1, 1, 1, 1, 1, 4]}
    assert sorted(map(tuple, M.rle_decode(coded, ["k"]).collect())) == sorted((k, p) for k, m in masks.items() for p in set(m))
