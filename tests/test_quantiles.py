"""Exact order statistics against numpy: ties, nulls, groups of one value, wide ranges, narrow turns; and what the plans hold."""

import math
import random

import numpy as np
import pytest

from maskloom.operators import profiles, quantiles, results, sampling

SHARES = {"lo": 0.005, "q": 0.25, "m": 0.5, "hi": 0.995, "first": 0.0, "last": 1.0}


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v double")


def brute(rows):
    groups = {}
    for k, v in rows:
        groups.setdefault(k, [])
        if v is not None and not math.isnan(v):
            groups[k].append(v)
    return {k: [float(np.percentile(v, 100 * s)) if v else None for s in SHARES.values()] for k, v in groups.items()}


def check(spark, rows):
    got = {r["k"]: [r[c] for c in SHARES] for r in quantiles.percentiles(table(spark, rows), ["k"], "v", SHARES).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all(a is b is None or a == pytest.approx(b, rel=1e-12, abs=1e-300) for a, b in zip(got[k], w)), k


ROWS = (
    [("mostly one", 0.0)] * 900 + [("mostly one", float(i)) for i in range(-50, 50)] + [("nulls", None), ("nulls", math.nan), ("one", 7.5), (None, 1.0), (None, 3.0), (None, None)]
    + [("wide", s * 10.0**e) for e in range(-300, 300, 7) for s in (-1, 1)] + [("ends", 1.7e308), ("ends", -1.7e308), ("ends", 5e-324), ("ends", 0.0)]
)


@pytest.mark.parametrize("few", [50_000, 3])
def test_percentiles_equal_numpy(spark, monkeypatch, few):
    """With few values left singly, and by narrower bands in turn."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BANDS", 1024 if few > 3 else 4)
    rng = random.Random(1)
    check(spark, ROWS + [(f"g{i % 4}", rng.gauss(1000, 1 if i % 4 else 1e-9)) for i in range(2000)])


def test_without_keys_and_empty(spark):
    df = table(spark, [("a", float(i)) for i in range(11)])
    assert [tuple(r) for r in quantiles.percentiles(df, [], "v", {"m": 0.5, "t": 0.95}).collect()] == [(5.0, 9.5)]
    assert quantiles.percentiles(df.limit(0), ["k"], "v", {"m": 0.5}).collect() == []


def test_places_with_the_rows_before_and_beside_them(spark):
    df = table(spark, [("a", float(x)) for x in (1, 2, 2, 2, 3)])
    r = quantiles.order_statistics(df, ["k"], "v", {"x": lambda n: n - 3, "none": lambda n: n + 1}).first()
    assert tuple(r["x"]) == (2.0, 1, 3) and r["none"] is None and r["__n"] == 5


def test_windows_of_groups_of_nulls_and_ties(spark):
    got = {r["k"]: r for r in profiles.percentile_window(table(spark, ROWS), ["k"], "v").collect()}
    assert got["nulls"]["window_lower"] is None and got["one"]["window_upper"] == 7.5 and got[None]["window_lower"] == pytest.approx(1.01)
    z = {(r["k"], r["v"]): r["z"] for r in profiles.window_zscore(table(spark, [("a", 1.0), ("a", 3.0), (None, 2.0)]), "k", "v", 0.0, 1.0).collect()}
    assert z == {("a", 1.0): -1.0, ("a", 3.0): 1.0, (None, 2.0): 0.0}


def test_a_hot_group_is_counted_before_it_is_shuffled(spark, tmp_path):
    """Nine tenths of the rows have one value: the shuffled bands are a few rows for each task, whatever the rows."""
    df = spark.range(200_000, numPartitions=8).selectExpr("'hot' as k", "if(id % 10 < 9, 0.0, cast(id as double)) as v")
    counted = quantiles.percentiles(df, ["k"], "v", {"m": 0.5, "t": 0.95})
    assert [tuple(r) for r in counted.collect()] == [("hot", 0.0, float(np.percentile([0.0 if i % 10 < 9 else float(i) for i in range(200_000)], 95)))]
    assert "percentile" not in counted._jdf.queryExecution().optimizedPlan().toString().lower().replace("order-statistics", "")


def test_ranks_of_a_group_that_spreads_over_tasks(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice([None, "b", "c"]), rng.randrange(50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    out = profiles.ranked(df, ["k"], ["o", "i"]).collect()
    for k in ("hot", None, "b", "c"):
        own = sorted((o, i) for x, o, i in rows if x == k)
        assert sorted((r["position"], r["o"], r["i"]) for r in out if r["k"] == k) == [(n + 1, o, i) for n, (o, i) in enumerate(own)]
        assert {r["group_rows"] for r in out if r["k"] == k} == {len(own)}


def test_split_of_ties_and_small_groups(spark):
    rows = [(g, f"i{n % 40}" if g == "ties" else f"{g}{n}") for g, size in (("one", 1), ("four", 4), ("ties", 200), (None, 50)) for n in range(size)]
    df = spark.createDataFrame(rows, "g string, ident string")
    got = sampling.exact_fraction_split(df, ["g"], "ident", 0.25, 1).groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in got} == {("one", "train"): 1, ("four", "val"): 1, ("four", "train"): 3, ("ties", "val"): 50, ("ties", "train"): 150, (None, "val"): 12, (None, "train"): 38}


def test_distinct_cases_of_a_group_count_once(spark):
    df = spark.createDataFrame([("m", "d1", "c1", 1.0), ("m", "d1", "c1", 3.0), ("m", "d2", "c1", 5.0), ("m", "d2", "c2", math.nan), (None, "d", None, 1.0)], "model string, dataset_name string, case_id string, dice double")
    got = {r["model"]: (r["dice"], r["n_datasets"], r["n_cases"]) for r in results.dataset_macro_summary(df, ["model"], ["dice"]).collect()}
    assert got == {"m": (3.5, 2, 2), None: (1.0, 1, 0)}
