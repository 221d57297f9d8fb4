"""Distances between masks against all pairs of border voxels."""

import math
import random

import numpy as np
import pytest

from maskloom.operators import distances


def border(mask):
    moves = [m for d in range(len(next(iter(mask)))) for m in (tuple(s if i == d else 0 for i in range(len(next(iter(mask))))) for s in (-1, 1))]
    return {p for p in mask if any(tuple(a + b for a, b in zip(p, m)) not in mask for m in moves)}


def brute(a, b, spacing):
    if not a and not b:
        return 0.0
    if not a or not b:
        return None
    x, y = (np.array(sorted(border(m)), float) * spacing for m in (a, b))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    return float(np.percentile(np.r_[d.min(1), d.min(0)], 95))


@pytest.mark.parametrize("axes,spacing", [(("y", "x"), (1, 1)), (("y", "x"), (2.5, 0.5)), (("z", "y", "x"), (3.0, 0.7, 1.0)), (("x",), (2.0,))])
def test_equals_all_pairs(spark, axes, spacing):
    rng = random.Random(len(axes))
    cases = {}
    for case in range(6):
        masks = []
        for _ in range(2):
            at = [rng.randrange(-3, 12) for _ in axes]
            size = [rng.randrange(1, 8) for _ in axes]
            box = {tuple(a + k for a, k in zip(at, step)) for step in np.ndindex(*size)}
            masks.append({p for p in box if rng.random() < 0.8} | {tuple(rng.randrange(30) for _ in axes)})
        cases[case] = masks
    cases[6], cases[7], cases[8] = (set(), set()), (cases[0][0], set()), (set(), cases[0][1])
    cases[9] = (cases[1][0], cases[1][0])
    frame = lambda side: spark.createDataFrame([(c, *p) for c, m in cases.items() for p in m[side]] * 2, "case long, " + ", ".join(f"{a} int" for a in axes))
    every = spark.createDataFrame([(c,) for c in cases] * 2, "case long")
    got = {r["case"]: r["hd95"] for r in distances.hd95(frame(0), frame(1), "case", axes, spacing, every).collect()}
    for c, (a, b) in cases.items():
        want = brute(a, b, spacing)
        assert got[c] == (want if want is None else pytest.approx(want, abs=1e-9)), c
    without = {r["case"]: r["hd95"] for r in distances.hd95(frame(0), frame(1), "case", axes, spacing).collect()}
    assert without.keys() == cases.keys() - {6} and without[7] is None is without[8]


def test_envelope_of_raised_parabolas():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 200):
        at = np.sort(rng.choice(400, n, replace=False))
        height = rng.integers(0, 3000, n).astype(float)
        wanted = np.arange(-20, 420)
        want = (height[None] + 0.49 * (wanted[:, None] - at[None]) ** 2).min(1)
        assert np.allclose(distances.envelope(at, height, wanted, 0.49), want)


def test_a_mask_of_a_million_border_voxels(spark):
    """A chequered mask of 1000 x 2000 places against its first column: every voxel is border, and its distance is its place."""
    a = spark.range(1000 * 2000).selectExpr("0 as case", "cast(id div 2000 as int) as y", "cast(id % 2000 as int) as x").where("(y + x) % 2 = 0")
    b = spark.range(1000).selectExpr("0 as case", "cast(id as int) as y", "0 as x")
    d = np.r_[[x for x in range(2000) for _ in range(500)], np.tile([0, 1], 500)].astype(float)
    assert distances.hd95(a, b, "case", ("y", "x")).first()["hd95"] == pytest.approx(float(np.percentile(d, 95)))
    assert math.isfinite(float(np.percentile(d, 95)))


def test_small_cases_write_no_lines_and_lines_say_the_same(spark, monkeypatch):
    """Cases whose pairs fit a call need no table of line distances; of cases of both kinds each is done by its own way, with the same results."""
    rng = random.Random(8)
    masks = [[(c, rng.randrange(20), rng.randrange(20)) for c in [None, 1, 2, 3] for _ in range((c or 1) * 12)] for _ in range(2)]
    a, b = (spark.createDataFrame(m, "case long, y int, x int") for m in masks)
    made, write = [], distances.written
    monkeypatch.setattr(distances, "written", lambda df, name: made.append(name) or write(df, name))
    told = lambda **how: {r["case"]: round(r["hd95"], 9) for r in distances.hd95(a, b, "case", ("y", "x"), (2.5, 0.5), **how).collect()}
    small = told()
    assert made == ["borders"] and small.keys() == {None, 1, 2, 3}
    assert told(pairs=500) == small and "line-distances" in made
    for c in small:
        assert small[c] == pytest.approx(brute(*({p[1:] for p in m if p[0] == c} for m in masks), (2.5, 0.5)), abs=1e-8)
