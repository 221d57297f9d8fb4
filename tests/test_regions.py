"""Components by tiles, small regions, cleaned masks, closing, and run algebra, against plain Python on places."""

import random

import numpy as np
import pytest

from maskloom.operators import masks as M
from maskloom.operators import regions, runs


def flood(places, eight=True):
    """Regions of places, each a sorted list, in order of their first place."""
    left, out = set(places), []
    for p in sorted(places):
        if p in left:
            left.discard(p)
            todo, found = [p], [p]
            while todo:
                q = todo.pop()
                for m in [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    r = (q[0] + m[0], q[1] + m[1])
                    if r in left:
                        left.discard(r), todo.append(r), found.append(r)
            out.append(sorted(found))
    return out


def cleaned(mask, h, w, area):
    holes = [r for r in flood({(y, x) for y in range(h) for x in range(w)} - mask) if len(r) < area]
    mask = mask | {p for r in holes for p in r}
    parts = flood(mask)
    small = [r for r in parts if len(r) < area]
    keep = [r for r in parts if len(r) >= area] or [max(parts, key=len)]
    return {p for r in keep for p in r}, bool(holes or small)


def masks_of(rng, n, h, w):
    out = {}
    for k in range(n):
        share = rng.choice([0.1, 0.4, 0.7, 0.9])
        out["ab"[k % 2], k] = {(y, x) for y in range(h) for x in range(w) if rng.random() < share} or {(0, 0)}
    out["a", 98], out["b", 99] = {(y, x) for y in range(h) for x in range(w)}, {(h - 1, w - 1)}
    return out


def table(spark, masks):
    return spark.createDataFrame([(i, m, y, x) for (i, m), p in masks.items() for y, x in p] * 2, "image string, mask int, y int, x int")


def test_small_regions_equal_flooding(spark):
    masks = masks_of(random.Random(1), 30, 9, 12)
    out = {}
    for r in regions.small_regions(table(spark, masks), ["image", "mask"], 9, 12, 4).collect():
        out.setdefault((r["image"], r["mask"]), (set(), r["changed"]))[0].add((r["y"], r["x"]))
    assert out == {k: cleaned(m, 9, 12, 4) for k, m in masks.items()}
    assert regions.small_regions(table(spark, {("a", 1): {(0, 0)}}).limit(0), ["image", "mask"], 9, 12, 4).collect() == []


def test_unchanged_masks_are_kept_before_changed_ones(spark):
    block = lambda y0, x0, n: {(y, x) for y in range(y0, y0 + n) for x in range(x0, x0 + n)}
    holed = block(0, 0, 6) - {(2, 2)}
    masks = {("a", 1): holed, ("a", 2): block(0, 0, 6), ("a", 3): block(8, 8, 4), ("b", 1): holed}
    got = {(r["image"], r["mask"]): r for r in regions.cleaned_masks(table(spark, masks), "image", "mask", 12, 12, 3, 0.7).collect()}
    assert set(got) == {("a", 2), ("a", 3), ("b", 1)}
    b = got["b", 1]
    assert b["changed"] and (b["x0"], b["y0"], b["x1"], b["y1"]) == (0, 0, 5, 5) and sum(b["counts"][1::2]) == 36 and sum(b["counts"]) == 144


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_tiles_give_the_same_numbers(spark, tile):
    rng = random.Random(2)
    at = [(k, z, y, x) for k in (1, None) for z in range(6) for y in range(8) for x in range(8) if rng.random() < (0.12 if k else 0.25)]
    at += [(3, 0, y, -4) for y in range(40)] + [(3, 0, 0, x) for x in range(-3, 30)]  # longer than any tile, over 0
    v = spark.createDataFrame(at, "k int, z int, y int, x int")
    want = sorted(map(repr, M.connected_components(v, ["k"]).collect()))
    assert sorted(map(repr, M.connected_components(v, ["k"], whole=60 if tile == 5 else 0, tile=tile).collect())) == want


def test_contracted_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(25)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in M.contracted(spark.createDataFrame(links, "a int, b int")).collect()}
    assert all(got.get(n, n) == find(n) for pair in links for n in pair)
    assert M.contracted(spark.createDataFrame([], "a int, b int")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7])
def test_closing_with_an_ellipse(spark, size):
    rng = random.Random(size)
    h, w, kernel = 12, 14, M.ellipse(size)
    masks = masks_of(rng, 4, h, w)
    inside = {(y, x) for y in range(h) for x in range(w)}
    px = table(spark, masks).distinct()
    out = {}
    for r in M.morph_close(px, ["image", "mask"], ("y", "x"), kernel, {"y": h, "x": w}).collect():
        out.setdefault((r["image"], r["mask"]), set()).add((r["y"], r["x"]))
    for k, m in masks.items():
        wide = {(y + dy, x + dx) for y, x in m for dy, dx in kernel} & inside
        assert out.get(k, set()) == {(y, x) for y, x in inside if all((y + dy, x + dx) in wide or (y + dy, x + dx) not in inside for dy, dx in kernel)}


def test_kernel_shapes():
    assert sorted(M.ellipse(3)) == sorted(M.cross()) and len(M.ellipse(5)) == 17 and len(M.ellipse(7)) == 33


def test_run_algebra_equals_sets_of_places(spark):
    rng = random.Random(5)
    masks = {side: {k: {p for p in range(96) if rng.random() < share} for k, share in enumerate((0.05, 0.5, 0.95, 0.3))} for side in "ab"}
    masks["a"][9], masks["b"][8] = {0, 95}, set(range(96))
    spec = "k int, p int"
    enc = {s: M.rle_encode(spark.createDataFrame([(k, p) for k, m in masks[s].items() for p in m], spec), ["k"], M.F.col("p"), 96) for s in "ab"}
    a, b = (runs.of_counts(enc[s], ["k"]) for s in "ab")
    for name, rule in (("difference", set.__sub__), ("union", set.__or__), ("intersection", set.__and__)):
        out = getattr(runs, name)(a, b, ["k"])
        want = {k: rule(masks["a"].get(k, set()), masks["b"].get(k, set())) for k in {*masks["a"], *masks["b"]}}
        got = {}
        for r in runs.places(out, ["k"]).collect():
            got.setdefault(r["k"], set()).add(r["p"])
        assert got == {k: m for k, m in want.items() if m}
        for r in runs.area(out, ["k"]).join(runs.box(out, ["k"], 12), "k").collect():
            m = want[r["k"]]
            assert r["area"] == len(m) and (r["line0"], r["line1"], r["offset0"], r["offset1"]) == (min(p // 12 for p in m), max(p // 12 for p in m) + 1, min(p % 12 for p in m), max(p % 12 for p in m) + 1)
        back = {r["k"]: r["counts"] for r in runs.to_counts(out, ["k"], 96).collect()}
        assert all(sum(c) == 96 and sum(c[1::2]) == len(want[k]) for k, c in back.items())
    assert {r["k"]: list(r["counts"]) for r in runs.to_counts(a, ["k"], 96).collect()} == {r["k"]: list(r["counts"]) for r in enc["a"].collect()}


def side_border(m, axes):
    return {p for p in m if any(tuple(a + b for a, b in zip(p, move)) not in m for move in M.cross(axes)[1:])}


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_masks_over_several_tiles_in_one_shuffle_row_a_voxel(spark, axes):
    """Masks that cross the borders of tiles, with negative places and repeated rows; borders, closings with and without an image, and no row of a voxel for each place of the kernel."""
    rng, names = random.Random(axes), ("z", "y", "x")[3 - axes :]
    size, low = {1: (300,), 2: (140, 150), 3: (21, 40, 130)}[axes], {1: -130, 2: -70, 3: -9}[axes]
    masks = {}
    for k, share in enumerate((0.02, 0.6, 0.97)):
        box = [tuple(rng.randrange(low, low + n) for n in size) for _ in range(30)]
        block = [(rng.randrange(-5, 20),) * axes for _ in range(1)][0]
        dense = [tuple(b + i for b, i in zip(block, step)) for step in np.ndindex(*[min(n, 25 if axes == 3 else 90) for n in size])]
        masks[k if k else None] = {p for p in dense if rng.random() < share} | set(box)
    px = spark.createDataFrame([(k, *p) for k, m in masks.items() for p in m] * 2, "k int, " + ", ".join(f"{n} int" for n in names))
    held = lambda df: {k: {tuple(r[n] for n in names) for r in rows} for k, rows in _by(df.collect())}

    def _by(rows):
        assert len(rows) == len(set(rows))
        return [(k, [r for r in rows if r["k"] == k]) for k in masks]

    assert held(M.border(px, ["k"], names)) == {k: side_border(m, axes) for k, m in masks.items()}
    for kernel in (M.cross(axes), [tuple(rng.randrange(-5, 6) for _ in range(axes)) for _ in range(4)]):
        wide = {k: {tuple(a + b for a, b in zip(p, d)) for p in m for d in kernel} for k, m in masks.items()}
        near = {k: {tuple(a - b for a, b in zip(p, d)) for p in m for d in kernel} for k, m in wide.items()}
        step = lambda p, d: tuple(a + b for a, b in zip(p, d))
        assert held(M.morph_close(px, ["k"], names, kernel)) == {k: {p for p in m if all(step(p, d) in wide[k] for d in kernel)} for k, m in near.items()}
        shape = dict(zip(names, (100, 90, 80)))
        inside = lambda p: all(0 <= a < shape[n] for a, n in zip(p, names))
        assert held(M.morph_close(px, ["k"], names, kernel, shape)) == {k: {p for p in m if inside(p) and any(inside(step(p, d)) for d in kernel) and all(step(p, d) in wide[k] or not inside(step(p, d)) for d in kernel)} for k, m in near.items()}
