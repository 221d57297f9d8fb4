"""Operators on masks kept as tables of voxels (case_id, z, y, x, label), and quality rules on their components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions.arrays import running_sum
from maskloom.functions.keys import unit
from maskloom.operators.boxes import lots_of
from maskloom.operators.profiles import ranked
from maskloom.sources.folders import written

AXES = ("z", "y", "x")


def neighbours(points: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of points (rows of integers) of one group that touch by side, edge or corner. One sorted search per direction."""
    n, d = points.shape
    low = points.min(0) - 1
    size = points.max(0) - low + 2
    scale = np.cumprod(np.r_[1, size[::-1]])[::-1]
    code = ((points - low) * scale[1:]).sum(1) + group * scale[0]
    order = np.argsort(code, kind="stable")
    code, a, b = code[order], [], []
    for move in np.ndindex(*[3] * d):
        step = int(((np.array(move) - 1) * scale[1:]).sum())
        if step > 0:
            at = np.searchsorted(code, code + step)
            at[at == n] = 0
            hit = np.flatnonzero(code[at] == code + step)
            a.append(order[hit]), b.append(order[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def components(points: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """For each point the smallest index of its component: labels sink along pairs and are shortened until they rest."""
    label = np.arange(len(points))
    a, b = neighbours(points, np.zeros(len(points), np.int64) if group is None else group)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            return label


def connected_components(voxels: DataFrame, keys: list[str], axes: tuple[str, ...] = AXES, whole: int = 1_000_000, tile: int = 128) -> DataFrame:
    """Component numbers from 1 within each group of `keys`, by falling size, then by the first voxel in `axes` order.

    Masks of at most `whole` voxels are each done in one task, small ones together in a call. Larger ones are cut into tiles of `tile` places along each axis: components within
    tiles first, then the links over tile borders, contracted by joins (`tiled_components`); the numbers are the same."""
    rows = voxels.select(*keys, *axes)
    sizes = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("__n"))
    n, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    schema = rows.schema.add("component", T.IntegerType())
    if (most or 0) <= whole:
        return lots_of(rows, keys, lambda g: _numbered(g, keys, axes), schema, n=n or 0)
    same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(sizes[f"__{k}"]) for k in keys])
    small = rows.join(sizes.where(F.col("__n") <= whole), same, "left_semi")
    large = rows.join(sizes.where(F.col("__n") > whole), same, "left_semi")
    return lots_of(small, keys, lambda g: _numbered(g, keys, axes), schema, n=n).unionByName(tiled_components(large, keys, axes, tile, whole))


def _rooted(g: pd.DataFrame, keys: list[str], axes: tuple[str, ...]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in order of keys and place, the number of each row's group, and the first row of its component."""
    g = g.sort_values([*keys, *axes], kind="stable").reset_index(drop=True)
    group = g.groupby(keys, sort=False, dropna=False).ngroup().to_numpy(np.int64)
    return g, group, components(g[list(axes)].to_numpy(np.int64), group)


def _numbered(g: pd.DataFrame, keys: list[str], axes: tuple[str, ...]) -> pd.DataFrame:
    g, group, root = _rooted(g, keys, axes)
    first, back, size = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((first, -size, group[first]))
    owner, rank = group[first][order], np.empty(len(first), np.int64)
    rank[order] = np.arange(1, len(first) + 1) - np.searchsorted(owner, owner)
    return g.assign(component=rank[back].astype(np.int32))


def tiled_components(voxels: DataFrame, keys: list[str], axes: tuple[str, ...] = AXES, tile: int = 128, whole: int = 1_000_000) -> DataFrame:
    """As `connected_components`, for masks of any size: no task holds more than some tiles.

    A component of a tile is named by its first voxel. Voxels on tile faces meet those that touch them in other tiles; the links between names
    are contracted to each name's smallest (`contracted`). Sizes add up by name, and the numbers of a mask's components come from ranks that spread over tasks."""
    tiles = [f"__t{i}" for i in range(len(axes))]
    rows = voxels.select(*keys, *axes).withColumns({t: F.floor(F.col(a) / tile).cast("int") for t, a in zip(tiles, axes)})
    firsts = [f"__r{i}" for i in range(len(axes))]

    def local(g: pd.DataFrame) -> pd.DataFrame:
        g, _, root = _rooted(g, [*keys, *tiles], axes)
        return g.assign(**{r: g[a].to_numpy()[root] for r, a in zip(firsts, axes)})[[*keys, *axes, *firsts]]

    base = voxels.select(*keys, *axes).schema
    found = lots_of(rows, [*keys, *tiles], local, T.StructType([*base.fields, *[T.StructField(r, base[a].dataType) for r, a in zip(firsts, axes)]]), rows=200_000)
    name = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(r).alias(f"r{i}") for i, r in enumerate(firsts)])
    found = written(found.select(*keys, *axes, name.alias("__name")), "tile-components")

    onface = reduce(lambda x, y: x | y, [F.pmod(F.col(a), F.lit(tile)).isin(0, tile - 1) for a in axes])
    face = found.where(onface)
    half = [m for m in np.ndindex(*[3] * len(axes)) if m > (1,) * len(axes)]  # each pair of touching places once
    step = F.explode(F.array(*[F.struct(*[F.lit(int(d) - 1).alias(f"d{i}") for i, d in enumerate(m)]) for m in half]))
    moved = face.withColumn("__d", step).select("__name", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(a).alias(f"__from{i}") for i, a in enumerate(axes)], *[(F.col(a) + F.col(f"__d.d{i}")).alias(f"__to{i}") for i, a in enumerate(axes)])
    across = reduce(lambda x, y: x | y, [F.floor(F.col(f"__from{i}") / tile) != F.floor(F.col(f"__to{i}") / tile) for i in range(len(axes))])
    met = face.select(F.col("__name").alias("__other"), *keys, *axes)
    touch = [F.col(f"__k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)] + [F.col(f"__to{i}") == F.col(a) for i, a in enumerate(axes)]
    links = moved.where(across).join(met, reduce(lambda x, y: x & y, touch)).select(F.col("__name").alias("a"), F.col("__other").alias("b")).distinct()
    roots = contracted(links)

    sizes = found.groupBy("__name").agg(F.count("*").alias("__n")).join(roots, F.col("__name") == F.col("node"), "left").select("__name", F.coalesce("root", "__name").alias("__root"), "__n")
    whole_sizes = sizes.groupBy("__root").agg(F.sum("__n").alias("__n")).select("__root", (-F.col("__n")).alias("__less"), *[F.col(f"__root.k{i}").alias(f"__k{i}") for i in range(len(keys))])
    numbers = ranked(whole_sizes, [f"__k{i}" for i in range(len(keys))], ["__less", "__root"]).select(F.col("__root").alias("__of"), F.col("position").cast("int").alias("component"))
    number = sizes.join(numbers, F.col("__root") == F.col("__of")).select(F.col("__name").alias("__own"), "component")
    return found.join(number, F.col("__name") == F.col("__own")).select(*keys, *axes, "component")


def contracted(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): the smallest node that it is joined to.

    Stars in turn: each node's larger neighbours are hung under its smallest one, then its smaller ones, until nothing changes. Every turn is a minimum by node, reduced before the
    shuffle, and a join; the turns grow with the logarithm of the longest chain."""
    edges = written(links.where("a <> b").distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "links")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        hung = down.join(lowest, F.col("a") == F.col("u")).select("b", "m").unionByName(lowest.select(F.col("u").alias("b"), "m"))
        edges = written(hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars


def component_sizes(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "component").agg(F.count("*").alias("voxels"))


def slice_areas(parts: DataFrame, keys: list[str], axis: str) -> DataFrame:
    return parts.groupBy(*keys, F.col(axis).alias("slice")).agg(F.count("*").alias("area"))


def hi_axis(shape: list[Column]) -> Column:
    """Axis with the largest plane across it (0, 1, 2); the first of equal ones."""
    d, h, w = shape
    planes = F.array(h * w, d * w, d * h)
    return (F.array_position(planes, F.array_max(planes)) - 1).cast("int")


def mask_stats(voxels: DataFrame, ds: int) -> DataFrame:
    """On the grid of every `ds`-th voxel: estimated voxels, slices with foreground per axis, and the largest slice area."""
    v = voxels.where(" and ".join(f"{a} % {ds} = 0" for a in AXES))
    whole = v.groupBy("case_id").agg((F.count("*") * ds**3).alias("voxels_est"))
    for i, a in enumerate(AXES):
        s = v.groupBy("case_id", a).agg(F.count("*").alias("n")).groupBy("case_id").agg(F.count("*").alias(f"slices_{i}"), F.max("n").alias(f"m{i}"))
        whole = whole.join(s, "case_id")
    return whole.select("case_id", "voxels_est", "slices_0", "slices_1", "slices_2", (F.greatest("m0", "m1", "m2") * ds * ds).alias("max_area"))


def area_limit(pixels: int, share: float, area: int, ds: int) -> int:
    """Least slice area on a grid of every `ds`-th voxel."""
    from math import ceil

    return max(1, ceil(max(pixels, ceil(share * area)) / ds**2))


def longest_run(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run of consecutive slice numbers in each group; a missing slice breaks it."""
    w = Window.partitionBy(*keys).orderBy("slice")
    runs = slices.withColumn("run", F.col("slice") - F.row_number().over(w)).groupBy(*keys, "run").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"))


def component_quality_3d(parts: DataFrame, keys: list[str], axis: str, min_voxels: int, min_area: int, min_slices: int, contiguous: bool) -> DataFrame:
    """First failing rule of each component, null if it is kept: voxels, slice area, slices, contiguous slices."""
    k = [*keys, "component"]
    slices = slice_areas(parts, k, axis)
    big = slices.where(F.col("area") >= min_area)
    told = slices.groupBy(*k).agg(F.sum("area").alias("voxels"), F.count_if(F.col("area") >= min_area).alias("qualified"))
    out = told.join(longest_run(big, k), k, "left")
    enough = F.coalesce("longest", F.lit(0)) >= min_slices if contiguous else F.lit(True)
    return out.select(
        *k, "voxels",
        F.when(F.col("voxels") < min_voxels, "component_below_minimum_voxels_3d").when(F.lit(min_area > 0) & (F.col("qualified") == 0), "component_below_minimum_slice_area_3d")
        .when(F.col("qualified") < min_slices, "component_below_minimum_slices_3d").when(~enough, "component_below_minimum_contiguous_slices_3d").alias("reason"),
    )


def contiguous_window(slices: DataFrame, keys: list[str], n: int, min_area: int) -> DataFrame:
    """Whether some `n` consecutive slices all reach the area: on the full slice axis, missing slices count as empty."""
    span = slices.groupBy(*keys).agg(F.min("slice").alias("a"), F.max("slice").alias("b"))
    axis = span.select(*keys, F.explode(F.sequence("a", "b")).alias("slice"))
    good = axis.join(slices, [*keys, "slice"], "left").withColumn("good", (F.coalesce("area", F.lit(0)) >= min_area).cast("int"))
    w = Window.partitionBy(*keys).orderBy("slice").rowsBetween(-(n - 1), 0)
    return good.withColumn("run", F.sum("good").over(w)).groupBy(*keys).agg((F.max("run") == n).alias("has_window"))


def window_select(slices: DataFrame, keys: list[str], n: int, length: int, plane: int, policy: str = "peak", min_foreground: int = 1, share: float = 0.0002, temperature: float = 0.25, seed: int = 0) -> DataFrame:
    """The start (from 0) of one window of `n` slices of an axis of `length` slices, for each group of `slices` (slice, area) with foreground.

    A slice has foreground from max(2, share * plane) pixels on; where no slice of the group has so many, from one on. Windows lie on the
    axis whole. Those with foreground on every slice are preferred; else those with at least `min_foreground` such slices, or as many as there are.
    Of these the policy chooses:

    - `peak`: nearest to the window centred on the largest slice, then the larger area, then the earlier;
    - `area`: the largest area, then the earliest;
    - `weighted`: by chance, likelier with area (softmax of the share of the largest area over `temperature`), by a hash of seed, key and start;
    - `uniform`: by such a hash alone.

    An axis shorter than `n` is an error. An axis has few slices, so a group's rows are few."""
    if length < n:
        raise ValueError(f"axis too short: need {n}, have {length}")
    axis = slices.where("area > 0").select(*keys).distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).join(slices, [*keys, "slice"], "left")
    group = Window.partitionBy(*keys)
    ahead = group.orderBy("slice").rowsBetween(0, n - 1)
    area, real = F.coalesce("area", F.lit(0)), max(2, int(share * plane))
    x = axis.select(*keys, "slice", area.alias("area")).withColumns({"big": (F.col("area") >= real).cast("int"), "peak": F.max(F.struct("area", (-F.col("slice")).alias("m"))).over(group)})
    x = x.withColumn("counts", F.when(F.max("big").over(group) == 1, F.col("big")).otherwise((F.col("area") > 0).cast("int")))
    x = x.withColumns({"full": F.sum("counts").over(ahead), "window_area": F.sum("area").over(ahead)}).where(F.col("slice") <= length - n)
    x = x.withColumn("needed", F.greatest(F.lit(1), F.when(F.max("full").over(group) == n, n).otherwise(F.least(F.lit(min_foreground), F.max("full").over(group)))))
    valid = x.where("full >= needed")
    centre = F.greatest(F.lit(0), F.least(F.lit(length - n), -F.col("peak.m") - n // 2))
    u = F.greatest(unit(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("slice").cast("string")), seed), F.lit(1e-12))
    if policy == "weighted":
        valid = valid.withColumn("most", F.max("window_area").over(group))
    first = {
        "peak": lambda: [F.abs(F.col("slice") - centre), -F.col("window_area")], "area": lambda: [-F.col("window_area")], "uniform": lambda: [u],
        "weighted": lambda: [F.round(F.ln(-F.ln(u)) - F.col("window_area") / F.col("most") / temperature, 9)],
    }[policy]()
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(first)], F.col("slice").alias("start"), F.col("full"), F.col("window_area"))
    return valid.groupBy(*keys).agg(F.min(order).alias("x")).select(*keys, F.col("x.start").alias("start"), F.col("x.full").alias("foreground_slices"), F.col("x.window_area").alias("area"))


def bbox(voxels: DataFrame, keys: list[str], shape: dict[str, int], images: DataFrame | None = None) -> DataFrame:
    """Half-open box of the foreground and whether cropping to it removes a quarter or more of the volume.

    With `images` (one row for each `keys`), those without foreground have the full extent; else they have no row."""
    b = voxels.groupBy(*keys).agg(*[f(a).alias(f"{a}{i}") for a in shape for i, f in ((0, F.min), (1, F.max))])
    b = b.select(*keys, *[x for a in shape for x in (F.col(f"{a}0"), (F.col(f"{a}1") + 1).alias(f"{a}1"))])
    if images is not None:
        b = images.select(*keys).join(b, keys, "left").select(*keys, *[x for a, n in shape.items() for x in (F.coalesce(f"{a}0", F.lit(0)).alias(f"{a}0"), F.coalesce(f"{a}1", F.lit(n)).alias(f"{a}1"))])
    inside, all_ = F.lit(1), 1
    for a, n in shape.items():
        inside, all_ = inside * (F.col(f"{a}1") - F.col(f"{a}0")), all_ * n
    return b.withColumn("is_significant_crop", inside <= 0.75 * all_)


def padded(box: DataFrame, shape: dict[str, int], pad: int) -> DataFrame:
    for a, n in shape.items():
        box = box.withColumn(f"{a}0", F.greatest(F.lit(0), F.col(f"{a}0") - pad)).withColumn(f"{a}1", F.least(F.lit(n), F.col(f"{a}1") + pad))
    return box


def crop(voxels: DataFrame, lo: dict[str, int], hi: dict[str, int]) -> DataFrame:
    for a in lo:
        voxels = voxels.where((F.col(a) >= lo[a]) & (F.col(a) < hi[a]))
    return voxels.withColumns({a: F.col(a) - lo[a] for a in lo})


def reorient(voxels: DataFrame, shape: dict[str, int]) -> DataFrame:
    """y and x changed for each other, then the new y flipped."""
    return voxels.select("case_id", "z", (F.lit(shape["x"] - 1) - F.col("x")).alias("y"), F.col("y").alias("x"), "label")


def resize_nearest(voxels: DataFrame, axes: dict[str, tuple[int, int]]) -> DataFrame:
    """Nearest neighbour to a target grid: each target place takes the voxel at floor(place * source / target)."""
    out = voxels
    for a, (source, target) in axes.items():
        grid = voxels.sparkSession.range(target).select(F.floor(F.col("id") * source / target).cast("int").alias(a), F.col("id").cast("int").alias("__to"))
        out = out.join(F.broadcast(grid), a).drop(a).withColumnRenamed("__to", a)
    return out


def mask_algebra(voxels: DataFrame, outer: int, inner: int) -> DataFrame:
    """Places of one label that another label does not have, looking along z."""
    have = voxels.where(F.col("label") == inner).select("case_id", "y", "x").distinct()
    return voxels.where(F.col("label") == outer).select("case_id", "y", "x").distinct().join(have, ["case_id", "y", "x"], "left_anti")


def filter_small_2d(parts: DataFrame, keys: list[str], least: int, weight: str | None = None) -> DataFrame:
    """Components whose area, or sum of `weight`, reaches `least`."""
    size = F.sum(weight) if weight else F.count("*")
    return parts.groupBy(*keys, "component").agg(size.cast("long").alias("size")).where(F.col("size") >= least)


def border(voxels: DataFrame, keys: list[str], axes: tuple[str, ...]) -> DataFrame:
    """Voxels with a side neighbour that is not foreground, each once."""
    sides = cross(len(axes))[1:]
    return on_tiles(voxels, keys, axes, 1, lambda bits, inside: bits & ~_shrunk(bits, sides))


def cross(axes: int = 2) -> list[tuple[int, ...]]:
    """A place and its side neighbours."""
    return [(0,) * axes] + [tuple(d if i == j else 0 for j in range(axes)) for i in range(axes) for d in (-1, 1)]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Steps (y, x) of an elliptic kernel of `size` x `size` places round its middle (size // 2): in row y as far as the ellipse's width there, rounded half to even."""
    r = size // 2
    width = lambda y: round(r * ((r * r - y * y) / (r * r)) ** 0.5) if r else 0
    return [(y, x) for y in range(-r, size - r) if abs(y) <= r for x in range(-width(y), min(width(y), size - 1 - r) + 1)]


def _met(voxels: DataFrame, keys: list[str], axes: tuple[str, ...], kernel: list[tuple[int, ...]], sign: int) -> DataFrame:
    """For each place the number of voxels whose kernel reaches it."""
    steps = F.array(*[F.struct(*[(F.col(a) + sign * int(d)).alias(a) for a, d in zip(axes, move)]) for move in kernel])
    return voxels.select(*keys, F.explode(steps).alias("g")).select(*keys, *[F.col(f"g.{a}").alias(a) for a in axes]).groupBy(*keys, *axes).agg(F.count("*").alias("__n"))


def dilate(voxels: DataFrame, keys: list[str], axes: tuple[str, ...], kernel: list[tuple[int, ...]] | None = None) -> DataFrame:
    """All places that the kernel (default: the side neighbours) reaches from the foreground."""
    return _met(voxels, keys, axes, kernel or cross(len(axes)), 1).drop("__n")


def erode(voxels: DataFrame, keys: list[str], axes: tuple[str, ...], kernel: list[tuple[int, ...]] | None = None) -> DataFrame:
    """Places from which the whole kernel lies on distinct foreground voxels."""
    kernel = kernel or cross(len(axes))
    return _met(voxels, keys, axes, kernel, -1).where(F.col("__n") == len(kernel)).drop("__n")


def morph_close(voxels: DataFrame, keys: list[str], axes: tuple[str, ...], kernel: list[tuple[int, ...]] | None = None, shape: dict[str, int] | None = None) -> DataFrame:
    """Dilation, then erosion. Without `shape` the grid has no end; with it (axis: places) what lies outside the image is not asked, neither by the dilation nor by the erosion.

    Kernels that reach up to 10 places are laid on tiles of bits; for wider ones each place is reached by rows."""
    kernel = kernel or cross(len(axes))
    reach = 2 * max(abs(int(d)) for move in kernel for d in move)
    if reach <= 20:

        def closed(bits: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
            wide = _grown(bits, kernel)
            if inside is None:
                return _shrunk(wide, kernel)
            wide &= inside
            return _shrunk(wide | ~inside, kernel) & _grown(wide, [tuple(-d for d in move) for move in kernel]) & inside  # some place of the kernel lies in the image

        return on_tiles(voxels, keys, axes, reach, closed, shape)
    wide = dilate(voxels, keys, axes, kernel)
    if not shape:
        return erode(wide, keys, axes, kernel)
    inside = lambda move: reduce(lambda x, y: x & y, [(F.col(a) + int(d)).between(0, shape[a] - 1) for a, d in zip(axes, move)])
    needed = reduce(lambda x, y: x + y, [inside(move).cast("int") for move in kernel])
    met = _met(wide.where(inside((0,) * len(axes))), keys, axes, kernel, -1)
    return met.where(inside((0,) * len(axes)) & (F.col("__n") == needed)).drop("__n")


#: Bits of a word, and lines of a tile along each axis but the last, by their number.
WORD, LINES = 64, {0: (), 1: (64,), 2: (16, 16)}


def _moved(bits: np.ndarray, move: tuple[int, ...]) -> np.ndarray:
    """At each place of tiles (tile, lines...) the bit `move` further on; zero beyond the tile."""
    out, d = np.zeros_like(bits), int(move[-1])
    at = [slice(max(0, -int(m)), max(0, n - max(0, int(m)))) for m, n in zip(move[:-1], bits.shape[1:])]
    there = [slice(max(0, int(m)), max(0, n + min(0, int(m)))) for m, n in zip(move[:-1], bits.shape[1:])]
    word = bits[(slice(None), *there)]
    out[(slice(None), *at)] = word >> np.uint64(d) if d >= 0 else word << np.uint64(-d)
    return out


def _grown(bits: np.ndarray, kernel: list[tuple[int, ...]]) -> np.ndarray:
    return reduce(np.bitwise_or, (_moved(bits, tuple(-int(d) for d in move)) for move in kernel))


def _shrunk(bits: np.ndarray, kernel: list[tuple[int, ...]]) -> np.ndarray:
    return reduce(np.bitwise_and, (_moved(bits, move) for move in kernel))


def on_tiles(voxels: DataFrame, keys: list[str], axes: tuple[str, ...], reach: int, run, shape: dict[str, int] | None = None) -> DataFrame:
    """keys and axes of the places that `run` leaves, each once. What `run` says of a place may depend on places up to `reach` (at most 20) away along each axis.

    The voxels of a group become words of bits along the last axis, and these tiles of lines, with a margin of `reach` places on all sides; so a voxel is
    shuffled once and a mask of any size spreads over tasks. `run(bits, inside)` has some tiles at once (tile, lines...) and gives bits of the same form; `inside` has the bits that lie in an image of `shape` (None without one)."""
    *outer, last = axes
    lines, inner = LINES.get(len(outer)) or (8,) * len(outer), WORD - 2 * reach
    lines = tuple(max(n, reach) for n in lines)
    whole = tuple(n + 2 * reach for n in lines)
    types = [voxels.schema[a].dataType for a in axes]
    tiles = [f"__t{i}" for i in range(len(axes))]
    x = voxels.select(*keys, *[F.col(a).cast("long").alias(f"__a{i}") for i, a in enumerate(axes)]).dropna(subset=[f"__a{i}" for i in range(len(axes))])
    own = [f"__a{i}" for i in range(len(outer))]
    at = F.pmod(f"__a{len(outer)}", F.lit(inner))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    words = x.groupBy(*keys, *own, F.expr(f"(__a{len(outer)} - pmod(__a{len(outer)}, {inner})) div {inner}").alias("__t")).agg(F.bit_or(bit).alias("__w"))
    # A word lies in its own tile, and what is near its ends in the next ones' margins.
    shift = lambda f, n: F.call_function(f, "__w", F.lit(n))
    near = F.array(*[F.struct((F.col("__t") + d).alias("t"), w.alias("w")) for d, w in ((-1, shift("shiftleft", inner + reach) if inner + reach < WORD else F.lit(0).cast("long")), (0, shift("shiftleft", reach)), (1, shift("shiftrightunsigned", inner - reach)))])
    words = words.select(*keys, *own, F.explode(near).alias("n")).where("n.w <> 0").select(*keys, *own, F.col("n.t").alias(tiles[-1]), F.col("n.w").alias("__w"))
    line = F.lit(0).cast("long")
    for i, (n, size) in enumerate(zip(lines, whole)):
        a = F.expr(f"(__a{i} - pmod(__a{i}, {n})) div {n}")
        words = words.withColumn("__n", F.explode(F.array(*[F.struct((a + d).alias("t"), (F.col(f"__a{i}") - (a + d) * n + reach).alias("p")) for d in (-1, 0, 1)]))).where(F.col("__n.p").between(0, size - 1))
        words = words.withColumns({tiles[i]: F.col("__n.t"), f"__p{i}": F.col("__n.p")}).drop("__n")
        line = line * size + F.col(f"__p{i}")
    if shape:
        for t, a, n in zip(tiles, axes, (*lines, inner)):
            words = words.where((F.col(t) * n < shape[a]) & ((F.col(t) + 1) * n > 0))
    held = words.groupBy(*keys, *tiles).agg(F.collect_list(F.struct(line.cast("int").alias("l"), F.col("__w").alias("w"))).alias("__x"))
    held = held.select(*keys, *tiles, F.col("__x.l").alias("__l"), F.col("__x.w").alias("__w"))

    def left(batches):
        for big in batches:
            for start in range(0, big.num_rows, 1_000):
                b = big.slice(start, 1_000)
                bits = np.zeros((b.num_rows, int(np.prod(whole, dtype=int))), np.uint64)
                tile = np.repeat(np.arange(b.num_rows), b["__l"].value_lengths().to_numpy())
                at = tile * bits.shape[1] + b["__l"].flatten().to_numpy()
                np.bitwise_or.at(bits.reshape(-1), at, b["__w"].flatten().to_numpy().view(np.uint64))  # a line has its own word and its neighbours' margins
                inside = None
                if shape:
                    first = [b[t].to_numpy() * n - reach for t, n in zip(tiles, (*lines, inner))]
                    has = lambda i, n: (first[i][:, None] + np.arange(n) >= 0) & (first[i][:, None] + np.arange(n) < shape[axes[i]])  # noqa: E731, B023
                    inside = (has(len(outer), WORD).astype(np.uint64) << np.arange(WORD, dtype=np.uint64)).sum(1, dtype=np.uint64).reshape(-1, *[1] * len(outer))
                    for i, n in enumerate(whole):
                        inside = np.where(has(i, n).reshape(-1, *[n if i == j else 1 for j in range(len(outer))]), inside, np.uint64(0))
                found = run(bits.reshape(-1, *whole), inside)
                found = found[(slice(None), *[slice(reach, n + reach) for n in lines])].reshape(b.num_rows, -1)
                t, at = np.nonzero(found)
                each = np.unpackbits((np.ascontiguousarray(found[t, at]) >> np.uint64(reach)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :inner]
                k, bit = np.nonzero(each)
                places = pa.array((at[k] * inner + bit).astype(np.int32))
                ends = np.searchsorted(t[k], np.arange(b.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[b[c] for c in (*keys, *tiles)], pa.ListArray.from_arrays(pa.array(ends), places)], names=[*keys, *tiles, "__p"])

    out = T.StructType([*held.select(*keys, *tiles).schema.fields, T.StructField("__p", T.ArrayType(T.IntegerType()))])
    rest = F.col("__p")
    place = []
    for t, n in reversed(list(zip(tiles, (*lines, inner)))):
        place.append(F.col(t) * n + F.pmod(rest, F.lit(n)))
        rest = F.floor(rest / n)
    return held.mapInArrow(left, out).select(*keys, *tiles, F.explode("__p").alias("__p")).select(*keys, *[p.cast(kind).alias(a) for p, kind, a in zip(reversed(place), types, axes)])


def rle_encode(voxels: DataFrame, keys: list[str], place: Column, size: int) -> DataFrame:
    """Run lengths along `place` (0 to size - 1), background first: a run for each change and the rest."""
    w = Window.partitionBy(*keys).orderBy("p")  # sorted once: a row's neighbours tell where runs begin and end
    x = voxels.select(*keys, place.alias("p")).distinct().withColumns({"back": F.lag("p").over(w), "ahead": F.lead("p").over(w)})
    ends = x.withColumns({"first": F.expr("back IS NULL OR back < p - 1"), "last": F.expr("ahead IS NULL OR ahead > p + 1")})
    runs = ends.where("first OR last").withColumn("stop", F.when(F.col("last"), F.col("p")).otherwise(F.lead("p").over(w))).where("first")
    pairs = runs.select(*keys, F.col("p").alias("a"), (F.col("p") - F.coalesce(F.col("back") + 1, F.lit(0))).alias("gap"), (F.col("stop") - F.col("p") + 1).alias("n"))
    lists = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "gap", "n"))).alias("x"))
    flat = F.flatten(F.transform("x", lambda e: F.array(e["gap"].cast("long"), e["n"].cast("long"))))
    total = F.aggregate(flat, F.lit(0).cast("long"), lambda s, e: s + e)
    return lists.select(*keys, F.when(total < size, F.concat(flat, F.array(F.lit(size).cast("long") - total))).otherwise(flat).alias("counts"))


def rle_decode(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """Places of the foreground runs; runs end where their running sums are."""
    ends = running_sum(F.transform("counts", lambda x: x.cast("long")))
    x = encoded.select(*keys, F.posexplode(F.arrays_zip(F.col("counts").alias("n"), ends.alias("end"))).alias("i", "r")).where("i % 2 = 1 and r.n > 0")
    return x.select(*keys, F.explode(F.sequence(F.col("r.end") - F.col("r.n"), F.col("r.end") - 1)).alias("p"))


def rle_area(counts: str) -> Column:
    return F.aggregate(F.transform(counts, lambda x, i: F.when(i % 2 == 1, x).otherwise(0)), F.lit(0).cast("long"), lambda s, e: s + e)
