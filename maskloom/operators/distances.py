"""Distances between masks by an exact separable distance transform on lines of voxels.

The squared distance to the nearest source is found along one axis after the other: along a line each source is a parabola over its place,
raised by the squared distance that earlier axes have left, and the lower envelope of these parabolas is the distance. A line is one case's voxels
that differ in one axis alone; a task needs one at once, or some side by side: they are dealt in lots by a hash of case and line."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.operators.masks import border
from maskloom.operators.quantiles import percentiles
from maskloom.sources.folders import written


def envelope(at: np.ndarray, height: np.ndarray, wanted: np.ndarray, step: float) -> np.ndarray:
    """At each wanted place the least of height + step * (place - at)^2. `at` rises."""
    if (height == height[0]).all():  # equal parabolas meet half way
        hull, cuts = np.arange(len(at)), (at[1:] + at[:-1]) / 2
    else:
        a, h = at.tolist(), (height + step * at.astype(float) ** 2).tolist()
        hull, cuts = [0], []
        for i in range(1, len(a)):
            while True:
                k = hull[-1]
                meet = (h[i] - h[k]) / (2 * step * (a[i] - a[k]))
                if not cuts or meet > cuts[-1]:
                    break
                hull.pop(), cuts.pop()
            hull.append(i), cuts.append(meet)
        hull, cuts = np.array(hull), np.array(cuts)
    best = hull[np.searchsorted(cuts, wanted)]
    return height[best] + step * (wanted - at[best]).astype(float) ** 2


def envelopes(at: np.ndarray, heights: np.ndarray, wanted: np.ndarray, step: float) -> np.ndarray:
    """`envelope` for lines side by side: a column of heights and of results for each. Of short lines all parabolas are held against each other."""
    if len(at) * len(wanted) <= 1 << 14:
        apart = step * (wanted[:, None] - at[None]).astype(float) ** 2
        return np.stack([(apart + heights[:, c]).min(1) for c in range(heights.shape[1])], 1)
    return np.stack([envelope(at, heights[:, c], wanted, step) for c in range(heights.shape[1])], 1)


def beside(line: np.ndarray, at: np.ndarray, asked: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How far each wanted place (a row for each line asked) is from the nearest source of its line: where all parabolas are equal the envelope is the nearest one. Lines and places rise."""
    low = min(int(at.min(initial=0)), int(wanted.min(initial=0)))
    span = max(int(at.max(initial=0)), int(wanted.max(initial=0))) - low + 1
    code, code_wanted = line * span + (at - low), asked[:, None] * span + (wanted - low)
    right = np.searchsorted(code, code_wanted)
    out = np.full(wanted.shape, np.iinfo(np.int64).max)
    for i in (right - 1, right):
        j = np.clip(i, 0, max(0, len(at) - 1))
        own = (i >= 0) & (i < len(at)) & (line[j] == asked[:, None])
        out = np.where(own, np.minimum(out, np.abs(at[j] - wanted)), out)
    return out


#: Neighbouring lines that travel together: places of the last axis in a row.
BLOCK = 64


def _groups_of(lot: pd.DataFrame, line: list[str], axis: str) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """A lot sorted by line and place, and where each line's rows are."""
    lot = lot.sort_values([*line, axis], kind="stable").reset_index(drop=True)
    number = lot.groupby(line, sort=False, dropna=False).ngroup().to_numpy()
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(lot) else np.zeros(0, int)
    return lot, list(zip(starts.tolist(), [*starts[1:].tolist(), len(lot)]))


def _in_lots(rows: DataFrame, line: list[str], n: int, run, schema, most: int) -> DataFrame:
    lot = F.pmod(F.xxhash64(*line), F.lit(max(1, n // most)))
    return rows.withColumn("__lot", lot).groupBy("__lot").applyInPandas(lambda g: run(g.drop(columns="__lot")), schema)


def nearest_squares(sources: DataFrame, targets: DataFrame, keys: list[str], axes: tuple[str, ...], spacing: tuple[float, ...]) -> DataFrame:
    """keys, axes and d2: for each target voxel the squared distance to the nearest source voxel of its group; none for a group without sources.

    Axes are done from the last to the first. Distances along the last axis are kept as rows of `BLOCK` places, so that neighbouring lines go on together; they are made only where the group's
    targets lie between their ends. Both tables are read more than once: give written ones."""
    inner, last = axes[1:], axes[-1]
    line_axes = axes[:-1] or axes
    fields = sources.select(*keys, *line_axes).schema.fields
    schema = T.StructType([*fields, T.StructField("__block", T.IntegerType()), T.StructField("d2", T.ArrayType(T.DoubleType()))])
    ends = inner and targets.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[f(a).alias(f"__{a}_{n}") for a in inner for f, n in ((F.min, "lo"), (F.max, "hi"))])

    def with_ends(rows: DataFrame, axis: str) -> DataFrame:
        same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(ends[f"__{k}"]) for k in keys])
        return rows.join(ends.select(*[f"__{k}" for k in keys], F.col(f"__{axis}_lo").alias("__lo"), F.col(f"__{axis}_hi").alias("__hi")), same).drop(*[f"__{k}" for k in keys])

    if not inner:
        rows = sources.select(*keys, *axes, F.lit(0).alias("__block"), F.array(F.lit(0.0)).alias("d2"))
        asked = targets.select(*keys, *axes, F.lit(0).alias("__block"), F.lit(0).alias("__col"))
    else:
        line, step = [*keys, *axes[:-1]], float(spacing[-1]) ** 2

        def across(g: pd.DataFrame) -> pd.DataFrame:
            g, lines = _groups_of(g, line, last)
            heads = np.array([i for i, _ in lines], np.int64)
            first, stop = g["__lo"].to_numpy()[heads] // BLOCK, g["__hi"].to_numpy()[heads] // BLOCK + 1
            n = stop - first
            number = np.repeat(np.arange(len(lines)), n)
            block = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n) + first[number]
            values = beside(np.repeat(np.arange(len(lines)), [j - i for i, j in lines]), g[last].to_numpy(), number, block[:, None] * BLOCK + np.arange(BLOCK)) ** 2 * step
            return g.iloc[heads[number]][line].reset_index(drop=True).assign(__block=block.astype(np.int32), d2=list(values.astype(float)))[[*line, "__block", "d2"]]

        rows = written(_in_lots(with_ends(sources.select(*keys, *axes), last), line, sources.count(), across, schema, 20_000), "line-distances")
        asked = targets.select(*keys, *axes, F.floor(F.col(last) / BLOCK).cast("int").alias("__block"), F.pmod(F.col(last), F.lit(BLOCK)).alias("__col"))
    for axis, size in reversed(list(zip(inner[:-1], spacing[1:-1]))):
        line, step = [*keys, *[a for a in line_axes if a != axis], "__block"], float(size) ** 2

        def along(g: pd.DataFrame, axis: str = axis, line: list[str] = line, step: float = step) -> pd.DataFrame:
            g, lines = _groups_of(g, line, axis)
            at, lo, hi = (g[c].to_numpy() for c in (axis, "__lo", "__hi"))
            heads, places, values = [], [], []
            for i, j in lines:
                wanted = np.arange(int(lo[i]), int(hi[i]) + 1)
                values += list(envelopes(at[i:j], np.stack(g["d2"].iloc[i:j].to_list()), wanted, step))
                heads += [i] * len(wanted)
                places.append(wanted)
            return g.iloc[heads][line].reset_index(drop=True).assign(**{axis: np.concatenate([*places, np.zeros(0, int)]), "d2": values})[[*keys, *line_axes, "__block", "d2"]]

        rows = written(_in_lots(with_ends(rows, axis), line, rows.count(), along, schema, 2_000), "line-distances")
    axis, line, step = axes[0], [*keys, *[a for a in line_axes if a != axes[0]], "__block"], float(spacing[0]) ** 2
    if not inner:
        line = [*keys, "__block"]
    out = T.StructType([*targets.select(*keys, *axes).schema.fields, T.StructField("d2", T.DoubleType())])

    def met(g: pd.DataFrame) -> pd.DataFrame:
        g, lines = _groups_of(g, line, axis)
        at, col, held = g[axis].to_numpy(), g["__col"].to_numpy(float), g["d2"].to_numpy()
        value = np.full(len(g), np.nan)
        for i, j in lines:
            own, others = np.flatnonzero(~np.isnan(col[i:j])) + i, np.flatnonzero(np.isnan(col[i:j])) + i
            if len(own) and len(others):
                wanted, back = np.unique(at[own], return_inverse=True)
                columns, place = np.unique(col[own].astype(int), return_inverse=True)
                value[own] = envelopes(at[others], np.stack(held[others].tolist())[:, columns], wanted, step)[back, place]
        found = ~np.isnan(value)
        g = g[found].assign(d2=value[found])
        if inner:
            g[last] = g["__block"] * BLOCK + g["__col"].astype(int)
        return g[[*keys, *axes, "d2"]]

    both = rows.withColumn("__col", F.lit(None).cast("int")).unionByName(asked.select(*keys, *line_axes, "__block", F.col("__col").cast("int")).withColumn("d2", F.lit(None).cast("array<double>")))
    return _in_lots(both, line, rows.count() + targets.count(), met, out, 20_000)


#: Pairs of border voxels up to which all pairs of a case are held against each other in one call.
PAIRS = 1 << 20


def _of_pairs(edges: DataFrame, key: str, axes: tuple[str, ...], spacing: tuple[float, ...], n: int) -> DataFrame:
    """key and hd95 of the cases with both borders, whose pairs fit a call; some cases share one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, cases = _groups_of(g, [key], "__side")
        at, side, heads, out = g[list(axes)].to_numpy(float), g["__side"].to_numpy(), [], []
        for i, j in cases:
            cut = i + int(np.searchsorted(side[i:j], 1))
            if i < cut < j:
                d2 = reduce(np.add, ((at[i:cut, c, None] - at[None, cut:j, c]) ** 2 * float(size) ** 2 for c, size in enumerate(spacing)))
                d = np.sort(np.sqrt(np.r_[d2.min(1), d2.min(0)]))
                place = (len(d) - 1) * 0.95
                low, high, part = d[int(np.floor(place))], d[int(np.ceil(place))], place - np.floor(place)
                heads.append(i), out.append(low if low == high else low * (1 - part) + high * part)
        return g.iloc[heads][[key]].assign(hd95=np.array(out, float))

    schema = T.StructType([*edges.select(key).schema.fields, T.StructField("hd95", T.DoubleType())])
    return _in_lots(edges, [key], n, run, schema, 20_000)


def hd95(a: DataFrame, b: DataFrame, key: str, axes: tuple[str, ...], spacing: tuple[float, ...] | None = None, cases: DataFrame | None = None, pairs: int = PAIRS) -> DataFrame:
    """95th percentile (linear between values) of the distances between the borders of two masks, both ways; `spacing` has a voxel's size along each axis.

    One row for each `key` of `cases`, or else of either mask: 0 where both masks are empty, null where one is. A null key is a case.
    Cases of at most `pairs` pairs of border voxels are done in a call; larger ones by the distance transform on lines."""
    spacing = spacing or (1.0,) * len(axes)
    sides = [m.select(key, *axes).withColumn("__side", F.lit(i)) for i, m in enumerate((a, b))]
    edges = written(border(sides[0].unionByName(sides[1]), [key, "__side"], axes).select(key, "__side", *axes), "borders")
    count = lambda side: F.count_if(F.col("__side") == side)
    sizes = edges.groupBy(F.col(key).alias("__case")).agg(F.count("*").alias("__n"), F.countDistinct("__side").alias("__sides"), (count(0) * count(1)).alias("__pairs"))
    n, most = sizes.agg(F.sum("__n"), F.max("__pairs")).first()
    same = edges[key].eqNullSafe(F.col("__case"))
    small = edges if (most or 0) <= pairs else edges.join(sizes.where(F.col("__pairs") <= pairs), same, "left_semi")
    q = _of_pairs(small, key, axes, spacing, n or 0)
    if (most or 0) > pairs:
        large = written(edges.join(sizes.where(F.col("__pairs") > pairs), same, "left_semi"), "large-borders")
        found = nearest_squares(large, large.withColumn("__side", 1 - F.col("__side")), [key, "__side"], axes, spacing)
        q = q.unionByName(percentiles(written(found.select(key, F.sqrt("d2").alias("d")), "border-distances"), [key], "d", {"hd95": 0.95}))
    told = sizes.join(q, sizes["__case"].eqNullSafe(q[key]), "left").select("__case", "__sides", "hd95")
    every = (edges if cases is None else cases).select(key).distinct()
    out = every.join(told, every[key].eqNullSafe(told["__case"]), "left")
    return out.select(key, F.when(F.col("__sides").isNull(), 0.0).otherwise(F.col("hd95")).alias("hd95"))
