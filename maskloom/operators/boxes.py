"""Box arithmetic, suppression of overlapping boxes, and grids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lots_of(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema, rows: int = 20_000, n: int | None = None) -> DataFrame:
    """`run` on lots of whole groups of `keys`, about `rows` rows in each; `n`: the rows of `df`, where known."""
    lots = max(1, (df.count() if n is None else n) // rows)
    return df.withColumn("__lot", F.pmod(F.xxhash64(*keys), F.lit(lots))).groupBy("__lot").applyInPandas(lambda lot: run(lot.drop(columns="__lot")), schema)


def in_lots(df: DataFrame, keys: list[str], one: Callable[[pd.DataFrame], pd.DataFrame], schema, rows: int = 20_000) -> DataFrame:
    """`one` for each group of `keys`, with about `rows` rows of whole groups in a call."""
    return lots_of(df, keys, lambda lot: pd.concat([one(g) for _, g in lot.groupby(keys, sort=False)]), schema, rows)


def uncropped(boxes: DataFrame, left: int, top: int, size: int, near: int) -> DataFrame:
    """Boxes (x0, y0, w, h) of a crop at (left, top) in the whole image, and whether they touch the crop's edge but not the image's."""
    x1, y1 = F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    edge = (F.col("x0") <= near) | (F.col("y0") <= near) | (x1 >= size - near) | (y1 >= size - near)
    outer = (F.col("x0") + left <= near) | (F.col("y0") + top <= near)
    return boxes.select("*", (F.col("x0") + left).alias("ux0"), (F.col("y0") + top).alias("uy0"), (x1 + left).alias("ux1"), (y1 + top).alias("uy1"), F.col("w").alias("width"), (edge & ~outer).alias("near_edge"))


def candidates(rows: DataFrame, predicted: str, stability: str, least_predicted: float, least_stability: float) -> DataFrame:
    """Masks whose predicted overlap is over its cut and whose stability reaches its own; a cut of 0 or less lets all through."""
    out = rows
    if least_predicted > 0:
        out = out.where(F.col(predicted) > least_predicted)
    return out.where(F.col(stability) >= least_stability) if least_stability > 0 else out


def nms(boxes: DataFrame, keys: list[str], score: str, tie: str, most: float) -> DataFrame:
    """Greedy suppression within each group: by falling score a box stays unless it overlaps a kept one by more than `most`.

    A group is an image's boxes. Small groups share a task's call, dealt by a hash of their keys."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        """All groups of a lot at once: in turn the first, second, ... box of each group strikes out those behind it."""
        g = g.sort_values([*keys, score, tie], ascending=[True] * len(keys) + [False, True], kind="stable").reset_index(drop=True)
        x0, y0 = g["x0"].to_numpy(float), g["y0"].to_numpy(float)
        x1, y1 = x0 + g["w"].to_numpy(float), y0 + g["h"].to_numpy(float)
        area, alive = (x1 - x0) * (y1 - y0), np.ones(len(g), bool)
        number = g.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        end = np.r_[start[1:], len(g)]
        for k in range(int((end - start).max(initial=0))):
            own = start + k < end
            start, end = start[own], end[own]
            first, last = start[alive[start + k]] + k, end[alive[start + k]]
            n = last - first - 1
            i, j = np.repeat(first, n), np.repeat(first + 1 - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.maximum(0, np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j])) * np.maximum(0, np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j]))
            alive[j[both > most * (area[i] + area[j] - both)]] = False
        return g[alive]

    return lots_of(boxes, keys, run, boxes.schema)


def point_grid(rows: DataFrame, n: str) -> DataFrame:
    """An n x n grid of points in the unit square for each row."""
    i = F.sequence(F.lit(0), F.col(n) - 1)
    x = rows.withColumn("__i", F.explode(i)).withColumn("__j", F.explode(i))
    return x.select("*", ((F.col("__i") + 0.5) / F.col(n)).cast("double").alias("gx"), ((F.col("__j") + 0.5) / F.col(n)).cast("double").alias("gy")).drop("__i", "__j")


def pad_square(rows: DataFrame) -> DataFrame:
    """Padding that centres a w x h image in a square."""
    side = F.greatest("w", "h")
    half = lambda c: F.floor((side - F.col(c)) / 2)
    return rows.select("*", side.alias("side"), half("w").alias("pad_left"), (side - F.col("w") - half("w")).alias("pad_right"), half("h").alias("pad_top"), (side - F.col("h") - half("h")).alias("pad_bottom"))
