"""Cleaning of masks: small holes and islands, and suppression of masks whose boxes have become alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.operators.boxes import lots_of, nms
from maskloom.operators.masks import components, rle_encode
from maskloom.sources.folders import written


def small_regions(px: DataFrame, keys: list[str], height: int, width: int, area: int) -> DataFrame:
    """keys, y, x and `changed` of each mask of foreground places (y, x) in a height x width image, after two steps.

    Background regions (joined by sides and corners) of fewer than `area` places are filled; then foreground regions of fewer are taken away, but where all are that small the largest stays,
    of equal ones the first. A region at the image's edge counts like any other. One image's mask is worked on whole; small ones share a call."""
    cells = [(y, x) for y in range(height) for x in range(width)]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(keys, kind="stable").reset_index(drop=True)
        number = g.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(g) else np.zeros(0, int)
        full = np.zeros((len(first), height, width), bool)
        full[number, g["y"], g["x"]] = True
        changed = np.zeros(len(first), bool)
        for value in (False, True):
            at = np.argwhere(full == value)
            if not len(at):
                continue
            root = components(at[:, 1:], at[:, 0])
            head, back, size = np.unique(root, return_inverse=True, return_counts=True)
            small, owner = size < area, at[head, 0]
            if value:  # the largest of each mask, the first of equal ones
                order = np.lexsort((head, -size, owner))
                best = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
                lonely = best[small[best]]
                changed[owner[small]] = True
                small[lonely] = False
            else:
                changed[owner[small]] = True
            gone = at[small[back]]
            full[tuple(gone.T)] = not value
        m, y, x = np.nonzero(full)
        out = g.iloc[first[m]][keys].reset_index(drop=True)
        return out.assign(y=y.astype(np.int32), x=x.astype(np.int32), changed=changed[m])

    rows = px.select(*keys, F.col("y").cast("int"), F.col("x").cast("int")).distinct()
    n = rows.count() + rows.select(*keys).distinct().count() * len(cells)
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("changed", T.BooleanType())])
    return lots_of(rows, keys, run, schema, rows=2_000_000, n=n)


def cleaned_masks(px: DataFrame, image: str, mask: str, height: int, width: int, area: int, most: float) -> DataFrame:
    """The masks of each image that stay once small regions are gone: image, mask, changed, box (x0, y0, x1, y1: its last places), and run lengths down the columns.

    Boxes are made anew; by greedy suppression masks that were not changed come first, then by `mask`, and one goes if its box overlaps that of a kept one by more than `most`."""
    keys = [image, mask]
    clean = written(small_regions(px, keys, height, width, area), "clean-masks")
    box = clean.groupBy(*keys).agg(F.first("changed").alias("changed"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    box = box.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0"), "score": (~F.col("changed")).cast("int")})
    kept = nms(box, [image], "score", mask, most).select(*keys, "changed", "x0", "y0", "x1", "y1")
    runs = rle_encode(clean, keys, F.col("x") * height + F.col("y"), height * width)
    return kept.join(runs, keys)
