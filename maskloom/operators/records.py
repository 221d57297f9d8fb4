"""Operators on records of the preprocessing stage: slice order, class rules, names, cleaning of masks, reports."""

from __future__ import annotations

from functools import reduce

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from maskloom.operators.boxes import in_lots
from maskloom.operators.masks import components


def slice_order(slices: DataFrame, group: str) -> DataFrame:
    """Slices by the position along the normal of their orientation (six direction numbers); a group without full geometry goes by instance number."""
    o = [F.col("orientation")[i] for i in range(6)]
    normal = (o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3])
    along = sum((n * F.col("position")[i] for i, n in enumerate(normal)), F.lit(0.0))
    whole = F.min((F.col("orientation").isNotNull() & F.col("position").isNotNull()).cast("int")).over(Window.partitionBy(group))
    x = slices.withColumn("__along", F.when(whole == 1, F.round(along, 9)))
    return x.withColumn("slice_number", F.row_number().over(Window.partitionBy(group).orderBy("__along", "instance_number"))).drop("__along")


def class_match(masks: DataFrame, rules: DataFrame, wildcard_last: bool = False) -> DataFrame:
    """Class of each mask by its subdataset's rules, else those of `default`: text in the name (longer first; `*` fits all), then numeric range `a-b`, then the exact label.

    `*` stands among the texts, so it ends the search before ranges and labels, unless `wildcard_last`. The rules are a small table."""
    own = rules.select(F.col("subdataset").alias("rule_set")).distinct()
    m = masks.join(own, masks["subdataset"] == own["rule_set"], "left").withColumn("rule_set", F.coalesce("rule_set", F.lit("default")))
    low, high = (F.expr(f"try_cast(nullif(regexp_extract(rule, '^(-?[0-9]+) *- *(-?[0-9]+)$', {i}), '') as double)") for i in (1, 2))
    number = F.expr("try_cast(label as double)")
    star = F.col("rule") == "*"
    priority = (
        F.when(star, F.lit(9 if wildcard_last else 1)).when(F.contains(F.lower("name"), F.lower("rule")), 0)
        .when((number >= low) & (number <= high), 2)
        .when(F.col("label") == F.col("rule"), 3)
    )
    r = rules.withColumnRenamed("subdataset", "rule_set")
    hits = m.join(r, "rule_set").withColumn("p", priority).where("p is not null")
    best = hits.groupBy("mask_id").agg(F.min(F.struct("p", (-F.length("rule")).alias("l"), "rule", "class")).alias("b"))
    return masks.join(best, "mask_id", "left").select("mask_id", F.col("b.class").alias("class"))


@udtf(returnType="subdataset string, side string, pattern string")
class GroupingRules:
    """Rows of a grouping text `[name]{images: p; masks: p}` (or one set without a name); braces inside patterns are matched in pairs."""

    def eval(self, text: str) -> Iterator[tuple[str, str, str]]:
        text, sets, at = (text or "").strip(), [], 0
        while (m := re.compile(r"\s*\[([^\]]*)\]\s*\{").match(text, at)) is not None:
            depth, i = 1, m.end()
            while i < len(text) and depth:
                depth += (text[i] == "{" and text[i - 1] != "\\") - (text[i] == "}" and text[i - 1] != "\\")
                i += 1
            sets.append((m[1].strip(), text[m.end() : i - 1]))
            at = i
        for name, body in sets or [("default", text)]:
            for part in re.split(r";\s*(?=images:|masks:)", body):
                side, mark, pattern = part.partition(":")
                if mark and side.strip() in ("images", "masks"):
                    yield name, side.strip(), pattern.strip()


def prompt_modes_resolve(cases: DataFrame, modes: DataFrame, default: str) -> DataFrame:
    """Mode of a case by task id, then label, then dataset/subdataset, subdataset, dataset, else the default. `modes` (name, mode) is small."""
    out = cases
    for i, key in enumerate((F.col("task_id"), F.col("task_label"), F.concat_ws("/", "dataset", "subdataset"), F.col("subdataset"), F.col("dataset"))):
        t = modes.select(F.col("name").alias(f"n{i}"), F.col("mode").alias(f"m{i}"))
        out = out.withColumn("k", key).join(t, F.col("k") == F.col(f"n{i}"), "left").drop("k", f"n{i}")
    return out.withColumn("mode", F.coalesce(*[F.col(f"m{i}") for i in range(5)], F.lit(default))).drop(*[f"m{i}" for i in range(5)])


def corrupt_reason(length: Column, head: Column, path: Column) -> Column:
    """Why a file cannot be read: missing, zero bytes, or no gzip mark; null for one that can."""
    gz = F.endswith(F.lower(path), F.lit(".gz"))
    return F.when(length.isNull(), "missing").when(length == 0, "zero_bytes").when(gz & (F.hex(F.substring(head, 1, 2)) != "1F8B"), "bad_gzip")


def nifti_reason(head: Column, path: Column) -> Column:
    """Why the first 348 bytes of an uncompressed `.nii` file are no header: too short, another header length, or no magic; null for other files and good ones."""
    size, magic = F.hex(F.substring(head, 1, 4)), F.hex(F.substring(head, 345, 4))
    told = F.when(F.length(head) < 348, "short_header").when(~size.isin("5C010000", "0000015C"), "bad_header_length").when(~magic.isin("6E2B3100", "6E693100"), "bad_magic")
    return F.when(F.endswith(F.lower(path), F.lit(".nii")), told)


#: Fields of a stored quality policy that must be whole numbers, with the field of the required one they are held against.
POLICY_FIELDS = {"min_component_voxels_3d": "min_voxels", "min_slice_area_px_3d": "min_slice_area_px", "min_qualified_slices_3d": "min_slices_any_axis"}


def policy_trusted(policy: Column, required: dict) -> Column:
    """Whether a stored policy (a JSON text) is at least as strict as the required one: applied, whole numbers where whole numbers belong (no
    booleans), the same downsampling, contiguous slices demanded; false for a missing or malformed one.

    `required` may name min_voxels (64), downsample (2), min_slice_area_px (32), min_frac_2d_area (0) and min_slices_any_axis (2)."""
    need = {"min_voxels": 64, "downsample": 2, "min_slice_area_px": 32, "min_frac_2d_area": 0.0, "min_slices_any_axis": 2} | required
    raw = lambda name: F.get_json_object(policy, f"$.{name}")
    # A number in quotes is text: the variant's type tells it from a number.
    kind = lambda name: F.schema_of_variant(F.try_variant_get(F.try_parse_json(policy), f"$.{name}", "variant"))
    whole = lambda name: F.when(kind(name) == "BIGINT", raw(name).try_cast("bigint"))
    number = lambda name: F.when(kind(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), raw(name).try_cast("double"))
    true = lambda name: (kind(name) == "BOOLEAN") & (raw(name) == "true")
    tests = [true("applied"), true("require_contiguous_qualified_slices_3d"), whole("mask_qc_downsample_3d") == need["downsample"], number("min_slice_area_fraction_3d") >= float(need["min_frac_2d_area"])]
    tests += [whole(name) >= need[wanted] for name, wanted in POLICY_FIELDS.items()]
    return F.coalesce(reduce(lambda x, y: x & y, (F.coalesce(t, F.lit(False)) for t in tests)), F.lit(False))


def prompt_audit(rows: DataFrame, length: str = "n_frames", mode: str = "prompt_mode", actual: str = "actual", cached: str = "cached", masks: str = "mask_frames") -> DataFrame:
    """Flags of each run: boxes for every frame, only cached frames prompted, one frame prompted, masks used; null lists are empty."""
    frames = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    return rows.withColumns({
        "boxes_supplied_for_every_frame": (F.size(frames(actual)) == F.col(length)) & (F.col(mode) == "box"),
        "only_cached_frames_prompted": F.size(F.array_except(frames(actual), frames(cached))) == 0,
        "only_one_frame_prompted": F.size(frames(actual)) == 1,
        "mask_prompts_used": (F.col(mode) == "mask") | (F.size(frames(masks)) > 0),
    })


def split_modalities(groups: DataFrame, shared: Column) -> DataFrame:
    """One row for each image of a group (identifier, images, masks as (image_index, path)): `<identifier>_modality<i>` with its masks, or with all
    of them where they are shared; image indices start anew. Groups of one image stay as they are."""
    one = F.size("images") <= 1
    x = groups.withColumn("__shared", shared).select("*", F.posexplode_outer("images").alias("modality_index", "image"))
    own = F.filter("masks", lambda m: F.col("__shared") | one | (m["image_index"] == F.col("modality_index")))
    anew = F.transform(own, lambda m: F.struct(F.when(one, m["image_index"]).otherwise(F.lit(0)).alias("image_index"), m["path"].alias("path")))
    name = F.when(one, F.col("identifier")).otherwise(F.concat("identifier", F.lit("_modality"), F.col("modality_index").cast("string")))
    return x.select(name.alias("identifier"), F.col("identifier").alias("source_identifier"), F.coalesce("modality_index", F.lit(0)).alias("modality_index"), "image", anew.alias("masks"))


def cache_seed(splits: list[DataFrame]) -> DataFrame:
    """Rows (dataset, path, ok = true) for the masks of the three-dimensional sequences (dataset, dim, mask) of all splits, each once."""
    each = [s.where("dim = 3 and mask is not null and mask <> ''").select(F.coalesce("dataset", F.lit("unknown")).alias("dataset"), F.col("mask").alias("path")) for s in splits]
    return reduce(DataFrame.unionByName, each).distinct().withColumn("ok", F.lit(True))


def evaluate_quality(stats: DataFrame, runs: DataFrame, min_voxels: int, min_slices: int) -> DataFrame:
    """Verdict from stored statistics: too few voxels, axis too short, no contiguous window; null for a good mask."""
    x = stats.join(runs, "case_id", "left")
    longest = F.coalesce("longest", F.lit(0))
    return x.select("case_id", F.when(F.col("voxels_est") < min_voxels, "too_few_voxels").when(F.col("slices_1") < min_slices, "axis_too_short").when(longest < min_slices, "no_contiguous").alias("reason"))


def two_phase(coarse: DataFrame, exact, limit: int, share: float = 0.8) -> DataFrame:
    """Coarse counts decide clear cases; those from `share` of the limit up to it are counted exactly by `exact(case ids)`."""
    clear = coarse.where((F.col("voxels") >= limit) | (F.col("voxels") < share * limit)).withColumn("phase", F.lit("coarse"))
    near = coarse.where((F.col("voxels") < limit) & (F.col("voxels") >= share * limit))
    again = exact(near.select("case_id")).withColumn("phase", F.lit("exact"))
    return clear.unionByName(again).withColumn("ok", F.col("voxels") >= limit)


def fill_holes(px: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Foreground (y, x) with the background components that do not reach the border of a height x width image filled in."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        free = np.ones((height, width), bool)
        free[g["y"], g["x"]] = False
        at = np.argwhere(free)
        full = ~free
        if len(at):
            # Background joins by sides alone: points are spread so that corners do not touch.
            root = components(np.r_[at * 2, *[np.argwhere(free[: height - dy, : width - dx] & free[dy:, dx:]) * 2 + [dy, dx] for dy, dx in ((0, 1), (1, 0))]])[: len(at)]
            edge = (at[:, 0] == 0) | (at[:, 1] == 0) | (at[:, 0] == height - 1) | (at[:, 1] == width - 1)
            inner = ~np.isin(root, root[edge])
            full[tuple(at[inner].T)] = True
        y, x = np.nonzero(full)
        return pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return in_lots(px.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")), keys, one, px.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).schema)


def remove_islands(parts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Components of at least `least` voxels; where all are smaller the largest (number 1) stays."""
    size = parts.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    keep = size.where((F.col("n") >= least) | (F.col("component") == 1)).select(*keys, "component")
    big = size.groupBy(*keys).agg(F.max("n").alias("m"))
    keep = keep.join(size, [*keys, "component"]).join(big, keys).where((F.col("n") >= least) | (F.col("m") < least)).select(*keys, "component")
    return parts.join(keep, [*keys, "component"], "left_semi")


def nearest_colour(px: DataFrame, colours: list[tuple[str, tuple[int, int, int]]], tolerance: float) -> DataFrame:
    """Name of the colour within Euclidean tolerance of (r, g, b); the last that fits wins, null for none."""
    tests = [(F.sqrt(sum((F.pow(F.col(c) - v, F.lit(2)) for c, v in zip("rgb", rgb)), F.lit(0.0))) <= tolerance, name) for name, rgb in reversed(colours)]
    return px.withColumn("colour", F.coalesce(*[F.when(t, F.lit(n)) for t, n in tests]))


def crop_boxes(images: DataFrame, layers: int, overlap: float) -> DataFrame:
    """Layered crops of each image (w, h): layer l has 2^l by 2^l boxes that overlap by a share of the shorter side."""
    out = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("layer"))
    n = F.pow(F.lit(2), F.col("layer")).cast("int")
    lap = F.floor(F.lit(overlap) * F.least("w", "h") * 2 / n)
    size = lambda side: F.ceil((lap * (n - 1) + F.col(side)) / n)
    x = out.withColumns({"n": n, "lap": lap, "cw": size("w"), "ch": size("h")}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    x0, y0 = F.when(F.col("n") > 1, (F.col("cw") - F.col("lap")) * F.col("i")).otherwise(0), F.when(F.col("n") > 1, (F.col("ch") - F.col("lap")) * F.col("j")).otherwise(0)
    return x.select(*images.columns, "layer", x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), F.least(x0 + F.col("cw"), F.col("w")).cast("long").alias("x1"), F.least(y0 + F.col("ch"), F.col("h")).cast("long").alias("y1"))


def split_replace(nested: DataFrame, outputs: DataFrame) -> DataFrame:
    """Groups by locator and place with each replaced by its outputs in order; groups without outputs stay."""
    x = nested.join(outputs, "locator", "left")
    return x.select("locator", "place", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("output", "identifier").alias("identifier"))

