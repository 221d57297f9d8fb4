"""Splits, quotas, weighted samples, schedules and prompts. Chance is a hash of seed and key, the same on every engine and retry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.keys import unit
from maskloom.operators.profiles import numbered, ranked
from maskloom.operators.quantiles import order_statistics
from maskloom.sources.folders import written


def exact_fraction_split(df: DataFrame, keys: list[str], ident: str, share: float, seed: int) -> DataFrame:
    """In each group the first floor(n * share) rows by hash, then by ident, go to validation; groups may be of any size.

    The hash of the last of them is an order statistic of its group; only rows that have this very hash are ranked, where not all of them go."""
    x = df.withColumn("__u", unit(F.col(ident), seed))
    last = order_statistics(x, keys, "__u", {"__last": lambda n: F.floor(n * F.lit(float(share))) - 1})
    ends = last.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__last.value").alias("__end"), (F.floor(F.col("__n") * F.lit(float(share))) - F.col("__last.before")).alias("__room"), F.col("__last.equal").alias("__equal"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & x[f"`{k}`"].eqNullSafe(ends[f"__k{i}"])
    x = x.join(ends, same)
    tied = F.coalesce((F.col("__u") == F.col("__end")) & (F.col("__room") < F.col("__equal")), F.lit(False))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(ident))
    some = x.where(tied).withColumn("split", F.when(turn <= F.col("__room"), "val").otherwise("train"))
    rest = x.where(~tied).withColumn("split", F.when(F.col("__u") <= F.col("__end"), "val").otherwise("train"))
    return rest.unionByName(some).drop("__u", "__end", "__room", "__equal", *[f"__k{i}" for i in range(len(keys))])


def deterministic_subset(df: DataFrame, ident: str, k: int, seed: int) -> DataFrame:
    return df.withColumn("__u", unit(F.col(ident), seed)).orderBy("__u", ident).limit(k).drop("__u")


def max_groups(df: DataFrame, keys: list[str], ident: str, k: int, seed: int) -> DataFrame:
    """At most k rows of each group, by hash."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(unit(F.col(ident), seed), ident))
    return df.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


def weighted_sample(df: DataFrame, keys: list[str], ident: str, weight: Column, k: int, seed: int) -> DataFrame:
    """k rows of each group without replacement, by weight: the smallest -ln(u) / weight."""
    u = F.greatest(unit(F.col(ident), seed), F.lit(1e-12))
    race = F.round(-F.ln(u) / weight, 9)
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(race, ident))
    return df.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


def largest_remainder(buckets: DataFrame, capacity: str, target: int, least: int = 0, name: str = "task") -> DataFrame:
    """Whole quotas of `target` units for buckets: first `least` each (at most the capacity), then in proportion to the capacity left,
    rounded down, then one unit each by falling remainder, then capacity left, then name, where there is room.

    Where the floors alone are over the target, the largest floors give back first, then by name. A bucket table has a row per task, so its windows are small."""
    every = Window.partitionBy(F.lit(1))
    before = lambda order: F.coalesce(F.sum("start").over(every.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cap = F.col(capacity).cast("long")
    x = buckets.select(F.col(name), F.col(capacity), F.least(F.lit(max(0, least) if target > 0 else 0).cast("long"), cap).alias("start"))
    x = x.withColumns({"rest": cap - F.col("start"), "open": F.lit(max(0, target)) - F.sum("start").over(every), "given": before([F.desc("start"), name])})
    back = F.least(F.col("start"), F.greatest(F.lit(0), -F.col("open") - F.col("given")))
    raw = F.when(F.col("open") > 0, F.coalesce(F.try_divide(F.col("open") * F.col("rest").cast("double"), F.sum("rest").over(every)), F.lit(0.0))).otherwise(0.0)
    x = x.withColumns({"raw": raw, "start": F.col("start") - back}).withColumn("down", F.least(F.col("rest"), F.floor("raw")))
    x = x.withColumns({"left": F.greatest(F.lit(0), F.col("open") - F.sum("down").over(every)), "room": (F.col("down") < F.col("rest")) & (F.col("open") > 0)})
    turn = F.row_number().over(Window.partitionBy("room").orderBy(F.desc(F.round(F.col("raw") - F.floor("raw"), 9)), F.desc("rest"), name))
    extra = F.when(F.col("room") & (turn <= F.col("left")), 1).otherwise(0)
    return x.select(name, capacity, (F.col("start") + F.col("down") + extra).cast("long").alias("quota"))


def primary_bucket(items: DataFrame, seed: int, slots: int = 8) -> DataFrame:
    """Each item of (idx, dim, task) to one of its buckets (dim, task): the least filled, in share of its size, then in rows, then the smallest, then by hash.

    Items come in order of the number of their buckets, rarest first, and within a number in `slots` turns by hash. All items of a turn see the fill
    that the turns before have left, so the result does not depend on how rows are dealt, and a turn is one pass. The fill table has a row per bucket."""
    spark, bucket = items.sparkSession, ["dim", "task"]
    own = Window.partitionBy("idx", "dim")
    x = items.select("idx", "dim", "task").distinct().withColumns({"u": unit(F.concat_ws("|", F.col("idx").cast("string"), "task"), seed), "choices": F.count("*").over(own)})
    x = x.withColumn("turn", F.col("choices") * slots + F.floor(unit(F.col("idx"), seed + 1) * slots))
    x = written(x.join(items.groupBy(*bucket).agg(F.count("*").alias("size")), bucket), "bucket-items")
    fill = {(r["dim"], r["task"]): 0 for r in x.select(*bucket).distinct().collect()}
    parts = []
    for turn in sorted(r["turn"] for r in x.select("turn").distinct().collect()):
        held = spark.createDataFrame([(*k, n) for k, n in fill.items()], x.select(*bucket).schema.add("held", "long"))
        order = F.struct((F.col("held") / F.col("size")).alias("share"), "held", "size", "u", "task")
        best = x.where(F.col("turn") == turn).join(held, bucket).groupBy("idx", "dim").agg(F.min(order).alias("b")).select("idx", "dim", F.col("b.task").alias("task"))
        best = written(best, "bucket-turn")  # counted here and given in the end
        parts.append(best)
        for r in best.groupBy(*bucket).count().collect():
            fill[r["dim"], r["task"]] += r["count"]
    return reduce(DataFrame.unionByName, parts) if parts else x.select("idx", "dim", "task")


def dim_budget(items: DataFrame, ratio: float, power: float, seed: int) -> DataFrame:
    """Keep at most `ratio` two-dimensional items for each three-dimensional one, rare tasks preferred (weight 1 / count^power).

    The two-dimensional items are numbered by range, so that no task holds them all."""
    n3 = items.where("dim = 3").count()
    count = items.groupBy("dim", "task").agg(F.count("*").alias("n"))
    two = items.where("dim = 2").join(count, ["dim", "task"])
    race = F.round(-F.ln(F.greatest(unit(F.col("idx"), seed), F.lit(1e-12))) / (1 / F.pow("n", F.lit(power))), 9)
    some = numbered(two.withColumn("__race", race), ["__race", "idx"]).where(F.col("position") <= int(ratio * n3))
    return items.where("dim = 3").unionByName(some.select(*items.columns))


def bucket_fair(df: DataFrame, bucket: str, order: str) -> DataFrame:
    """Interleaved positions: the j-th of n in a bucket comes at (j + 0.5) / n of the whole."""
    x = ranked(df, [bucket], [order])
    return x.withColumn("fair_position", (F.col("position") - 0.5) / F.col("group_rows")).drop("position", "group_rows")


def batch_ids(df: DataFrame, bucket: str, order: str, size: int, drop_last: bool) -> DataFrame:
    """Batches of one bucket; the last short one may be dropped."""
    x = ranked(df, [bucket], [order]).withColumn("batch_id", F.floor((F.col("position") - 1) / size))
    return (x.where((F.col("batch_id") + 1) * size <= F.col("group_rows")) if drop_last else x).drop("position", "group_rows")


def prompt_frames(frames: DataFrame, k: int, seed: int) -> DataFrame:
    """Of each case's foreground frames (case, frame_idx, area): the first, one by area-weighted chance, then the largest, k in all."""
    w = Window.partitionBy("case")
    u = F.greatest(unit(F.concat_ws("|", F.col("case").cast("string"), F.col("frame_idx").cast("string")), seed), F.lit(1e-12))
    x = frames.where("area > 0").withColumn("first", F.row_number().over(w.orderBy("frame_idx")) == 1)
    race = F.when(F.col("first"), F.lit(float("inf"))).otherwise(F.round(-F.ln(u) / F.col("area"), 12))
    x = x.withColumn("drawn", F.row_number().over(w.orderBy(race, "frame_idx")) == 1)
    r = F.row_number().over(w.orderBy(F.desc("first"), F.desc("drawn"), F.desc("area"), "frame_idx"))
    return x.withColumn("pick", r).where(F.col("pick") <= k).select("case", "frame_idx", "pick")


def prompt_frame_prob(frames: DataFrame, p: float, seed: int) -> DataFrame:
    """Each foreground frame with probability p, the first one always."""
    u = unit(F.concat_ws("|", F.col("case").cast("string"), F.col("frame_idx").cast("string")), seed)
    first = F.row_number().over(Window.partitionBy("case").orderBy("frame_idx")) == 1
    return frames.where("area > 0").withColumn("f", first).where((u < p) | F.col("f")).drop("f")


def clicks(px: DataFrame, k: int, seed: int) -> DataFrame:
    """k positive and k negative pixels of each frame by hash."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("case_id", "frame_idx", "px")])
    r = F.row_number().over(Window.partitionBy("case_id", "frame_idx", "gt").orderBy(unit(key, seed), "px"))
    return px.withColumn("r", r).where(F.col("r") <= k).select("case_id", "frame_idx", "px", F.col("gt").alias("positive"))


def error_click(px: DataFrame, threshold: float, seed: int) -> DataFrame:
    """One wrong pixel of each frame by hash: positive if it was missed, else negative; where all is right a background pixel."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("case_id", "frame_idx", "px")])
    wrong = (F.col("prob") >= threshold).cast("int") != F.col("gt")
    order = F.struct(F.when(wrong, 0).when(F.col("gt") == 0, 1).otherwise(2).alias("a"), unit(key, seed).alias("u"), F.col("px"), F.col("gt"))
    return px.groupBy("case_id", "frame_idx").agg(F.min(order).alias("c")).select("case_id", "frame_idx", F.col("c.px").alias("px"), (F.col("c.gt") == 1).cast("int").alias("positive"))


def anchor_frame(frames: DataFrame) -> DataFrame:
    """The prompted foreground frame after the start nearest the middle of the case; of two the later."""
    x = frames.withColumn("mid", (F.max("frame_idx").over(Window.partitionBy("case")) / 2))
    key = F.struct(F.abs(F.col("frame_idx") - F.col("mid")).alias("d"), (-F.col("frame_idx")).alias("m"))
    return x.where("prompted and area > 0 and frame_idx > 0").groupBy("case").agg(F.min(key).alias("k")).select("case", (-F.col("k.m")).alias("anchor"))


def closest_frames(prompts: DataFrame, frames: DataFrame, k: int) -> DataFrame:
    """For each frame up to k prompted ones: the nearest before, the nearest at or after, then the others by distance.

    Prompted frames of a case are few; they travel as one array per case."""
    lists = prompts.groupBy("case").agg(F.array_sort(F.collect_set("frame_idx")).alias("p"))
    t = F.col("frame_idx")
    before, after = F.array_max(F.filter("p", lambda x: x < t)), F.array_min(F.filter("p", lambda x: x >= t))
    rest = F.array_sort(F.transform(F.filter("p", lambda x: ~F.coalesce(x == before, F.lit(False)) & ~F.coalesce(x == after, F.lit(False))), lambda x: F.struct(F.abs(x - t).alias("d"), x.alias("x"))))
    chosen = F.slice(F.concat(F.filter(F.array(before, after), lambda x: x.isNotNull()), F.transform(rest, lambda e: e["x"])), 1, k)
    return frames.join(lists, "case").select("case", "frame_idx", chosen.alias("closest"))


def prompt_coin(case: Column, frame: Column, seed: int) -> Column:
    """box or point by the parity of the first byte of a sha1."""
    h = F.sha1(F.concat_ws("|", F.lit(str(seed)), case.cast("string"), frame.cast("string")).cast("binary"))
    return F.when(F.conv(F.substring(h, 1, 2), 16, 10).cast("int") % 2 == 0, "box").otherwise("point")


def ema(df: DataFrame, keys: list[str], order: str, value: str, beta: float = 0.9) -> DataFrame:
    """Exponential moving average along the order, starting with the first value.

    Row i of n counts beta^(n - i), all but the first times 1 - beta: a sum that adds up in parts, however many rows a group has."""
    x = ranked(df.select(*keys, order, value), keys, [order, value])
    weight = F.pow(F.lit(beta), F.col("group_rows") - F.col("position")) * F.when(F.col("position") == 1, 1.0).otherwise(1 - beta)
    return x.groupBy(*keys).agg(F.count("*").cast("int").alias("steps"), F.sum(weight * F.col(value)).alias("ema"))


def prompt_plan(frames: DataFrame, mode: str, usable: dict[str, Column], preferred: Column, strict: bool = True) -> DataFrame:
    """The prompt of each frame (case, frame_idx) that has a usable one: `usable` tells for each kind whether the frame has it.

    In a mode that is a kind, that kind alone; in mode `mixed` the preferred kind, or else another one, in the order given. A case without any is an error when the plan is read, or with `strict`
    off has no rows."""
    if mode != "mixed" and mode not in usable:
        raise ValueError(f"no such prompt mode: {mode}")
    kinds = usable if mode == "mixed" else {mode: usable[mode]}
    have = lambda k: F.when(F.coalesce(kinds[k], F.lit(False)), k)
    wanted = F.coalesce(*[F.when(preferred == k, have(k)) for k in kinds], *[have(k) for k in kinds]) if mode == "mixed" else have(mode)
    told = frames.select("case", "frame_idx", wanted.alias("prompt"))
    plan = told.where(F.col("prompt").isNotNull())
    if not strict:
        return plan
    none = told.groupBy("case").agg(F.count("prompt").alias("n")).where("n = 0")
    fail = F.raise_error(F.concat(F.lit(f"no usable {mode} prompt in case "), F.col("case").cast("string")))
    return plan.unionByName(none.select("case", F.lit(None).cast(told.schema["frame_idx"].dataType).alias("frame_idx"), fail.cast("string").alias("prompt")))


def task_label(rows: DataFrame, task: str, names: DataFrame) -> DataFrame:
    """`rows` with `label`: the task's display name of `names` (task, display), else the task with spaces for underscores, else `unknown`."""
    ends = names.select(F.col("task").alias("__task"), F.col("display").alias("__display"))
    x = rows.join(ends, rows[task] == ends["__task"], "left")
    return x.withColumn("label", F.coalesce("__display", F.replace(F.col(task), F.lit("_"), F.lit(" ")), F.lit("unknown"))).drop("__task", "__display")
