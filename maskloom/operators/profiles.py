"""Intensity profiles: mergeable statistics, windows, normalisation, and checks of stored profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators.quantiles import percentiles, with_percentiles
from maskloom.sources.folders import written


def welford(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable state of each group: count, mean and sum of squared differences."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def welford_merge(states: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and population deviation from partial states, merged by their sums."""
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    mean = total / n
    m2 = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    return states.groupBy(*keys).agg(n.alias("count"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), m2 / n)).alias("std"))


def percentile_window(df: DataFrame, keys: list[str], value: str, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Exact low and high percentile (linear between values) of each group; nulls and NaN do not count, and a group without values has nulls.

    Values are counted, not sorted: see `quantiles`."""
    return percentiles(df, keys, value, {"window_lower": lo, "window_upper": hi})


def per_file_cap(df: DataFrame, key: str, unit: Column, cap: int) -> DataFrame:
    """At most `cap` values of each file, those of the smallest hash."""
    w = Window.partitionBy(key).orderBy(unit)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt to tasks by range of `order` and sorted: `__part` and `__row` (from 0) say where each lies. The written table keeps the dealing.

    Rows of equal order are dealt by a hash of all columns, so that only exact repeats stay together."""
    ends = [*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])] if df.columns else order
    dealt = df.repartitionByRange(*ends).sortWithinPartitions(*ends)
    return written(dealt.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """`position` from 1 in the order of all rows, without one task that holds them all. The counts are a row per task."""
    dealt = _dealt(df, order)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = counts.select("__part", before.alias("__before"))
    return dealt.join(F.broadcast(heads), "__part").withColumn("position", F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__before")


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`position` from 1 within each group of `keys`, and its rows as `group_rows`; a group may be of any size, since it spreads over tasks.

    Rows are dealt by range of keys and order. Of each group and task there is a row that says how many of the group's rows come before; it meets the task's rows by group and
    task, so a large group is not gathered again."""
    dealt = _dealt(df, [*keys, *order])
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    each = dealt.groupBy("__part", *keys).agg(F.min("__row").alias("__head"), F.count("*").alias("__n"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = each.select(F.col("__part").alias("__at"), *[F.col(f"`{k}`").alias(n) for k, n in names.items()], "__head", before.alias("__before"), F.sum("__n").over(group).alias("group_rows"))
    same = dealt["__part"] == heads["__at"]
    for k, n in names.items():
        same = same & dealt[f"`{k}`"].eqNullSafe(heads[n])
    return dealt.join(heads, same).withColumn("position", F.col("__before") + F.col("__row") - F.col("__head") + 1).drop("__part", "__row", "__at", "__head", "__before", *names.values())


def evenly_spaced(df: DataFrame, order: str, k: int) -> DataFrame:
    """Rows at `k` evenly spaced positions of the order, first and last among them."""
    n = df.count()
    wanted = sorted({int(round(i * (n - 1) / max(1, k - 1))) + 1 for i in range(min(k, n))})
    return numbered(df, [order]).where(F.col("position").isin(wanted))


def foreground_stats(df: DataFrame, key: str, value: str, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Each volume's foreground (not 0) percentiles, and mean and deviation of its values clipped to them."""
    fg = df.where(F.col(value) != 0)
    x = with_percentiles(fg, [key], value, {"window_lower": lo, "window_upper": hi}).withColumn("c", F.greatest(F.least(F.col(value), F.col("window_upper")), F.col("window_lower")))
    return x.groupBy(key).agg(F.first("window_lower").alias("window_lower"), F.first("window_upper").alias("window_upper"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"))


def zscore(value: Column, lo: Column, hi: Column, mean: Column, std: Column) -> Column:
    """Clipped to the window, centred and scaled; without deviation only centred; what is not finite is 0."""
    x = F.greatest(F.least(value, hi), lo) - mean
    out = F.when(std > 0, x / std).otherwise(x)
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(out)


def mri_zscore(df: DataFrame, key: str, value: str) -> DataFrame:
    """Foreground z-scores per volume; background stays 0."""
    z = zscore(F.col(value), F.col("window_lower"), F.col("window_upper"), F.col("mean"), F.col("std"))
    return df.join(foreground_stats(df, key, value), key, "left").withColumn("z", F.when(F.col(value) == 0, 0.0).otherwise(z))


def window_zscore(df: DataFrame, key: str, value: str, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Z-scores of values clipped to their group's percentile window, by the group's own mean and deviation."""
    moments = df.groupBy(F.col(f"`{key}`").alias("__group")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    x = with_percentiles(df, [key], value, {"window_lower": lo, "window_upper": hi})
    x = x.join(moments, x[f"`{key}`"].eqNullSafe(moments["__group"])).drop("__group")
    return x.withColumn("z", zscore(F.col(value), F.col("window_lower"), F.col("window_upper"), F.col("mean"), F.col("std")))


def robust_01(df: DataFrame, key: str, value: str) -> DataFrame:
    """Between the 1st and 99th percentile to 0..1; 0 where these are equal."""
    x = with_percentiles(df, [key], value, {"window_lower": 0.01, "window_upper": 0.99})
    span = F.col("window_upper") - F.col("window_lower")
    return x.withColumn("scaled", F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - F.col("window_lower")) / span))).otherwise(0.0))


def to_uint8(df: DataFrame, key: str, value: str) -> DataFrame:
    q = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(q, key).withColumn("byte", F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0).cast("int"))


def label_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Dense labels of the distinct values of each group, background 0 first."""
    d = df.select(key, value).distinct()
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.when(F.col(value) == 0, 0).otherwise(1), value))
    zero = F.max((F.col(value) == 0).cast("int")).over(Window.partitionBy(key))
    return d.withColumn("dense", (rank - zero).cast("int"))


def profile_reason(lo: Column, hi: Column, std: Column, count: Column, source: Column, failed: Column, space: Column) -> Column:
    """First failing check of a stored profile, null for a valid one."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return (
        F.when(~F.coalesce(space.isin("hu", "display"), F.lit(False)), "space").when(bad(lo) | bad(hi) | bad(std), "not_finite").when(hi <= lo, "window").when(std <= 0, "std")
        .when((count <= 0) | (failed < 0) | (failed > source), "counts")
    )


def profile_select(images: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profile of the image's subdataset, or `default` for images without one; `missing` where there is none."""
    x = images.withColumn("subdataset_key", F.coalesce("subdataset", F.lit("default")))
    return x.join(profiles, x["subdataset_key"] == profiles["profile_name"], "left").withColumn("missing", F.col("profile_name").isNull())
