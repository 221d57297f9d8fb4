"""Operators on evaluation results: cleaning, filters, roll-ups, comparisons, rankings.

A results table has the id columns of ID and any numeric metric columns. NaN counts as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators.profiles import ranked
from maskloom.operators.quantiles import with_percentiles_of
from maskloom.sources.folders import written

ID = ("model", "prompt_mode", "protocol", "dataset_name", "case_id", "modality", "task_id", "task_label", "status")
#: Upper ends of the right-closed frame bins and their names.
FRAME_BINS = ((1, "1"), (8, "2-8"), (32, "9-32"), (96, "33-96"), (192, "97-192"), (10000, "193+"))


def normalize_results(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Missing id columns and blank ids become `unknown`; numbers are coerced, bad ones and NaN are null; times and memory per frame are derived."""
    for c in ID:
        df = df.withColumn(c, F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown")) if c in df.columns else F.lit("unknown"))
    for c in numeric:
        df = df.withColumn(c, F.nanvl(F.expr(f"try_cast({c} as double)"), F.lit(None)) if c in df.columns else F.lit(None).cast("double"))
    out = df
    if "wall_time_sec" in numeric and "n_frames" in numeric:
        out = out.withColumn("sec_per_frame", F.try_divide("wall_time_sec", "n_frames")).withColumn("frames_per_sec", F.try_divide("n_frames", "wall_time_sec"))
    if "memory_peak_mb" in numeric and "n_frames" in numeric:
        out = out.withColumn("memory_mb_per_frame", F.try_divide("memory_peak_mb", "n_frames"))
    return out.withColumn("run_label", F.concat_ws(" / ", "model", "prompt_mode"))


def status_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are ok, and the others."""
    ok = F.lower("status") == "ok"
    return df.where(ok), df.where(~ok | F.col("status").isNull())


def skip_reason(df: DataFrame, dims: list[int], models: list[str], prompts: list[str], datasets: list[str]) -> DataFrame:
    """`skip_reason`: the first test that a row fails, null for rows to keep. Empty lists allow all."""
    allowed = lambda c, xs: F.lit(False) if not xs else ~F.coalesce(F.col(c).isin(xs), F.lit(False))
    return df.withColumn(
        "skip_reason",
        F.when(F.lower("status") != "ok", "status").when(F.col("dataset_index").isNull(), "index").when(allowed("dim", dims), "dim").when(allowed("model", models), "model")
        .when(allowed("prompt_mode", prompts), "prompt").when(allowed("dataset_name", datasets), "dataset"),
    )


def result_filter(df: DataFrame, **lists) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and how many rows each reason skipped."""
    told = skip_reason(df, **lists)
    return told.where("skip_reason is null").drop("skip_reason"), told.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("rows"))


def exclude_dataset(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows without one dataset, and counts before, after and removed."""
    gone = F.coalesce(F.col("dataset_name") == name, F.lit(False))
    return df.where(~gone), df.agg(F.count("*").alias("before"), F.count_if(~gone).alias("after"), F.count_if(gone).alias("removed"))


def audit_bad_rows(df: DataFrame, flag: str) -> DataFrame:
    """Rows that are not ok or whose strict flag is not true, 1 or 1.0."""
    good = F.lower(F.col(flag).cast("string")).isin("true", "1", "1.0")
    return df.where((F.lower("status") != "ok") | ~F.coalesce(good, F.lit(False)))


def status_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("model", "prompt_mode", "protocol", "status").agg(F.count("*").alias("rows"))


def case_micro_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means over cases with the number of distinct cases."""
    return df.groupBy(*keys).agg(*[F.avg(F.nanvl(m, F.lit(None))).alias(m) for m in metrics], F.countDistinct("case_id").alias("n_cases"))


def dataset_macro_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean per dataset, then the mean of those; datasets, and the distinct cases of the whole group: one that is in two datasets counts once.

    Sums and counts by dataset and case come first; cases then lose their repeats over datasets by a second aggregate on the same keys and case."""
    values = [F.nanvl(m, F.lit(None)) for m in metrics]
    each = df.groupBy(*keys, "dataset_name", "case_id").agg(*[a for m, v in zip(metrics, values) for a in (F.sum(v).alias(f"__s_{m}"), F.count(v).alias(f"__n_{m}"))])
    per = each.groupBy(*keys, "dataset_name").agg(*[F.try_divide(F.sum(f"__s_{m}"), F.sum(f"__n_{m}")).alias(m) for m in metrics])
    cases = each.where("case_id is not null").select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], "case_id").distinct().groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n_cases"))
    means = per.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count("dataset_name").alias("n_datasets"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & means[f"`{k}`"].eqNullSafe(cases[f"__k{i}"])
    return means.join(cases, same, "left").select(*keys, *metrics, "n_datasets", F.coalesce("n_cases", F.lit(0)).alias("n_cases"))


def group_breakdowns(df: DataFrame, keys: list[str], levels: list[str], metrics: list[str]) -> DataFrame:
    """The micro means overall and by each level, in one pass: `level` names the level, `value` its group."""
    view = df.select(*keys, *levels, *metrics)
    label = F.coalesce(*[F.when(F.col(f"__g_{x}") == 0, F.lit(x)) for x in levels], F.lit("overall"))
    grouped = view.groupingSets([*[[F.col(k) for k in keys] + [F.col(x)] for x in levels], [F.col(k) for k in keys]], *[F.col(k) for k in keys], *[F.col(x) for x in levels])
    out = grouped.agg(*[F.grouping(x).alias(f"__g_{x}") for x in levels], *[F.avg(m).alias(m) for m in metrics], F.count("*").alias("rows"))
    return out.select(*keys, label.alias("level"), F.coalesce(*[F.when(F.col(f"__g_{x}") == 0, F.col(x).cast("string")) for x in levels], F.lit("all")).alias("value"), *metrics, "rows")


def memory_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.max(m).alias(f"{m}_max"))])


def frame_bin(n: str) -> Column:
    """Right-closed bins of the number of frames; null outside 1 to 10000."""
    out, low = None, 0
    for high, name in FRAME_BINS:
        test = (F.col(n) > low) & (F.col(n) <= high)
        out = F.when(test, name) if out is None else out.when(test, name)
        low = high
    return out


def efficiency_bins(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means by frame bin; bins without rows are there with nulls. The bins are six, so they are broadcast."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(name, i) for i, (_, name) in enumerate(FRAME_BINS)], "frame_bin string, bin_order int")
    found = df.withColumn("frame_bin", frame_bin("n_frames")).groupBy(*keys, "frame_bin").agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n"))
    every = df.select(*keys).distinct().join(F.broadcast(bins))
    return every.join(found, [*keys, "frame_bin"], "left").withColumn("rows", F.coalesce("n", F.lit(0))).drop("n")


def dist_summary(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Rows, ok and failed rows; of the ok rows' metric count, mean, median, sample deviation (0 for one value) and interquartile range."""
    x = df.withColumn("__x", F.when(F.lower("status") == "ok", F.nanvl(metric, F.lit(None))))
    told = x.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.lower("status") == "ok").alias("ok"), F.count("__x").alias("n"), F.avg("__x").alias("mean"), F.stddev_samp("__x").alias("s"))
    out = with_percentiles_of(told, x, keys, "__x", {"__q1": 0.25, "median": 0.5, "__q3": 0.75})
    return out.select(*keys, "rows", "ok", (F.col("rows") - F.col("ok")).alias("failed"), "n", "mean", "median", F.when(F.col("n") <= 1, 0.0).otherwise(F.col("s")).alias("std"), (F.col("__q3") - F.col("__q1")).alias("iqr"))


def dedup_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`; as an aggregate, so that hot keys are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def paired_model_diff(df: DataFrame, left: str, right: str, metric: str, order: str) -> DataFrame:
    """Two models' last rows of each (dataset, case, prompt) side by side with the difference right - left."""
    keys = ["dataset_name", "case_id", "prompt_mode"]
    last = dedup_last(df.where(F.col("model").isin(left, right)).select(*keys, "model", metric, order), [*keys, "model"], order)
    side = lambda m, name: last.where(F.col("model") == m).select(*keys, F.col(metric).alias(name))
    return side(left, "left_value").join(side(right, "right_value"), keys).withColumn("delta", F.col("right_value") - F.col("left_value"))


def paired_summary(pairs: DataFrame, keys: list[str], within: tuple[float, ...]) -> DataFrame:
    """Pairs, mean, median, deviation and interquartile range of the difference, shares of either side better, and within bounds."""
    d, pairs = F.col("delta"), written(pairs.select(*keys, "delta"), "pairs")  # a join that is read more than once
    told = pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.avg(d).alias("delta_mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("delta_std"),
        F.avg((d > 0).cast("double") * 100).alias("right_better_pct"), F.avg((d < 0).cast("double") * 100).alias("left_better_pct"),
        *[F.avg((F.abs(d) <= w).cast("double") * 100).alias(f"within_{i + 1}_pct") for i, w in enumerate(within)],
    )
    out = with_percentiles_of(told, pairs, keys, "delta", {"__q1": 0.25, "delta_median": 0.5, "__q3": 0.75}).withColumn("delta_iqr", F.col("__q3") - F.col("__q1"))
    return out.select(*keys, "pairs", "delta_mean", "delta_median", "delta_std", "delta_iqr", "right_better_pct", "left_better_pct", *[f"within_{i + 1}_pct" for i in range(len(within))])


def aggregate_mixed(df: DataFrame, keys: list[str], means: list[str], sums: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in means], *[F.sum(s).alias(s) for s in sums])


def ranking(df: DataFrame, score: str) -> DataFrame:
    """Rows by falling score, nulls last, with their place."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), "model")))


def phase_sort(df: DataFrame) -> DataFrame:
    """Benchmark order: two-dimensional first, then dataset without case, then index."""
    return df.orderBy("dim", F.lower("dataset_name"), "dataset_index")


def case_progress(cases: DataFrame) -> DataFrame:
    """Order in the benchmark, and number, total and percent within dataset and within phase (`dim`).

    The total order comes from a range sort: ranks within each dataset, plus the sizes of the datasets before."""
    sizes = cases.groupBy("dim", "dataset_name").agg(F.count("*").alias("n"))
    # A row per phase and dataset: the running totals of this small table need one task.
    place = Window.orderBy("dim", F.lower("dataset_name"), "dataset_name")
    phase = Window.partitionBy("dim").orderBy(F.lower("dataset_name"), "dataset_name")
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = sizes.select("dim", "dataset_name", "n", upto(place).alias("before"), upto(phase).alias("phase_before"), F.sum("n").over(Window.partitionBy("dim")).alias("phase_total"))
    number = F.row_number().over(Window.partitionBy("dim", "dataset_name").orderBy("dataset_index"))
    out = cases.withColumn("k", number).join(heads, ["dim", "dataset_name"])
    return out.select(
        "dim", "dataset_name", "dataset_index", (F.col("before") + F.col("k")).alias("benchmark_order"), F.col("k").alias("dataset_case_number"), F.col("n").alias("dataset_case_total"),
        (F.col("k") * 100.0 / F.col("n")).alias("dataset_percent"), (F.col("phase_before") + F.col("k")).alias("phase_number"), F.col("phase_total"),
    )


def dataset_order(cases: DataFrame, order: str) -> DataFrame:
    """Datasets by their first case."""
    first = cases.groupBy("dataset_name").agg(F.min(order).alias("first_order"))
    return first.withColumn("dataset_position", F.row_number().over(Window.orderBy("first_order")))


def per_dataset_head(cases: DataFrame, k: int) -> DataFrame:
    """Up to k cases of each dataset, the first of each dim ahead of the others; `short` is how many are missing."""
    by_dim = Window.partitionBy("dataset_name", "dim").orderBy("dataset_index")
    ahead = cases.withColumn("__r", F.row_number().over(by_dim)).withColumn("__later", (F.col("__r") > 1).cast("int"))
    w = Window.partitionBy("dataset_name").orderBy("__later", F.desc("dim"), "dataset_index")
    picked = ahead.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)
    return picked.withColumn("short", F.lit(k) - F.count("*").over(Window.partitionBy("dataset_name"))).drop("__r", "__later")


def first_per_dim(cases: DataFrame, k: int) -> DataFrame:
    return cases.withColumn("pick", F.row_number().over(Window.partitionBy("dim").orderBy("dataset_index"))).where(F.col("pick") <= k)


def score_pivot(df: DataFrame, row: str, column: str, score: str, values: list[str], top: int) -> DataFrame:
    """Mean score by row group and run label; rows by the mean of their cells, the best first."""
    p = df.groupBy(row).pivot(column, values).agg(F.avg(score))
    cells = [F.col(f"`{v}`") for v in values]
    mean = F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cells), F.lit(0.0)), sum((c.isNotNull().cast("int") for c in cells), F.lit(0)))
    return p.withColumn("row_mean", mean).orderBy(F.desc_nulls_last("row_mean"), row).limit(top)


def run_summary(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "value")
    return (out.limit(top) if top else out).select(F.lit(column).alias("field"), "value", "rows")


def pending(grid: list[DataFrame], done: DataFrame, keys: list[str]) -> DataFrame:
    """The grid of small axes and cases, without the completed keys. All axes but the first are small lists, checked by the caller."""
    out = grid[0]
    for axis in grid[1:]:
        out = out.crossJoin(axis)
    return out.join(done.select(*keys).distinct(), keys, "left_anti")


def milestones(df: DataFrame, keys: list[str], order: str, total: str) -> DataFrame:
    """First row that reaches each further tenth of its group's total: a bucket of the percent that is higher than the row's before."""
    bucket = lambda rows: F.least(F.floor(rows * 100.0 / F.col(total) / 10), F.lit(10))
    x = ranked(df, keys, [order]).withColumns({"percent": F.col("position") * 100.0 / F.col(total), "bucket": bucket(F.col("position")), "__b": bucket(F.col("position") - 1)})
    return x.where("bucket > __b").drop("__b", "position", "group_rows")


def weighted_group_metrics(df: DataFrame, key: str, metrics: list[str], weights: dict[str, str]) -> DataFrame:
    """Weighted means by group for each weight column, with the weight floored at 1."""
    return df.groupBy(key).agg(*[(F.sum(F.col(m) * F.col(w)) / F.greatest(F.lit(1.0), F.sum(w))).alias(f"{m}_{name}") for name, w in weights.items() for m in metrics], F.avg((F.col("dim") == 3).cast("double")).alias("share_3d"))


def format_duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds, from the largest unit that is not zero; negative or missing is `unknown`."""
    s = F.rint(seconds).cast("long")
    d, h, m, r = F.expr("0L") + F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    told = (
        F.when(d > 0, F.format_string("%dd %02dh %02dm", d, h, m)).when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r))
        .when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))
    )
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf")), "unknown").otherwise(told)


# Names of prompt modes.
PROMPT_ALIASES = {"bbox": "box", "boxes": "box", "box": "box", "click": "point", "clicks": "point", "point": "point", "points": "point", "mask": "mask", "masks": "mask"}


def prompt_modes(text: Column) -> Column:
    """Canonical prompt modes of a comma list, in order, each once; unknown names are left out."""
    names = F.create_map(*[F.lit(x) for kv in PROMPT_ALIASES.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda m: F.try_element_at(names, F.lower(F.trim(m)))), lambda m: m.isNotNull()))
