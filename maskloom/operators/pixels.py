"""Operators on pixels (case_id, frame_idx, px, prob, gt): counts, overlap scores, sweeps, calibration.

Whatever has no positive on either side scores 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nineteen thresholds, 0.05 to 0.95.
THRESHOLDS = [round(0.05 * k, 2) for k in range(1, 20)]
#: Upper ends of the bins of the foreground share.
FG_BINS = (0.001, 0.01, 0.05, 0.2)


def confusion(pred: Column, gt: Column) -> list[Column]:
    """tp, fp, fn, tn as aggregates."""
    p, g = pred, gt == 1
    return [F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn")]


def dice(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(1.0))


def iou(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(1.0 * tp, tp + fp + fn), F.lit(1.0))


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def _scores(df: DataFrame, prefix: str = "") -> DataFrame:
    n = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumn(f"{prefix}dice", dice(*n)).withColumn(f"{prefix}iou", iou(*n))


def confusion_counts(px: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    return px.groupBy(*keys).agg(*confusion(F.col("prob") >= threshold, F.col("gt")))


def per_frame_metrics(px: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts and scores of each frame; has_gt and has_pred tell empty frames."""
    out = _scores(confusion_counts(px, ["case_id", "frame_idx"], threshold), "frame_")
    return out.withColumn("frame_has_gt", F.col("tp") + F.col("fn") > 0).withColumn("frame_has_pred", F.col("tp") + F.col("fp") > 0)


def case_metrics(px: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Whole-case scores from frame counts: over all frames, over frames with truth, and the mean of those frames' scores."""
    f = per_frame_metrics(px, threshold)
    fg = F.col("frame_has_gt")
    total = lambda c, on=F.lit(True): F.sum(F.when(on, F.col(c)).otherwise(0))
    c = f.groupBy("case_id").agg(
        *[total(x).alias(x) for x in ("tp", "fp", "fn", "tn")], *[total(x, fg).alias(f"fg_{x}") for x in ("tp", "fp", "fn")], F.count("*").alias("n_frames"), F.count_if(fg).alias("n_fg_frames"),
        F.avg(F.when(fg, F.col("frame_dice"))).alias("fg_mean_frame_dice"), F.count_if(~fg & F.col("frame_has_pred")).alias("empty_fp_frames"), F.count_if(~fg).alias("n_empty_frames"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "case_id", "n_frames", "n_fg_frames", dice(tp, fp, fn).alias("full_sequence_dice"), iou(tp, fp, fn).alias("full_sequence_iou"), dice(F.col("fg_tp"), F.col("fg_fp"), F.col("fg_fn")).alias("fg_volume_dice"),
        iou(F.col("fg_tp"), F.col("fg_fp"), F.col("fg_fn")).alias("fg_volume_iou"), "fg_mean_frame_dice", safe_div(fn, tp + fn).alias("fnr"), safe_div(fp, fp + tn).alias("fpr"), safe_div(tp, tp + fp).alias("ppv"),
        safe_div(tp, tp + fn).alias("recall"), safe_div(tn, tn + fp).alias("specificity"), (1 - safe_div(F.abs(fp - fn), 2 * tp + fp + fn, 0.0)).alias("volumetric_similarity"), (tp + fp == 0).alias("empty_pred"), (tp + fn == 0).alias("empty_gt"),
        ((tp + fn > 0) & (tp == 0)).alias("missed_object"), ((tp + fn == 0) & (fp > 0)).alias("hallucination"),
    )


def empty_frame_metrics(px: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of frames without truth: the share with any prediction, and pixel specificity."""
    f = per_frame_metrics(px, threshold).where(~F.col("frame_has_gt"))
    return f.groupBy("case_id").agg(F.avg(F.col("frame_has_pred").cast("double")).alias("empty_frame_fp_rate"), (F.sum("tn") / F.sum(F.col("tn") + F.col("fp"))).alias("empty_frame_specificity"))


def threshold_sweep(px: DataFrame, keys: list[str], thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Counts and scores at every threshold in one pass: each probability is counted at the number of thresholds it meets, and sums
    from the highest down give the positives at each. After the first aggregate a group has at most thresholds + 1 rows."""
    met = sum(((F.col("prob") >= t).cast("int") for t in thresholds), F.lit(0))
    cells = px.groupBy(*keys, met.alias("met")).agg(F.count_if(F.col("gt") == 1).alias("p"), F.count_if(F.col("gt") != 1).alias("n"))
    per = cells.groupBy(*keys).agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"), F.map_from_entries(F.collect_list(F.struct("met", F.struct("p", "n")))).alias("m"))
    levels = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])
    least = len(thresholds)
    upto = lambda k, side: F.aggregate(F.sequence(k, F.lit(least)), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("m", i)[side], F.lit(0)))
    x = per.select("*", F.explode(levels).alias("l")).select(*keys, F.col("l.threshold").alias("threshold"), upto(F.col("l.k"), "p").alias("tp"), upto(F.col("l.k"), "n").alias("fp"), "p_all", "n_all")
    return _scores(x.select(*keys, "threshold", "tp", "fp", (F.col("p_all") - F.col("tp")).alias("fn"), (F.col("n_all") - F.col("fp")).alias("tn")))


def best_threshold(sweep: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean score per group and threshold; the best row of each group, ties to the threshold nearest 0.5, then the smaller."""
    mean = sweep.groupBy(*keys, "threshold").agg(F.avg(score).alias(score))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.round(score, 12)), F.round(F.abs(F.col("threshold") - 0.5), 9), "threshold")
    return mean.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def training_style_metrics(px: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Over frames with truth alone: mean frame score and whole-volume score at each threshold."""
    frames = threshold_sweep(px, [*keys, "case_id", "frame_idx"], thresholds).where("tp + fn > 0")  # the sweep's own positives tell which frames have truth
    volume = _scores(frames.groupBy(*keys, "case_id", "threshold").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")], F.avg("dice").alias("slice_dice"), F.avg("iou").alias("slice_iou")), "volume_")
    return volume.groupBy(*keys, "threshold").agg(*[F.avg(x).alias(x) for x in ("slice_dice", "slice_iou", "volume_dice", "volume_iou")])


def ece(px: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins, the last closed."""
    b = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1))
    per = px.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("conf"), F.avg(F.col("gt").cast("double")).alias("acc"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def roc_pr_auc(px: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve and average precision, null where one class is missing. Equal scores count together.

    Running counts go in two steps, over 1024 bands of scores and within a band, so that a group's scores need not meet in one task."""
    per = px.groupBy(*keys, "prob").agg(F.count_if(F.col("gt") == 1).alias("p"), F.count_if(F.col("gt") != 1).alias("n"))
    per = per.withColumn("band", F.floor(F.col("prob") * 1024))
    higher = Window.partitionBy(*keys).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = per.groupBy(*keys, "band").agg(F.sum("p").alias("p_band"), F.sum("n").alias("n_band"))
    bands = bands.select(*keys, "band", *[F.coalesce(F.sum(f"{x}_band").over(higher), F.lit(0)).alias(f"{x}_higher") for x in ("p", "n")])
    down = Window.partitionBy(*keys, "band").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = per.join(bands, [*keys, "band"]).withColumns({"tp": F.col("p_higher") + F.sum("p").over(down), "fp": F.col("n_higher") + F.sum("n").over(down)})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("n"))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")
    both = (F.sum("p") > 0) & (F.sum("n") > 0)
    return c.groupBy(*keys).agg(F.when(both, area).alias("roc_auc"), F.when(both, ap).alias("pr_auc"))


def soft_scores(px: DataFrame, alpha: float = 0.3, beta: float = 0.7, gamma: float = 2.0, weight: float = 0.25, eps: float = 1e-6) -> DataFrame:
    """Per case: soft Dice, Tversky index and mean focal loss of the probabilities."""
    p, g = F.col("prob"), F.col("gt").cast("double")
    pt, at = F.when(g == 1, p).otherwise(1 - p), F.when(g == 1, weight).otherwise(1 - weight)
    a = px.groupBy("case_id").agg(F.sum(p * g).alias("pg"), F.sum(p).alias("p"), F.sum(g).alias("g"), F.avg(-at * F.pow(1 - pt, F.lit(gamma)) * F.ln(F.greatest(pt, F.lit(1e-12)))).alias("focal"))
    pg, sp, sg = F.col("pg"), F.col("p"), F.col("g")
    return a.select("case_id", ((2 * pg + eps) / (sp + sg + eps)).alias("soft_dice"), ((pg + eps) / (pg + alpha * (sp - pg) + beta * (sg - pg) + eps)).alias("tversky"), "focal")


def fg_bin(share: Column) -> Column:
    """Bin of a foreground share, by the upper ends FG_BINS."""
    out = F.when(share < FG_BINS[0], 0)
    for i, x in enumerate(FG_BINS[1:], 1):
        out = out.when(share < x, i)
    return out.otherwise(len(FG_BINS))


def fg_bin_metrics(px: DataFrame, threshold: float = 0.5) -> DataFrame:
    f = per_frame_metrics(px, threshold).withColumn("share", (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    return f.groupBy(fg_bin(F.col("share")).alias("fg_bin")).agg(F.avg("frame_dice").alias("dice"), F.avg("frame_iou").alias("iou"), F.count("*").alias("frames"))


def input_diagnostics(px: DataFrame) -> DataFrame:
    frame = px.groupBy("case_id", "frame_idx").agg(F.min("prob").alias("lo"), F.max("prob").alias("hi"), F.sum("prob").alias("s"), F.sum(F.col("prob") * F.col("prob")).alias("q"), F.count("*").alias("n"), F.max("gt").alias("any"))
    c = frame.groupBy("case_id").agg(F.min("lo").alias("min"), F.max("hi").alias("max"), (F.sum("s") / F.sum("n")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), F.lit(2)))).alias("std"), F.count("*").alias("frames"), F.sum("any").alias("foreground_frames"))
    return c


def stability_score(px: DataFrame, cut: float = 0.5, offset: float = 0.1) -> DataFrame:
    """Mask area above the high cut over the area above the low one."""
    return px.groupBy("case_id").agg(F.try_divide(F.count_if(F.col("prob") > cut + offset).cast("double"), F.count_if(F.col("prob") > cut - offset)).alias("stability"))


def worst_frames(px: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    return per_frame_metrics(px, threshold).where("frame_has_gt").orderBy("frame_dice", "case_id", "frame_idx").limit(k)
