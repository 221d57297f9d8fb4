"""Queries over pixels, probabilities and truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import pixels as P
from maskloom.plans.base import query, rounded
from maskloom.plans.views import PIXELS, pixels

_COUNTS = "count(*) FILTER (prob >= {t} AND gt = 1) AS tp, count(*) FILTER (prob >= {t} AND gt = 0) AS fp, count(*) FILTER (prob < {t} AND gt = 1) AS fn, count(*) FILTER (prob < {t} AND gt = 0) AS tn"
_C5 = _COUNTS.format(t=0.5)
DICE = "CASE WHEN 2 * {p}tp + {p}fp + {p}fn = 0 THEN 1.0 ELSE 2.0 * {p}tp / (2 * {p}tp + {p}fp + {p}fn) END"
IOU = "CASE WHEN {p}tp + {p}fp + {p}fn = 0 THEN 1.0 ELSE 1.0 * {p}tp / ({p}tp + {p}fp + {p}fn) END"
_D, _I = DICE.format(p=""), IOU.format(p="")
FRAMES = f"{PIXELS}, counts AS (SELECT case_id, frame_idx, {_C5} FROM pixels GROUP BY 1, 2), frames AS (SELECT *, {_D} AS frame_dice, {_I} AS frame_iou, tp + fn > 0 AS frame_has_gt, tp + fp > 0 AS frame_has_pred FROM counts)"
_SWEEP = f"{PIXELS}, thr AS (SELECT round(0.05 * k, 2)::DOUBLE AS threshold FROM range(1, 20) r(k)), cells AS (SELECT task, case_id, threshold, {_COUNTS.format(t='threshold')} FROM pixels CROSS JOIN thr GROUP BY 1, 2, 3), sweep AS (SELECT *, {_D} AS dice, {_I} AS iou FROM cells)"


@query(f"WITH {PIXELS} SELECT task, {_C5} FROM pixels GROUP BY 1")
def confusion_counts(spark, sf):
    return P.confusion_counts(pixels(spark, sf), ["task"])


@query(f"WITH {FRAMES} SELECT case_id, frame_idx, tp, fp, fn, tn, round(frame_dice, 6) AS frame_dice, round(frame_iou, 6) AS frame_iou, frame_has_gt, frame_has_pred FROM frames")
def per_frame_metrics(spark, sf):
    return rounded(P.per_frame_metrics(pixels(spark, sf)))


@query(f"WITH {FRAMES} SELECT case_id, round({_D}, 6) AS dice, round({_I}, 6) AS iou, round((2 * tp + 0.000001) / (2 * tp + fp + fn + 0.000001), 6)::DOUBLE AS dice_eps FROM (SELECT case_id, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM frames GROUP BY 1)")
def dice_iou(spark, sf):
    c = P.confusion_counts(pixels(spark, sf), ["case_id"])
    n = F.col("tp"), F.col("fp"), F.col("fn")
    eps = (2 * n[0] + 0.000001) / (2 * n[0] + n[1] + n[2] + 0.000001)
    return rounded(c.select("case_id", P.dice(*n).alias("dice"), P.iou(*n).alias("iou"), eps.alias("dice_eps")))


_CASE = f"""{FRAMES}, c AS (SELECT case_id, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(tn)::DOUBLE AS tn, coalesce(sum(tp) FILTER (frame_has_gt), 0)::DOUBLE AS fg_tp, coalesce(sum(fp) FILTER (frame_has_gt), 0)::DOUBLE AS fg_fp,
  coalesce(sum(fn) FILTER (frame_has_gt), 0)::DOUBLE AS fg_fn, count(*) AS n_frames, count(*) FILTER (frame_has_gt) AS n_fg_frames, avg(frame_dice) FILTER (frame_has_gt) AS fg_mean_frame_dice FROM frames GROUP BY 1)"""


@query(f"""WITH {_CASE} SELECT case_id, n_frames, n_fg_frames, round({_D}, 6) AS full_sequence_dice, round({_I}, 6) AS full_sequence_iou, round({DICE.format(p='fg_')}, 6) AS fg_volume_dice, round({IOU.format(p='fg_')}, 6) AS fg_volume_iou,
  round(fg_mean_frame_dice, 6) AS fg_mean_frame_dice, round(fn / nullif(tp + fn, 0), 6) AS fnr, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity,
  round(1 - coalesce(abs(fp - fn) / nullif(2 * tp + fp + fn, 0), 0), 6) AS volumetric_similarity, tp + fp = 0 AS empty_pred, tp + fn = 0 AS empty_gt, tp + fn > 0 AND tp = 0 AS missed_object, tp + fn = 0 AND fp > 0 AS hallucination FROM c""")
def case_metrics(spark, sf):
    return rounded(P.case_metrics(pixels(spark, sf)))


@query(f"WITH {FRAMES} SELECT case_id, round(avg(CASE WHEN frame_has_pred THEN 1.0 ELSE 0 END), 6)::DOUBLE AS empty_frame_fp_rate, round(sum(tn)::DOUBLE / sum(tn + fp), 6) AS empty_frame_specificity FROM frames WHERE NOT frame_has_gt GROUP BY 1")
def empty_frame_metrics(spark, sf):
    return rounded(P.empty_frame_metrics(pixels(spark, sf)))


@query(f"WITH {_SWEEP} SELECT task, case_id, threshold, tp, fp, fn, tn, round(dice, 6) AS dice, round(iou, 6) AS iou FROM sweep")
def threshold_sweep(spark, sf):
    return rounded(P.threshold_sweep(pixels(spark, sf), ["task", "case_id"]))


@query(f"WITH {_SWEEP} SELECT task, threshold, round(avg(dice), 6) AS dice, round(avg(iou), 6) AS iou FROM sweep GROUP BY 1, 2")
def sweep_by_group(spark, sf):
    s = P.threshold_sweep(pixels(spark, sf), ["task", "case_id"])
    # Wide columns, one per metric and threshold, as results files have them; unpivoted and averaged by group.
    key = F.regexp_replace(F.format_string("thr_%.2f", "threshold"), r"\.", "p")
    names = [f"thr_{t:.2f}".replace(".", "p") for t in P.THRESHOLDS]
    wide = s.withColumn("k", key).groupBy("task", "case_id").pivot("k", names).agg(F.first("dice").alias("dice"), F.first("iou").alias("iou"))
    parts = [F.struct(F.lit(t).alias("threshold"), F.col(f"{n}_dice").alias("dice"), F.col(f"{n}_iou").alias("iou")) for t, n in zip(P.THRESHOLDS, names)]
    long = wide.select("task", F.explode(F.array(*parts)).alias("x"))
    return rounded(long.groupBy("task", F.col("x.threshold").alias("threshold")).agg(F.avg("x.dice").alias("dice"), F.avg("x.iou").alias("iou")))


def _best_sql(score: str) -> str:
    return f"""WITH {_SWEEP}, m AS (SELECT task, threshold, avg({score}) AS {score} FROM sweep GROUP BY 1, 2) SELECT task, threshold, round({score}, 6) AS {score} FROM (
      SELECT *, row_number() OVER (PARTITION BY task ORDER BY round({score}, 12) DESC, round(abs(threshold - 0.5), 9), threshold) AS r FROM m) WHERE r = 1"""


@query(_best_sql("dice"))
def best_threshold(spark, sf):
    return rounded(P.best_threshold(P.threshold_sweep(pixels(spark, sf), ["task", "case_id"]), ["task"], "dice"))


@query(_best_sql("iou"))
def best_threshold_wide(spark, sf):
    return rounded(P.best_threshold(P.threshold_sweep(pixels(spark, sf), ["task", "case_id"]), ["task"], "iou"))


_TRAIN = f"""{PIXELS}, seen AS (SELECT * FROM (SELECT *, max(gt) OVER (PARTITION BY case_id, frame_idx) AS a FROM pixels) WHERE a = 1), thr AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold),
  f AS (SELECT task, case_id, frame_idx, threshold, {_COUNTS.format(t='threshold')} FROM seen CROSS JOIN thr GROUP BY 1, 2, 3, 4), fs AS (SELECT *, {_D} AS d, {_I} AS i FROM f),
  v AS (SELECT task, case_id, threshold, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, avg(d) AS d, avg(i) AS i FROM fs GROUP BY 1, 2, 3)"""


@query(f"WITH {_TRAIN} SELECT task, threshold, round(avg(d), 6) AS slice_dice, round(avg(i), 6) AS slice_iou, round(avg({_D}), 6) AS volume_dice, round(avg({_I}), 6) AS volume_iou FROM v GROUP BY 1, 2")
def training_style_metrics(spark, sf):
    return rounded(P.training_style_metrics(pixels(spark, sf), ["task"], [0.3, 0.5, 0.7]))


@query(f"WITH {PIXELS}, b AS (SELECT task, least(floor(prob * 15), 14) AS bin, count(*) AS n, avg(prob) AS conf, avg(gt) AS acc FROM pixels GROUP BY 1, 2) SELECT task, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def ece(spark, sf):
    return rounded(P.ece(pixels(spark, sf), ["task"]))


_AUC = f"""{PIXELS}, g AS (SELECT task, prob, count(*) FILTER (gt = 1) AS p, count(*) FILTER (gt = 0) AS n FROM pixels GROUP BY 1, 2),
  c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY task ORDER BY prob DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_AUC} SELECT task, round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)::DOUBLE), 6)::DOUBLE AS roc_auc FROM c GROUP BY 1")
def roc_auc(spark, sf):
    return rounded(P.roc_pr_auc(pixels(spark, sf), ["task"]).select("task", F.col("roc_auc").cast("double").alias("roc_auc")))


@query(f"WITH {_AUC} SELECT task, round(sum(p * tp::DOUBLE / (tp + fp)) / sum(p), 6) AS pr_auc FROM c GROUP BY 1")
def pr_auc(spark, sf):
    return rounded(P.roc_pr_auc(pixels(spark, sf), ["task"]).select("task", "pr_auc"))


_SOFT = f"""{PIXELS}, s AS (SELECT case_id, sum(prob * gt) AS pg, sum(prob) AS p, sum(gt)::DOUBLE AS g, avg(-(CASE WHEN gt = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - (CASE WHEN gt = 1 THEN prob ELSE 1 - prob END), 2) * ln(greatest(CASE WHEN gt = 1 THEN prob ELSE 1 - prob END, 1e-12))) AS focal FROM pixels GROUP BY 1)"""


@query(f"WITH {_SOFT} SELECT case_id, round((2 * pg + 1e-6) / (p + g + 1e-6), 6) AS soft_dice FROM s")
def soft_dice(spark, sf):
    return rounded(P.soft_scores(pixels(spark, sf)).select("case_id", "soft_dice"))


@query(f"WITH {_SOFT} SELECT case_id, round((pg + 1e-6) / (pg + 0.3 * (p - pg) + 0.7 * (g - pg) + 1e-6), 6) AS tversky FROM s")
def tversky(spark, sf):
    return rounded(P.soft_scores(pixels(spark, sf)).select("case_id", "tversky"))


@query(f"WITH {_SOFT} SELECT case_id, round(focal, 6) AS focal FROM s")
def focal(spark, sf):
    return rounded(P.soft_scores(pixels(spark, sf)).select("case_id", "focal"))


@query(f"WITH {FRAMES} SELECT CASE WHEN share < 0.001 THEN 0 WHEN share < 0.01 THEN 1 WHEN share < 0.05 THEN 2 WHEN share < 0.2 THEN 3 ELSE 4 END AS fg_bin, round(avg(frame_dice), 6) AS dice, round(avg(frame_iou), 6) AS iou, count(*) AS frames FROM (SELECT *, (tp + fn) / (tp + fp + fn + tn)::DOUBLE AS share FROM frames) GROUP BY 1")
def fg_bin_metrics(spark, sf):
    return rounded(P.fg_bin_metrics(pixels(spark, sf)))


@query(f"WITH {PIXELS} SELECT case_id, round(min(prob), 6) AS min, round(max(prob), 6) AS max, round(avg(prob), 6) AS mean, round(stddev_pop(prob), 6) AS std, count(DISTINCT frame_idx) AS frames, count(DISTINCT CASE WHEN gt = 1 THEN frame_idx END) AS foreground_frames FROM pixels GROUP BY 1")
def input_diagnostics(spark, sf):
    return rounded(P.input_diagnostics(pixels(spark, sf)))


@query(f"WITH {PIXELS} SELECT case_id, round(count(*) FILTER (prob > 0.6)::DOUBLE / nullif(count(*) FILTER (prob > 0.4), 0), 6) AS stability FROM pixels GROUP BY 1")
def stability_score(spark, sf):
    return rounded(P.stability_score(pixels(spark, sf)))


@query(f"WITH {FRAMES} SELECT case_id, frame_idx, round(frame_dice, 6) AS frame_dice FROM frames WHERE frame_has_gt ORDER BY frame_dice, case_id, frame_idx LIMIT 25")
def worst_frames(spark, sf):
    return rounded(P.worst_frames(pixels(spark, sf), 25).select("case_id", "frame_idx", "frame_dice"))


@query(f"WITH {FRAMES}, w AS (SELECT case_id FROM frames WHERE frame_has_gt GROUP BY 1 ORDER BY avg(frame_dice), case_id LIMIT 5) SELECT case_id, frame_idx, round(frame_dice, 6) AS frame_dice FROM frames JOIN w USING (case_id)")
def frame_curve(spark, sf):
    f = P.per_frame_metrics(pixels(spark, sf))
    worst = f.where("frame_has_gt").groupBy("case_id").agg(F.avg("frame_dice").alias("m")).orderBy("m", "case_id").limit(5)
    return rounded(f.join(worst, "case_id").select("case_id", "frame_idx", "frame_dice"))


@query(f"WITH {FRAMES} SELECT task, round(avg(dice), 6) AS dice, round(avg(iou), 6) AS iou, count(*) AS n FROM (SELECT case_id, avg(frame_dice) AS dice, avg(frame_iou) AS iou FROM frames GROUP BY 1) JOIN (SELECT vec_id AS case_id, label AS task FROM embeddings) USING (case_id) GROUP BY 1")
def group_best_means(spark, sf):
    px = pixels(spark, sf)
    f = P.per_frame_metrics(px).groupBy("case_id").agg(F.avg("frame_dice").alias("dice"), F.avg("frame_iou").alias("iou"))
    return rounded(f.join(px.select("case_id", "task").distinct(), "case_id").groupBy("task").agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"), F.count("*").alias("n")))


@query(f"WITH {PIXELS} SELECT case_id, frame_idx, px, round(least(greatest(ln(prob / (1 - prob)), -8), 8), 6) AS logit, round(1 / (1 + exp(-least(greatest(ln(prob / (1 - prob)), -8), 8))), 6) AS sigmoid FROM pixels")
def sigmoid(spark, sf):
    x = pixels(spark, sf).withColumn("logit", F.least(F.greatest(F.ln(F.col("prob") / (1 - F.col("prob"))), F.lit(-8.0)), F.lit(8.0)))
    return rounded(x.select("case_id", "frame_idx", "px", "logit", (1 / (1 + F.exp(-F.col("logit")))).alias("sigmoid")))


@query("SELECT DISTINCT 'dice_thr_' || replace(printf('%.2f', 0.05 * k), '.', 'p') AS threshold_key FROM range(1, 20) r(k) WHERE EXISTS (SELECT 1 FROM embeddings)")
def threshold_key(spark, sf):
    s = P.threshold_sweep(pixels(spark, sf), ["task"])
    return s.select(F.regexp_replace(F.format_string("dice_thr_%.2f", "threshold"), r"\.", "p").alias("threshold_key")).distinct()
