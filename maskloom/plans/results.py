"""Queries over evaluation results."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import results as R
from maskloom.plans.base import query, rounded
from maskloom.plans.views import CASES, LOG, OK, case_results, log

METRICS = ["dice", "iou", "wall_time_sec"]
_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)


def _ok(spark, sf):
    return R.status_split(case_results(spark, sf))[0]


@query(f"WITH {CASES} SELECT model, prompt_mode, dataset_index, seq, wall_time_sec / n_frames AS sec_per_frame, n_frames / wall_time_sec AS frames_per_sec, memory_peak_mb / n_frames AS memory_mb_per_frame, model || ' / ' || prompt_mode AS run_label, 'unknown' AS task_label FROM cases")
def normalize_results(spark, sf):
    out = R.normalize_results(case_results(spark, sf), ["dice", "iou", "wall_time_sec", "n_frames", "memory_peak_mb"])
    return (out.select("model", "prompt_mode", "dataset_index", "seq", "sec_per_frame", "frames_per_sec", "memory_mb_per_frame", "run_label", "task_label"))


@query(f"WITH {CASES} SELECT status = 'ok' AS is_ok, count(*) AS rows FROM cases GROUP BY 1")
def status_split(spark, sf):
    ok, rest = R.status_split(case_results(spark, sf))
    return ok.agg(F.lit(True).alias("is_ok"), F.count("*").alias("rows")).unionByName(rest.agg(F.lit(False).alias("is_ok"), F.count("*").alias("rows")))


@query(f"""WITH {CASES} SELECT CASE WHEN status <> 'ok' THEN 'status' WHEN dim NOT IN (3) THEN 'dim' WHEN model NOT IN ('A', 'N') THEN 'model' WHEN prompt_mode NOT IN ('F') THEN 'prompt'
  WHEN dataset_name IN ('Brand#1', 'Brand#2', 'Brand#3') THEN NULL ELSE 'dataset' END AS skip_reason, count(*) AS rows FROM cases GROUP BY 1 HAVING skip_reason IS NOT NULL""")
def result_filter(spark, sf):
    return R.result_filter(case_results(spark, sf), dims=[3], models=["A", "N"], prompts=["F"], datasets=["Brand#1", "Brand#2", "Brand#3"])[1]


@query(f"WITH {CASES} SELECT count(*) AS before, count(*) FILTER (dataset_name <> 'Brand#7') AS after, count(*) FILTER (dataset_name = 'Brand#7') AS removed FROM cases")
def exclude_dataset(spark, sf):
    return R.exclude_dataset(case_results(spark, sf), "Brand#7")[1]


@query(f"WITH {CASES} SELECT seq, status, CASE fp % 4 WHEN 0 THEN 'true' WHEN 1 THEN '1.0' WHEN 2 THEN 'no' END AS strict_ok FROM cases WHERE status <> 'ok' OR fp % 4 >= 2")
def audit_bad_rows(spark, sf):
    flag = F.when(F.col("fp") % 4 == 0, "true").when(F.col("fp") % 4 == 1, "1.0").when(F.col("fp") % 4 == 2, "no")
    return R.audit_bad_rows(case_results(spark, sf).withColumn("strict_ok", flag), "strict_ok").select("seq", "status", "strict_ok")


@query(f"WITH {CASES} SELECT model, prompt_mode, protocol, status, count(*) AS rows FROM cases GROUP BY ALL")
def status_summary(spark, sf):
    return R.status_summary(case_results(spark, sf))


@query(f"WITH {OK} SELECT modality, count(DISTINCT case_id) AS n_cases FROM ok GROUP BY 1")
def ok_cases_by_modality(spark, sf):
    return _ok(spark, sf).groupBy("modality").agg(F.countDistinct("case_id").alias("n_cases"))


@query(f"WITH {OK} SELECT model, prompt_mode, {_AVG}, count(DISTINCT case_id) AS n_cases FROM ok GROUP BY 1, 2")
def case_micro_summary(spark, sf):
    return rounded(R.case_micro_summary(_ok(spark, sf), ["model", "prompt_mode"], METRICS))


_MACRO = f"macro AS (SELECT model, prompt_mode, avg(dice) AS dice, avg(iou) AS iou, avg(wall_time_sec) AS wall_time_sec, count(*) AS n_datasets, (SELECT count(DISTINCT case_id) FROM ok o WHERE o.model = p.model AND o.prompt_mode = p.prompt_mode) AS n_cases FROM (SELECT model, prompt_mode, dataset_name, avg(dice) AS dice, avg(iou) AS iou, avg(wall_time_sec) AS wall_time_sec FROM ok GROUP BY 1, 2, 3) p GROUP BY 1, 2)"


@query(f"WITH {OK}, {_MACRO} SELECT model, prompt_mode, round(dice, 6) AS dice, round(iou, 6) AS iou, round(wall_time_sec, 6) AS wall_time_sec, n_datasets, n_cases FROM macro")
def dataset_macro_summary(spark, sf):
    return rounded(R.dataset_macro_summary(_ok(spark, sf), ["model", "prompt_mode"], METRICS))


@query(f"WITH {OK}, {_MACRO} SELECT model, prompt_mode, round(dice, 6) AS dice, n_cases, CAST(row_number() OVER (ORDER BY dice DESC NULLS LAST, model) AS INT) AS rank FROM macro WHERE prompt_mode = 'F'")
def ranking(spark, sf):
    macro = R.dataset_macro_summary(_ok(spark, sf), ["model", "prompt_mode"], METRICS).where("prompt_mode = 'F'")
    return rounded(R.ranking(macro, "dice").select("model", "prompt_mode", "dice", "n_cases", "rank"))


@query(f"""WITH {OK} SELECT model, level, value, {_AVG}, count(*) AS rows FROM (SELECT *, unnest([{{'level': 'overall', 'value': 'all'}}, {{'level': 'dataset_name', 'value': dataset_name}}, {{'level': 'modality', 'value': modality}}, {{'level': 'task_id', 'value': task_id}}], recursive := true) FROM ok) GROUP BY 1, 2, 3""")
def group_breakdowns(spark, sf):
    return rounded(R.group_breakdowns(_ok(spark, sf), ["model"], ["dataset_name", "modality", "task_id"], METRICS))


@query(f"WITH {OK} SELECT model, round(avg(memory_baseline_mb), 6) AS memory_baseline_mb_mean, max(memory_baseline_mb) AS memory_baseline_mb_max, round(avg(memory_peak_mb), 6) AS memory_peak_mb_mean, round(max(memory_peak_mb), 6) AS memory_peak_mb_max FROM ok GROUP BY 1")
def memory_summary(spark, sf):
    return rounded(R.memory_summary(_ok(spark, sf), ["model"], ["memory_baseline_mb", "memory_peak_mb"]))


@query(f"""WITH {OK}, bins AS (SELECT * FROM (VALUES ('1', 0, 0, 1), ('2-8', 1, 1, 8), ('9-32', 2, 8, 32), ('33-96', 3, 32, 96), ('97-192', 4, 96, 192), ('193+', 5, 192, 10000)) t(frame_bin, bin_order, lo, hi)),
  rest AS (SELECT * FROM ok WHERE n_frames <> 1)
  SELECT m.model, frame_bin, bin_order, round(avg(wall_time_sec), 6) AS wall_time_sec, count(s.model) AS rows FROM (SELECT DISTINCT model FROM rest) m CROSS JOIN bins LEFT JOIN rest s ON s.model = m.model AND s.n_frames > lo AND s.n_frames <= hi GROUP BY 1, 2, 3""")
def efficiency_bins(spark, sf):
    return rounded(R.efficiency_bins(_ok(spark, sf).where("n_frames <> 1"), ["model"], ["wall_time_sec"]))


@query(f"""WITH {CASES} SELECT model, count(*) AS rows, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed, count(iou) FILTER (status = 'ok') AS n, round(avg(iou) FILTER (status = 'ok'), 6) AS mean,
  round(quantile_cont(iou, 0.5) FILTER (status = 'ok'), 6) AS median, round(coalesce(stddev_samp(iou) FILTER (status = 'ok'), 0), 6) AS std, round(quantile_cont(iou, 0.75) FILTER (status = 'ok') - quantile_cont(iou, 0.25) FILTER (status = 'ok'), 6) AS iqr FROM cases GROUP BY 1""")
def dist_summary(spark, sf):
    return rounded(R.dist_summary(case_results(spark, sf), ["model"], "iou"))


_PAIRS = f"{OK}, last AS (SELECT dataset_name, case_id, prompt_mode, model, arg_max(dice, seq) AS dice FROM ok GROUP BY ALL), pairs AS (SELECT a.dataset_name, a.case_id, a.prompt_mode, a.dice AS left_value, b.dice AS right_value, b.dice - a.dice AS delta FROM last a JOIN last b USING (dataset_name, case_id, prompt_mode) WHERE a.model = 'A' AND b.model = 'R')"


@query(f"WITH {_PAIRS} SELECT dataset_name, case_id, prompt_mode, left_value, right_value, round(delta, 6) AS delta FROM pairs")
def paired_model_diff_join(spark, sf):
    return rounded(R.paired_model_diff(_ok(spark, sf), "A", "R", "dice", "seq"))


@query(f"""WITH {_PAIRS} SELECT prompt_mode, count(*) AS pairs, round(avg(delta), 6) AS delta_mean, round(quantile_cont(delta, 0.5), 6) AS delta_median, round(coalesce(stddev_samp(delta), 0), 6) AS delta_std,
  round(quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25), 6) AS delta_iqr, round(avg(CASE WHEN delta > 0 THEN 100.0 ELSE 0 END), 6) AS right_better_pct, round(avg(CASE WHEN delta < 0 THEN 100.0 ELSE 0 END), 6) AS left_better_pct,
  round(avg(CASE WHEN abs(delta) <= 0.05 THEN 100.0 ELSE 0 END), 6) AS within_1_pct, round(avg(CASE WHEN abs(delta) <= 0.15 THEN 100.0 ELSE 0 END), 6) AS within_2_pct FROM pairs GROUP BY 1""")
def paired_model_diff(spark, sf):
    return rounded(R.paired_summary(R.paired_model_diff(_ok(spark, sf), "A", "R", "dice", "seq"), ["prompt_mode"], (0.05, 0.15)))


@query(f"WITH {OK} SELECT dataset_name, round(avg(dice), 6) AS dice, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ok GROUP BY 1")
def aggregate_mixed(spark, sf):
    return rounded(R.aggregate_mixed(_ok(spark, sf), ["dataset_name"], ["dice"], ["tp", "fp", "fn"]))


_DISTINCT = f"{CASES}, one AS (SELECT DISTINCT dim, dataset_name, dataset_index FROM cases)"


def _cases(spark, sf):
    return case_results(spark, sf).select("dim", "dataset_name", "dataset_index").distinct()


@query(f"""WITH {_DISTINCT} SELECT dim, dataset_name, dataset_index, row_number() OVER (ORDER BY dim, lower(dataset_name), dataset_name, dataset_index) AS benchmark_order, CAST(row_number() OVER d AS INT) AS dataset_case_number, count(*) OVER (PARTITION BY dim, dataset_name) AS dataset_case_total,
  round(row_number() OVER d * 100.0 / count(*) OVER (PARTITION BY dim, dataset_name), 6)::DOUBLE AS dataset_percent, row_number() OVER (PARTITION BY dim ORDER BY lower(dataset_name), dataset_name, dataset_index) AS phase_number, count(*) OVER (PARTITION BY dim) AS phase_total
  FROM one WINDOW d AS (PARTITION BY dim, dataset_name ORDER BY dataset_index)""")
def case_progress(spark, sf):
    out = R.case_progress(_cases(spark, sf))
    return out.withColumn("dataset_percent", F.round(F.col("dataset_percent").cast("double"), 6))


@query(f"WITH {_DISTINCT} SELECT dim, dataset_name, dataset_index FROM one ORDER BY dim, lower(dataset_name), dataset_index")
def phase_sort(spark, sf):
    return R.phase_sort(_cases(spark, sf))


@query(f"WITH {CASES} SELECT dataset_name, min(seq) AS first_order, CAST(row_number() OVER (ORDER BY min(seq)) AS INT) AS dataset_position FROM cases GROUP BY 1")
def dataset_order(spark, sf):
    return R.dataset_order(case_results(spark, sf), "seq")


@query(f"WITH {OK} SELECT dataset_name, case_id, arg_max(dice, seq) AS dice, max(seq) AS seq FROM ok GROUP BY 1, 2")
def dedup_last(spark, sf):
    return R.dedup_last(_ok(spark, sf).withColumn("o", F.col("seq")).select("dataset_name", "case_id", "dice", "seq", "o"), ["dataset_name", "case_id"], "o").drop("o")


@query(f"WITH {OK} SELECT dataset_name, case_id, arg_min(dice, seq) AS dice, min(seq) AS seq FROM ok GROUP BY 1, 2")
def dedup_first(spark, sf):
    return R.dedup_first(_ok(spark, sf).withColumn("o", F.col("seq")).select("dataset_name", "case_id", "dice", "seq", "o"), ["dataset_name", "case_id"], "o").drop("o")


@query(f"""WITH {_DISTINCT}, a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY dataset_name, dim ORDER BY dataset_index) > 1 THEN 1 ELSE 0 END AS later FROM one),
  b AS (SELECT dim, dataset_name, dataset_index, row_number() OVER (PARTITION BY dataset_name ORDER BY later, dim DESC, dataset_index) AS pick FROM a)
  SELECT dim, dataset_name, dataset_index, CAST(pick AS INT) AS pick, 3 - count(*) OVER (PARTITION BY dataset_name) AS short FROM b WHERE pick <= 3""")
def per_dataset_head(spark, sf):
    return R.per_dataset_head(_cases(spark, sf), 3)


@query(f"WITH {_DISTINCT} SELECT * FROM (SELECT dim, dataset_name, dataset_index, CAST(row_number() OVER (PARTITION BY dim ORDER BY dataset_index) AS INT) AS pick FROM one) WHERE pick <= 5")
def first_per_dim(spark, sf):
    return R.first_per_dim(_cases(spark, sf), 5)


@query(f"WITH {OK} SELECT case_id, model, seq, dice FROM ok ORDER BY dice, seq LIMIT 20")
def worst_cases(spark, sf):
    return _ok(spark, sf).select("case_id", "model", "seq", "dice").orderBy("dice", "seq").limit(20)


@query(f"WITH {OK} SELECT case_id, model, seq, dice FROM ok ORDER BY dice DESC, seq LIMIT 20")
def best_cases(spark, sf):
    return _ok(spark, sf).select("case_id", "model", "seq", "dice").orderBy(F.desc("dice"), "seq").limit(20)


@query(f"WITH {OK} SELECT case_id, seq, iou FROM ok ORDER BY CASE WHEN dim = 3 THEN 0 ELSE 1 END, dice DESC, wall_time_sec, n_frames DESC, dataset_name, seq LIMIT 10")
def diagnostic_topk(spark, sf):
    return _ok(spark, sf).orderBy(F.when(F.col("dim") == 3, 0).otherwise(1), F.desc("dice"), "wall_time_sec", F.desc("n_frames"), "dataset_name", "seq").limit(10).select("case_id", "seq", "iou")


@query(f"WITH {OK} SELECT dataset_name, round(avg(dice) FILTER (model = 'A'), 6) AS A, round(avg(dice) FILTER (model = 'N'), 6) AS N, round(avg(dice) FILTER (model = 'R'), 6) AS R, round((avg(dice) FILTER (model = 'A') + avg(dice) FILTER (model = 'N') + avg(dice) FILTER (model = 'R')) / 3, 6) AS row_mean FROM ok GROUP BY 1 ORDER BY 5 DESC, 1 LIMIT 10")
def score_pivot(spark, sf):
    return rounded(R.score_pivot(_ok(spark, sf), "dataset_name", "model", "dice", ["A", "N", "R"], 10))


@query(f"WITH {CASES} SELECT 'dim' AS field, CAST(dim AS VARCHAR) AS value, count(*) AS rows FROM cases GROUP BY 2 UNION ALL (SELECT 'modality', modality, count(*) AS n FROM cases GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) UNION ALL (SELECT 'dataset_name', dataset_name, count(*) AS n FROM cases GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)")
def run_summary(spark, sf):
    c = case_results(spark, sf)
    return R.run_summary(c, "dim").unionByName(R.run_summary(c, "modality", 10)).unionByName(R.run_summary(c, "dataset_name", 10))


@query(f"WITH {OK}, axes AS (SELECT DISTINCT dataset_name, case_id FROM cases) SELECT dataset_name, case_id, model, prompt_mode FROM axes CROSS JOIN (SELECT DISTINCT model FROM cases) CROSS JOIN (SELECT DISTINCT prompt_mode FROM cases) ANTI JOIN ok USING (dataset_name, case_id, model, prompt_mode)")
def pending_anti_join(spark, sf):
    c = case_results(spark, sf)
    grid = [c.select("dataset_name", "case_id").distinct(), c.select("model").distinct(), c.select("prompt_mode").distinct()]
    return R.pending(grid, _ok(spark, sf), ["dataset_name", "case_id", "model", "prompt_mode"])


@query(f"WITH {OK} SELECT 'old' AS origin, count(*) AS rows, NULL::BIGINT AS attempt_sum FROM ok WHERE seq % 2 = 0 UNION ALL SELECT 'new', count(*), CAST(sum(seq % 3) AS BIGINT) FROM ok WHERE seq % 2 = 1")
def union_resume(spark, sf):
    ok = _ok(spark, sf)
    old, new = ok.where("seq % 2 = 0").withColumn("origin", F.lit("old")), ok.where("seq % 2 = 1").withColumn("origin", F.lit("new")).withColumn("attempt", F.col("seq") % 3)
    return old.unionByName(new, allowMissingColumns=True).groupBy("origin").agg(F.count("*").alias("rows"), F.sum("attempt").alias("attempt_sum"))


@query(f"WITH {OK} SELECT DISTINCT model FROM ok WHERE dim = 3 AND prompt_mode = 'O'")
def active_models(spark, sf):
    return _ok(spark, sf).where("dim = 3 and prompt_mode = 'O'").select("model").distinct()


@query(f"""WITH {LOG}, n AS (SELECT *, count(*) OVER (PARTITION BY model, dataset) AS total, row_number() OVER (PARTITION BY model, dataset ORDER BY event_id) AS pos FROM log),
  b AS (SELECT *, least(floor(pos * 100.0 / total / 10), 10) AS bucket FROM n), c AS (SELECT *, coalesce(lag(bucket) OVER (PARTITION BY model, dataset ORDER BY event_id), 0) AS prev FROM b)
  SELECT model, dataset, event_id, CAST(bucket AS BIGINT) AS bucket FROM c WHERE bucket > prev""")
def milestones(spark, sf):
    x = log(spark, sf)
    total = x.groupBy("model", "dataset").agg(F.count("*").alias("total"))
    return R.milestones(x.join(total, ["model", "dataset"]), ["model", "dataset"], "event_id", "total").select("model", "dataset", "event_id", F.col("bucket").cast("long").alias("bucket"))


@query(f"""WITH {OK} SELECT task_id, round(sum(dice * n_frames) / greatest(1, sum(n_frames)), 6) AS dice_slice, round(sum(iou * n_frames) / greatest(1, sum(n_frames)), 6) AS iou_slice, round(avg(dice), 6) AS dice_volume, round(avg(iou), 6) AS iou_volume, round(avg(CASE WHEN dim = 3 THEN 1.0 ELSE 0 END), 6) AS share_3d FROM ok GROUP BY 1""")
def weighted_group_metrics(spark, sf):
    x = _ok(spark, sf).withColumn("one", F.lit(1.0)).withColumn("n_frames", F.col("n_frames").cast("double"))
    return rounded(R.weighted_group_metrics(x, "task_id", ["dice", "iou"], {"slice": "n_frames", "volume": "one"}))


@query(f"""WITH {CASES}, s AS (SELECT seq, CAST(memory_baseline_mb * 997 AS DOUBLE) AS x FROM cases), r AS (SELECT seq, CAST(round_even(x, 0) AS BIGINT) AS t FROM s)
  SELECT seq, CASE WHEN t >= 86400 THEN printf('%dd %02dh %02dm', t // 86400, t % 86400 // 3600, t % 3600 // 60) WHEN t >= 3600 THEN printf('%dh %02dm %02ds', t // 3600, t % 3600 // 60, t % 60) WHEN t >= 60 THEN printf('%dm %02ds', t // 60, t % 60) ELSE printf('%ds', t) END AS duration FROM r""")
def format_duration(spark, sf):
    return case_results(spark, sf).select("seq", R.format_duration(F.col("memory_baseline_mb") * 997).alias("duration"))
