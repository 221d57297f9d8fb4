"""Queries over intensities, samples, schedules and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.keys import unit
from maskloom.operators import profiles as P
from maskloom.operators import sampling as S
from maskloom.plans.base import query, rounded
from maskloom.plans.views import PIXELS, SEQUENCES, pixels, sequences, table


def U(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


VALUES = "values_ AS (SELECT l_suppkey AS volume, s_nationkey AS subdataset, CASE WHEN l_tax = 0 THEN 0.0 ELSE l_extendedprice END AS value, l_orderkey * 8 + l_linenumber AS vox FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def values(spark, sf):
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    return li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("l_suppkey").alias("volume"), F.col("s_nationkey").alias("subdataset"), F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("vox"))


@query(f"WITH {VALUES} SELECT subdataset, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM values_ WHERE value <> 0 GROUP BY 1")
def welford_stats(spark, sf):
    w = P.welford(values(spark, sf).where("value <> 0"), ["subdataset"], "value")
    return rounded(w.select("subdataset", F.col("n").alias("count"), "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std")), 4)


@query(f"WITH {VALUES} SELECT subdataset, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM values_ WHERE value <> 0 GROUP BY 1")
def welford_merge(spark, sf):
    parts = P.welford(values(spark, sf).where("value <> 0"), ["subdataset", "volume"], "value")
    return rounded(P.welford_merge(parts, ["subdataset"]), 4)


@query(f"WITH {VALUES}, f AS (SELECT subdataset, volume, count(*) FILTER (value <> 0) AS fg, volume % 13 = 0 AS failed FROM values_ GROUP BY 1, 2) SELECT subdataset, count(*) FILTER (NOT failed AND fg > 0) AS success, count(*) FILTER (NOT failed AND fg = 0) AS empty_foreground, count(*) FILTER (failed) AS failed, round(count(*) FILTER (failed)::DOUBLE / count(*), 6) AS failure_rate FROM f GROUP BY 1")
def profile_counts(spark, sf):
    f = values(spark, sf).groupBy("subdataset", "volume").agg(F.count_if(F.col("value") != 0).alias("fg")).withColumn("failed", F.col("volume") % 13 == 0)
    return rounded(f.groupBy("subdataset").agg(F.count_if(~F.col("failed") & (F.col("fg") > 0)).alias("success"), F.count_if(~F.col("failed") & (F.col("fg") == 0)).alias("empty_foreground"), F.count_if("failed").alias("failed"), F.avg(F.col("failed").cast("double")).alias("failure_rate")).select("subdataset", "success", "empty_foreground", "failed", "failure_rate"))


@query(f"WITH {VALUES} SELECT subdataset, round(quantile_cont(value, 0.005), 6) AS window_lower, round(quantile_cont(value, 0.995), 6) AS window_upper FROM values_ WHERE value <> 0 GROUP BY 1")
def percentile_window(spark, sf):
    return rounded(P.percentile_window(values(spark, sf).where("value <> 0"), ["subdataset"], "value"))


_FG = f"""{VALUES}, q AS (SELECT volume, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM values_ WHERE value <> 0 GROUP BY 1),
  st AS (SELECT volume, any_value(lo) AS lo, any_value(hi) AS hi, avg(greatest(least(value, hi), lo)) AS mean, stddev_pop(greatest(least(value, hi), lo)) AS std FROM values_ JOIN q USING (volume) WHERE value <> 0 GROUP BY 1)"""


@query(f"WITH {_FG} SELECT volume, round(lo, 4) AS window_lower, round(hi, 4) AS window_upper, round(mean, 4) AS mean, round(std, 4) AS std FROM st")
def foreground_zscore_stats(spark, sf):
    return rounded(P.foreground_stats(values(spark, sf), "volume", "value"), 4)


@query(f"WITH {_FG} SELECT volume, count(*) AS n, round(sum(z), 3) AS total, round(sum(z * z), 3) AS squares FROM (SELECT volume, CASE WHEN value = 0 THEN 0 WHEN std > 0 THEN (greatest(least(value, hi), lo) - mean) / std ELSE greatest(least(value, hi), lo) - mean END AS z FROM values_ LEFT JOIN st USING (volume)) GROUP BY 1")
def mri_zscore(spark, sf):
    z = P.mri_zscore(values(spark, sf), "volume", "value")
    return rounded(z.groupBy("volume").agg(F.count("*").alias("n"), F.sum("z").alias("total"), F.sum(F.col("z") * F.col("z")).alias("squares")), 3).withColumn("total", F.col("total") + 0.0)


@query(f"WITH {VALUES}, w AS (SELECT subdataset, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi, avg(value) AS mean, stddev_pop(value) AS std FROM values_ GROUP BY 1) SELECT vox, volume, round((greatest(least(value, hi), lo) - mean) / std, 6) AS z FROM values_ JOIN w USING (subdataset)")
def window_zscore(spark, sf):
    return rounded(P.window_zscore(values(spark, sf), "subdataset", "value").select("vox", "volume", "z"))


@query(f"WITH {VALUES}, q AS (SELECT volume, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM values_ GROUP BY 1) SELECT vox, volume, round(CASE WHEN hi > lo THEN least(1.0, greatest(0.0, (value - lo) / (hi - lo))) ELSE 0 END, 6) AS scaled FROM values_ JOIN q USING (volume)")
def robust_01(spark, sf):
    return rounded(P.robust_01(values(spark, sf), "volume", "value").select("vox", "volume", "scaled"))


@query(f"WITH {VALUES}, q AS (SELECT volume, min(value) AS lo, max(value) AS hi FROM values_ GROUP BY 1) SELECT vox, volume, CAST(CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 255) ELSE 0 END AS INT) AS byte FROM values_ JOIN q USING (volume)")
def to_uint8(spark, sf):
    return P.to_uint8(values(spark, sf), "volume", "value").select("vox", "volume", "byte")


@query("SELECT s, v, CAST(CASE WHEN v = 0 THEN 0 ELSE row_number() OVER (PARTITION BY s ORDER BY CASE WHEN v = 0 THEN 0 ELSE 1 END, v) - max(CASE WHEN v = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s) END AS INT) AS dense FROM (SELECT DISTINCT l_suppkey AS s, CAST(l_quantity AS INT) % 9 * 5 AS v FROM lineitem)")
def label_map(spark, sf):
    return P.label_map(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_quantity").cast("int") % 9 * 5).alias("v")), "s", "v")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 7 = 0 THEN 'space' WHEN s_nationkey % 5 = 0 THEN 'not_finite' WHEN s_acctbal <= 100 THEN 'window' WHEN s_suppkey % 11 = 0 THEN 'std' WHEN s_suppkey % 13 > 10 THEN 'counts' END AS reason FROM supplier")
def profile_validate(spark, sf):
    s = table(spark, sf, "supplier")
    n = F.col("s_suppkey")
    space, hi = F.when(F.col("s_nationkey") % 7 != 0, "hu"), F.when(F.col("s_nationkey") % 5 == 0, float("nan")).otherwise(F.col("s_acctbal"))
    return s.select("s_suppkey", P.profile_reason(F.lit(100.0), hi, (n % 11).cast("double"), F.lit(5), F.lit(10), n % 13, space).alias("reason"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'default' ELSE p_brand END AS profile, CASE WHEN p_size % 4 = 0 THEN 0 WHEN substr(p_brand, 7)::INT <= 12 THEN substr(p_brand, 7)::INT END AS level FROM part")
def profile_select(spark, sf):
    levels = [("default", 0), *[(f"Brand#{i}", i) for i in range(1, 13)]]
    prof = spark.createDataFrame(levels, "profile_name string, level int")
    img = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("subdataset"))
    return P.profile_select(img, prof).select("p_partkey", F.col("subdataset_key").alias("profile"), "level")


@query(f"WITH {VALUES}, u AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY {U('vox', 3)}, vox, value) AS r FROM values_) SELECT volume, count(*) AS n, round(sum(value), 3) AS total FROM u WHERE r <= 40 GROUP BY 1")
def per_file_cap_sample(spark, sf):
    x = P.per_file_cap(values(spark, sf), "volume", F.struct(unit(F.col("vox"), 3), "vox", "value"), 40)
    return rounded(x.groupBy("volume").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 3)


@query("WITH n AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_name) AS position, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, position FROM n WHERE position - 1 IN (SELECT CAST(round_even(i * (n - 1) / 6.0, 0) AS BIGINT) FROM range(0, 7) r(i))")
def evenly_spaced_sample(spark, sf):
    return P.evenly_spaced(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_name", 7).select("s_suppkey", "position")


@query(f"WITH {SEQUENCES} SELECT idx, CASE WHEN row_number() OVER (PARTITION BY dataset, subdataset ORDER BY {U('idx', 1)}, idx) <= floor(count(*) OVER (PARTITION BY dataset, subdataset) * 0.2) THEN 'val' ELSE 'train' END AS split FROM sequences")
def exact_fraction_split(spark, sf):
    return S.exact_fraction_split(sequences(spark, sf), ["dataset", "subdataset"], "idx", 0.2, 1).select("idx", "split")


@query(f"WITH {SEQUENCES} SELECT idx FROM sequences ORDER BY {U('idx', 5)}, idx LIMIT 100")
def deterministic_subset(spark, sf):
    return S.deterministic_subset(sequences(spark, sf).select("idx"), "idx", 100, 5)


@query(f"WITH {SEQUENCES} SELECT idx, dataset FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {U('idx', 2)}, idx) AS r FROM sequences) WHERE r <= 4")
def max_groups_sample(spark, sf):
    return S.max_groups(sequences(spark, sf).select("idx", "dataset"), ["dataset"], "idx", 4, 2)


@query(f"WITH {SEQUENCES} SELECT idx, dataset FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(-ln(greatest({U('idx', 4)}, 1e-12)) / (idx % 9 + 1), 9), idx) AS r FROM sequences) WHERE r <= 5")
def weighted_sample(spark, sf):
    return S.weighted_sample(sequences(spark, sf).select("idx", "dataset"), ["dataset"], "idx", F.col("idx") % 9 + 1, 5, 4)


_BUCKETS = f"{SEQUENCES}, b AS (SELECT task, count(*) AS n FROM (SELECT unnest(tasks) AS task FROM sequences) GROUP BY 1)"


# The rule as stated: floors at most the capacity; over the target the largest give back; else shares of the capacity left, rounded down, then by remainder.
_QUOTAS = """caps AS (SELECT task, CASE WHEN task IN ('k0', 'j1') THEN n % 7 ELSE n END AS n, target FROM b CROSS JOIN (VALUES (777), (60)) t(target)),
  fl AS (SELECT *, least(20, n) AS f FROM caps), us AS (SELECT *, sum(f) OVER (PARTITION BY target) AS used, sum(n - f) OVER (PARTITION BY target) AS free, coalesce(sum(f) OVER (PARTITION BY target ORDER BY f DESC, task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM fl),
  rw AS (SELECT *, (target - used) * (n - f)::DOUBLE / nullif(free, 0) AS raw FROM us), dn AS (SELECT *, CASE WHEN used < target THEN least(n - f, floor(raw)) ELSE 0 END AS d FROM rw),
  lf AS (SELECT *, target - sum(f + d) OVER (PARTITION BY target) AS spare FROM dn), od AS (SELECT *, row_number() OVER (PARTITION BY target, f + d < n ORDER BY round(raw - floor(raw), 9) DESC, n - f DESC, task) AS turn FROM lf)"""


@query(f"""WITH {_BUCKETS}, {_QUOTAS} SELECT task, n, target, CAST(CASE WHEN used > target THEN f - greatest(0, least(f, used - target - ahead)) WHEN f + d < n AND turn <= spare THEN f + d + 1 ELSE f + d END AS BIGINT) AS quota FROM od""")
def largest_remainder(spark, sf):
    """With floors of 20, two buckets under the floor, and two targets: one over and one under the sum of the floors."""
    b = sequences(spark, sf).select(F.explode("tasks").alias("task")).groupBy("task").agg(F.count("*").alias("n"))
    b = b.withColumn("n", F.when(F.col("task").isin("k0", "j1"), F.col("n") % 7).otherwise(F.col("n")))
    each = [S.largest_remainder(b, "n", target, 20).withColumn("target", F.lit(target)) for target in (777, 60)]
    return each[0].unionByName(each[1])


_ITEMS = f"{SEQUENCES}, items AS (SELECT idx, dim, unnest(CASE WHEN idx % 5 = 0 THEN tasks[1:1] ELSE tasks END) AS task FROM sequences)"


def _items(spark, sf):
    """Items with their buckets: every fifth has one only."""
    tasks = F.when(F.col("idx") % 5 == 0, F.slice("tasks", 1, 1)).otherwise(F.col("tasks"))
    return sequences(spark, sf).select("idx", "dim", F.explode(tasks).alias("task"))


_SLOTS, _KEY = 8, "'' || idx || '|' || task"


def _turns() -> str:
    """The turns one after another: the fill that the earlier ones have left decides."""
    done, out = "SELECT NULL::BIGINT AS idx, NULL::INT AS dim, NULL AS task WHERE false", []
    for t in range(2 * _SLOTS):
        out.append(f"""g{t} AS MATERIALIZED (SELECT idx, dim, task FROM (SELECT x.idx, x.dim, x.task, row_number() OVER (PARTITION BY x.idx, x.dim ORDER BY coalesce(h.held, 0)::DOUBLE / size, coalesce(h.held, 0), size, u, x.task) AS r
    FROM x LEFT JOIN (SELECT dim, task, count(*) AS held FROM ({done}) GROUP BY 1, 2) h ON h.dim = x.dim AND h.task = x.task WHERE turn = {_SLOTS + t}) WHERE r = 1)""")
        done = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(t + 1))
    return ",\n  ".join(out) + f", every AS ({done})"


@query(f"""WITH {_ITEMS}, z AS (SELECT dim, task, count(*) AS size FROM items GROUP BY 1, 2),
  x AS MATERIALIZED (SELECT *, {U(_KEY, 6)} AS u, count(*) OVER (PARTITION BY idx, dim) * {_SLOTS} + CAST(floor({U('idx', 7)} * {_SLOTS}) AS INT) AS turn FROM (SELECT DISTINCT * FROM items) JOIN z USING (dim, task)), {_turns()} SELECT * FROM every""")
def primary_bucket(spark, sf):
    return S.primary_bucket(_items(spark, sf), 6, _SLOTS)


@query(f"""WITH {_ITEMS}, one AS (SELECT idx, dim, min(task) AS task FROM items GROUP BY 1, 2), z AS (SELECT dim, task, count(*) AS n FROM one GROUP BY 1, 2),
  two AS (SELECT idx, dim, task, row_number() OVER (ORDER BY round(-ln(greatest({U('idx', 8)}, 1e-12)) / (1 / pow(n, 0.5)), 9), idx) AS r FROM one JOIN z USING (dim, task) WHERE dim = 2)
  SELECT idx, dim, task FROM one WHERE dim = 3 UNION ALL SELECT idx, dim, task FROM two WHERE r <= CAST(floor(0.4 * (SELECT count(*) FROM one WHERE dim = 3)) AS INT)""")
def dim_budget(spark, sf):
    one = _items(spark, sf).groupBy("idx", "dim").agg(F.min("task").alias("task"))
    return S.dim_budget(one, 0.4, 0.5, 8)


@query(f"WITH {SEQUENCES} SELECT idx, round((row_number() OVER (PARTITION BY dataset ORDER BY idx) - 0.5) / count(*) OVER (PARTITION BY dataset), 9)::DOUBLE AS fair_position FROM sequences")
def bucket_fair_pick(spark, sf):
    return rounded(S.bucket_fair(sequences(spark, sf), "dataset", "idx").select("idx", F.col("fair_position").cast("double").alias("fair_position")), 9)


@query(f"WITH {SEQUENCES}, b AS (SELECT idx, dataset, (row_number() OVER (PARTITION BY dataset ORDER BY idx) - 1) // 16 AS batch_id, count(*) OVER (PARTITION BY dataset) AS n FROM sequences) SELECT idx, dataset, batch_id FROM b WHERE (batch_id + 1) * 16 <= n")
def batch_ids(spark, sf):
    return S.batch_ids(sequences(spark, sf).select("idx", "dataset"), "dataset", "idx", 16, True)


FRAMES = "frames AS (SELECT conv_id AS \"case\", turn AS frame_idx, CASE WHEN turn % 4 = 3 THEN 0 ELSE length(text) END AS area, role = 'user' AS prompted FROM conversations)"


def frames(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("case"), F.col("turn").alias("frame_idx"), F.when(F.col("turn") % 4 == 3, 0).otherwise(F.length("text")).alias("area"), (F.col("role") == "user").alias("prompted"))


_FK = "\"case\" || '|' || frame_idx"


@query(f"""WITH {FRAMES}, a AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY frame_idx) = 1 AS f FROM frames WHERE area > 0), b AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY CASE WHEN f THEN 'infinity'::DOUBLE ELSE round(-ln(greatest({U(_FK, 9)}, 1e-12)) / area, 12) END, frame_idx) = 1 AS d FROM a)
  SELECT "case", frame_idx, CAST(pick AS INT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY f DESC, d DESC, area DESC, frame_idx) AS pick FROM b) WHERE pick <= 3""")
def prompt_frame_pick(spark, sf):
    return S.prompt_frames(frames(spark, sf), 3, 9)


@query(f'WITH {FRAMES} SELECT "case", frame_idx, area, prompted FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY frame_idx) AS r FROM frames WHERE area > 0) WHERE r = 1 OR {U(_FK, 10)} < 0.3')
def prompt_frame_prob(spark, sf):
    return S.prompt_frame_prob(frames(spark, sf), 0.3, 10)


_PK = "case_id || '|' || frame_idx || '|' || px"


@query(f"WITH {PIXELS} SELECT case_id, frame_idx, px, gt AS positive FROM (SELECT *, row_number() OVER (PARTITION BY case_id, frame_idx, gt ORDER BY {U(_PK, 11)}, px) AS r FROM pixels) WHERE r <= 2")
def click_sample(spark, sf):
    return S.clicks(pixels(spark, sf), 2, 11)


@query(f"WITH {PIXELS} SELECT case_id, frame_idx, px, gt AS positive FROM (SELECT *, row_number() OVER (PARTITION BY case_id, frame_idx ORDER BY CASE WHEN (prob >= 0.5) <> (gt = 1) THEN 0 WHEN gt = 0 THEN 1 ELSE 2 END, {U(_PK, 12)}, px) AS r FROM pixels) WHERE r = 1")
def error_click_sample(spark, sf):
    return S.error_click(pixels(spark, sf), 0.5, 12)


@query(f'WITH {FRAMES} SELECT "case", frame_idx AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY abs(frame_idx - mid), frame_idx DESC) AS r FROM (SELECT *, max(frame_idx) OVER (PARTITION BY "case") / 2.0 AS mid FROM frames) WHERE prompted AND area > 0 AND frame_idx > 0) WHERE r = 1')
def anchor_frame(spark, sf):
    return S.anchor_frame(frames(spark, sf))


@query(f"""WITH {FRAMES}, p AS (SELECT DISTINCT "case", frame_idx AS x FROM frames WHERE prompted), j AS (SELECT f."case", f.frame_idx, x, abs(x - f.frame_idx) AS d, CASE WHEN x < f.frame_idx THEN 0 ELSE 1 END AS side FROM frames f JOIN p ON p."case" = f."case"),
  r AS (SELECT *, row_number() OVER (PARTITION BY "case", frame_idx, side ORDER BY d) AS k FROM j), o AS (SELECT *, row_number() OVER (PARTITION BY "case", frame_idx ORDER BY CASE WHEN k = 1 THEN side ELSE 2 END, d, x) AS place FROM r)
  SELECT "case", frame_idx, list(x ORDER BY place) AS closest FROM o WHERE place <= 3 GROUP BY 1, 2""")
def closest_frames(spark, sf):
    f = frames(spark, sf)
    return S.closest_frames(f.where("prompted").select("case", "frame_idx"), f.select("case", "frame_idx"), 3)


@query(f"WITH {FRAMES} SELECT \"case\", frame_idx, CASE WHEN ('0x' || substr(sha1('21|' || \"case\" || '|' || frame_idx), 1, 2))::INT % 2 = 0 THEN 'box' ELSE 'point' END AS prompt FROM frames")
def mixed_prompt_type(spark, sf):
    return frames(spark, sf).select("case", "frame_idx", S.prompt_coin(F.col("case"), F.col("frame_idx"), 21).alias("prompt"))


@query(f"""WITH {FRAMES}, want AS (SELECT *, CASE WHEN frame_idx % 2 = 0 THEN 'box' ELSE 'point' END AS pref, area > 200 AS box_ok, area > 50 AS point_ok FROM frames)
  SELECT "case", frame_idx, CASE WHEN pref = 'box' AND box_ok THEN 'box' WHEN pref = 'point' AND point_ok THEN 'point' WHEN box_ok THEN 'box' WHEN point_ok THEN 'point' END AS prompt FROM want WHERE box_ok OR point_ok""")
def prompt_plan(spark, sf):
    usable = {"box": F.col("area") > 200, "point": F.col("area") > 50}
    return S.prompt_plan(frames(spark, sf), "mixed", usable, F.when(F.col("frame_idx") % 2 == 0, "box").otherwise("point"), strict=False)


@query("""WITH RECURSIVE x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value) AS k FROM events), e AS (SELECT user_id, k, value AS ema FROM x WHERE k = 1 UNION ALL SELECT x.user_id, x.k, e.ema * 0.9 + x.value * 0.1 FROM e JOIN x ON x.user_id = e.user_id AND x.k = e.k + 1)
  SELECT user_id, CAST(max(k) AS INT) AS steps, round(arg_max(ema, k), 6) AS ema FROM e GROUP BY 1""")
def ema(spark, sf):
    return rounded(S.ema(table(spark, sf, "events"), ["user_id"], "event_id", "value"))
