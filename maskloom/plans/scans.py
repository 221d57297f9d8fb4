"""Queries over sources and sinks, boxes and remaining record functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from maskloom.functions import keys as K
from maskloom.operators import boxes as B
from maskloom.operators import records as R2
from maskloom.operators import results as R
from maskloom.operators import sampling as S
from maskloom.plans.base import query, rounded
from maskloom.plans.views import CASES, FILES, OK, case_results, files, table
from maskloom.sources import tables as T
from maskloom.sources.folders import new_folder


def _folder(spark) -> str:
    return new_folder(spark, "io")


def _raw_catalog(spark, sf):
    """A catalog with the usual untidiness, from the customers."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(
        F.concat(F.lit(" "), F.col("c_name")).alias("Dataset Name"), F.when(k % 3 == 0, "CT, mr ").when(k % 3 == 1, "us").otherwise("mr,ct").alias("Modality"), F.when(k % 2 == 0, " imagesTr , imagesTs,").alias("Train Folders"),
        F.when(k % 4 == 0, "Regex-File").alias("Grouping Strategy"), F.when(k % 5 == 0, "7").when(k % 5 == 1, "x").alias("Background Value"), F.when(k % 2 == 0, "Yes").otherwise("later").alias("Preprocessed?"),
    )


_CAT = """cat AS (SELECT c_name AS dataset_name, CASE c_custkey % 3 WHEN 0 THEN ['CT', 'mr'] WHEN 1 THEN ['us'] ELSE ['mr', 'ct'] END AS modality, CASE WHEN c_custkey % 2 = 0 THEN ['imagesTr', 'imagesTs'] END AS train_folders, CASE WHEN c_custkey % 4 = 0 THEN 'regex-file' ELSE 'regex' END AS grouping_strategy,
  CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE 0 END AS background_value, c_custkey % 2 = 0 AS preprocessed FROM customer)"""


@query(f"WITH {_CAT} SELECT * FROM cat")
def catalog_scan(spark, sf):
    path = _folder(spark)
    _raw_catalog(spark, sf).write.option("header", True).csv(path)
    return T.read_catalog(spark, path)


@query(f"WITH {_CAT} SELECT DISTINCT dataset_name FROM cat WHERE list_contains(modality, 'ct') OR list_contains(modality, 'CT')")
def ct_catalog_scan(spark, sf):
    return T.ct_datasets(T.catalog(_raw_catalog(spark, sf)))


#: The given tables: a file or a folder of part files each.
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(f"SELECT name || '.parquet' AS name, '.parquet' AS ext, true AS sized, row_number() OVER (ORDER BY name || '.parquet') AS place FROM (SELECT unnest({_TABLES}) AS name)")
def file_scan(spark, sf):
    f = T.list_tables(spark, sf, ".parquet")
    name = F.substring_index("path", "/", -1)
    place = F.row_number().over(Window.orderBy("path")).cast("long")  # a row per table of one folder
    return f.select(name.alias("name"), K.ext_of(F.col("path")).alias("ext"), (F.col("length") > 0).alias("sized"), place.alias("place"))


_G = "g AS (SELECT p_type AS modality, p_brand AS subdataset, CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, 'id' || p_partkey AS identifier, ['i' || p_partkey] AS images, CASE WHEN p_size % 2 = 0 THEN ['m' || p_partkey] ELSE [] END AS masks FROM part)"


def _group_rows(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    return p.select(F.col("p_type").alias("modality"), F.col("p_brand").alias("subdataset"), F.when(F.col("p_partkey") % 4 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("id"), k).alias("identifier"), F.array(F.concat(F.lit("i"), k)).alias("images"), F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("m"), k))).otherwise(F.array().cast("array<string>")).alias("masks"))


@query(f"WITH {_G} SELECT modality, subdataset, split, identifier, images, masks FROM g")
def groups_scan(spark, sf):
    """A document in parts of up to 7 groups, read again."""
    path = _folder(spark)
    T.write_groups(_group_rows(spark, sf), path, 7)
    return T.read_groups(spark, path).drop("position")


@query(f"WITH {_G} SELECT modality, subdataset, split, identifier, images, masks FROM g")
def groups_scan_nested(spark, sf):
    """The same from one nested row per subdataset."""
    path = _folder(spark)
    nested = T.nested(_group_rows(spark, sf))
    nested.select(F.array(F.struct("modality", "name", "train", "test")).alias("subdatasets")).write.json(path)
    return T.groups(spark.read.schema(T.GROUPS).json(path)).drop("position")


@query(f"WITH {_G}, n AS (SELECT modality, subdataset AS name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM g GROUP BY 1, 2) SELECT *, (train + 6) // 7 + (test + 6) // 7 AS parts FROM n")
def index_sink(spark, sf):
    path = _folder(spark)
    T.write_groups(_group_rows(spark, sf), path, 7)
    return T.group_heads(spark, path).withColumnRenamed("subdataset", "name")


_LINES = "l AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN substr(props, 1, 4) ELSE props END AS value FROM events)"


@query(f"WITH {_LINES} SELECT CAST(sum(CASE WHEN event_id % 10 > 1 THEN json_extract_string(value, '$.k')::INT END) AS BIGINT) AS k_sum, count(*) FILTER (event_id % 10 > 1) AS rows FROM l")
def jsonl_scan_tolerant(spark, sf):
    path = _folder(spark)
    e, n = table(spark, sf, "events"), F.col("event_id") % 10
    e.select(F.when(n == 0, "").when(n == 1, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("value")).write.text(path)
    rows, counts = T.tolerant_json(spark.read.text(path), "k int")
    return rows.agg(F.sum("k").alias("k_sum"), F.count("*").alias("rows"))


@query("SELECT count(*) FILTER (event_id % 10 = 0) AS blank, count(*) FILTER (event_id % 10 = 1) AS malformed, count(*) FILTER (event_id % 10 > 1) AS rows FROM events")
def jsonl_bad_lines(spark, sf):
    e, n = table(spark, sf, "events"), F.col("event_id") % 10
    lines = e.select(F.when(n == 0, "").when(n == 1, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("value"))
    return T.tolerant_json(lines, "k int")[1]


_LOGGED = "r AS (SELECT o_orderstatus AS model, CASE WHEN o_custkey % 50 > 0 THEN o_custkey % 200 END AS case_id, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM orders)"


@query(f"""WITH {_LOGGED}, ok AS (SELECT * FROM r WHERE status = 'ok'), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, case_id ORDER BY seq DESC) AS k FROM ok) WHERE k = 1 OR case_id IS NULL)
  SELECT 1 AS run, 'jsonl' AS source, model, case_id, seq FROM a UNION ALL SELECT 2, 'csv', model, case_id, seq FROM ok""")
def resume_source_pick(spark, sf):
    """Two runs: with all rows in the JSON lines and half of them in the table, and the other way round; both logs are written and read again."""
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderstatus").alias("model"), F.when(F.col("o_custkey") % 50 > 0, F.col("o_custkey") % 200).alias("case_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("ok").alias("status"))
    schema, out = "model string, case_id long, seq long, status string", []
    for run, (lines, csv) in enumerate([(rows, rows.where("seq % 2 = 0")), (rows.where("seq % 2 = 0"), rows)], 1):
        at = _folder(spark)
        lines.write.json(f"{at}/jsonl")
        csv.write.option("header", True).csv(f"{at}/csv")
        parsed, _ = T.tolerant_json(spark.read.text(f"{at}/jsonl"), schema)
        source, found = T.resume_rows(parsed, spark.read.schema(schema).option("header", True).csv(f"{at}/csv"), ["model", "case_id"], "seq")
        out.append(found.select(F.lit(run).alias("run"), F.lit(source).alias("source"), "model", "case_id", "seq"))
    return out[0].unionByName(out[1])


@query(f"WITH {FILES} SELECT path, doc_id * 7 AS length, doc_id % 90 AS mtime, n_chars AS voxels FROM files JOIN documents USING (doc_id) WHERE doc_id % 3 > 0 AND doc_id % 2 = 0")
def mask_stats_scan(spark, sf):
    f = files(spark, sf).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    cache = f.select("path", (F.col("doc_id") * 7).alias("length"), (F.col("doc_id") % 90).alias("mtime"), F.col("n_chars").alias("voxels"))
    wanted = f.where("doc_id % 2 = 0").select("path", (F.col("doc_id") * 7).alias("length"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("doc_id") % 90).alias("mtime"))
    return T.fresh_stats(cache, wanted)


@query("SELECT doc_id, n_chars, CAST(doc_id % 3 > 0 AS INT) AS part FROM documents")
def mask_stats_append(spark, sf):
    """A third of the rows, then all of them: those that are there stay as they are."""
    path, d = _folder(spark), table(spark, sf, "documents").select("doc_id", "n_chars")
    T.append_stats(path, d.where("doc_id % 3 = 0").withColumn("part", F.lit(0)), ["doc_id", "n_chars"])
    return T.append_stats(path, d.withColumn("part", F.lit(1)), ["doc_id", "n_chars"])


@query("SELECT doc_id, coalesce(l.quality, 9) = 1 AS ok, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def qc_cache_merge(spark, sf):
    path = _folder(spark)
    T.upsert(path, table(spark, sf, "documents").select("doc_id", F.lit(False).alias("ok"), F.lit("old").alias("origin")), ["doc_id"])
    return T.upsert(path, table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"), F.lit("new").alias("origin")), ["doc_id"])


@query("SELECT DISTINCT p_brand AS dataset, 'm' || (p_partkey // 2 % 70) AS path, true AS ok FROM part WHERE p_partkey % 2 = 1 AND p_size % 7 > 0")
def qc_cache_seed(spark, sf):
    path = F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("m"), (F.floor(F.col("p_partkey") / 2) % 70).cast("string")))
    p = table(spark, sf, "part").select(F.col("p_brand").alias("dataset"), (F.col("p_partkey") % 2 + 2).alias("dim"), path.alias("mask"), (F.col("p_size") % 2).alias("r"))
    return R2.cache_seed([p.where("r = 0").drop("r"), p.where("r = 1").drop("r")])


@query(f"WITH {CASES} SELECT model, count(*) AS rows FROM cases GROUP BY 1")
def model_partitioned_sink(spark, sf):
    return T.write_by_model(case_results(spark, sf), _folder(spark))


@query("WITH r AS (SELECT s_suppkey, unnest(range(s_suppkey % 50, s_suppkey % 50 + 3)) AS p FROM supplier WHERE s_suppkey % 6 > 0 UNION ALL SELECT s_suppkey, unnest(range(100 + s_suppkey % 7, 100 + s_suppkey % 7 + s_nationkey % 4)) FROM supplier WHERE s_suppkey % 6 > 0) SELECT s_suppkey, CAST(p AS INT) AS p FROM r")
def rle_source(spark, sf):
    k = F.col("s_suppkey")
    text = F.when(k % 6 > 0, F.format_string("%d 3 %d %d", k % 50 + 1, 101 + k % 7, F.col("s_nationkey") % 4))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(T.rle_cells(text)).alias("p"))


@query(f"WITH {FILES} SELECT path, CASE WHEN lower(split_part(path, '/', 2)) IN ('fr', 'de') THEN 'test' ELSE 'train' END AS folder, CASE WHEN split_part(path, '/', 3) = 'test' THEN 'test' ELSE 'train' END AS split FROM files")
def rle_path_route(spark, sf):
    path = F.col("path")
    return files(spark, sf).select("path", K.split_of_path(path, ("fr", "de"), 1).alias("folder"), K.split_of_path(path, segment=2).alias("split"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey % 5 END AS a, coalesce(CASE WHEN s_nationkey % 5 > 0 THEN CAST(s_nationkey % 5 AS VARCHAR) END, CASE WHEN s_suppkey % 3 > 0 THEN 'g' || (s_suppkey % 3) END, 'd') AS level FROM supplier")
def options_resolve(spark, sf):
    s = table(spark, sf, "supplier")
    general = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("level: g"), (F.col("s_suppkey") % 3).cast("string"), F.lit("; other: 1")))
    own = F.when(F.col("s_nationkey") % 5 > 0, F.concat(F.lit("level:"), (F.col("s_nationkey") % 5).cast("string")))
    m = T.options({"level": "d"}, general, own)
    return s.select("s_suppkey", F.nullif(F.col("s_nationkey") % 5, F.lit(0)).alias("a"), F.try_element_at(m, F.lit("level")).alias("level"))


_BOXES = "b AS (SELECT l_orderkey AS image, l_linenumber AS n, l_partkey % 100 AS x0, l_suppkey % 100 AS y0, CAST(l_quantity AS BIGINT) % 30 + 5 AS w, CAST(l_quantity AS BIGINT) % 20 + 5 AS h, l_discount AS score, l_partkey * 100000 + l_suppkey AS tie FROM lineitem)"


def _boxes(spark, sf):
    q = F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 100).alias("x0"), (F.col("l_suppkey") % 100).alias("y0"), (q % 30 + 5).alias("w"), (q % 20 + 5).alias("h"), F.col("l_discount").alias("score"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("tie"))


@query(f"WITH {_BOXES} SELECT image, n, tie, x0 + 10 AS ux0, y0 + 20 AS uy0, x0 + w + 10 AS ux1, y0 + h + 20 AS uy1, x0 + w - x0 AS width, (x0 <= 2 OR y0 <= 2 OR x0 + w >= 98 OR y0 + h >= 98) AND NOT (x0 + 10 <= 2 OR y0 + 20 <= 2) AS near_edge FROM b")
def box_xywh(spark, sf):
    return B.uncropped(_boxes(spark, sf), 10, 20, 100, 2).select("image", "n", "tie", "ux0", "uy0", "ux1", "uy1", "width", "near_edge")


@query(f"WITH {_BOXES} SELECT image, n, tie FROM b WHERE score > 0.05 AND w * h >= 100")
def mask_candidate_filter(spark, sf):
    return B.candidates(_boxes(spark, sf).withColumn("area", F.col("w") * F.col("h")), "score", "area", 0.05, 100).select("image", "n", "tie")


# Greedy by rank: a box stays unless one of the earlier boxes that overlap it too much has stayed.
@query(f"""WITH RECURSIVE {_BOXES}, k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, tie) AS r FROM b),
  o AS (SELECT j.image, j.r, list(i.r) AS over_ FROM k i JOIN k j ON i.image = j.image AND i.r < j.r
    WHERE greatest(0, least(i.x0 + i.w, j.x0 + j.w) - greatest(i.x0, j.x0)) * greatest(0, least(i.y0 + i.h, j.y0 + j.h) - greatest(i.y0, j.y0)) > 0.1 * (i.w * i.h + j.w * j.h - greatest(0, least(i.x0 + i.w, j.x0 + j.w) - greatest(i.x0, j.x0)) * greatest(0, least(i.y0 + i.h, j.y0 + j.h) - greatest(i.y0, j.y0))) GROUP BY 1, 2),
  c AS MATERIALIZED (SELECT k.image, k.r, coalesce(o.over_, []) AS over_ FROM k LEFT JOIN o USING (image, r)),
  t AS (SELECT image, 1::BIGINT AS r, [1::BIGINT] AS kept FROM c WHERE r = 1 UNION ALL SELECT t.image, c.r, CASE WHEN list_has_any(t.kept, c.over_) THEN t.kept ELSE list_append(t.kept, c.r) END FROM t JOIN c ON c.image = t.image AND c.r = t.r + 1)
  SELECT image, n, tie FROM k SEMI JOIN (SELECT image, unnest(kept) AS r FROM (SELECT image, arg_max(kept, r) AS kept FROM t GROUP BY 1)) USING (image, r)""")
def box_nms(spark, sf):
    return B.nms(_boxes(spark, sf), ["image"], "score", "tie", 0.1).select("image", "n", "tie")


@query("WITH p AS (SELECT p_partkey, p_size % 4 + 1 AS n FROM part) SELECT p_partkey, round((i + 0.5) / n, 6)::DOUBLE AS gx, round((j + 0.5) / n, 6)::DOUBLE AS gy FROM (SELECT p_partkey, n, unnest(range(0, n)) AS i FROM p) CROSS JOIN range(0, 5) r(j) WHERE j < n")
def point_grid(spark, sf):
    return rounded(B.point_grid(table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("n")), "n").select("p_partkey", "gx", "gy"))


@query("SELECT p_partkey, greatest(w, h) AS side, (greatest(w, h) - w) // 2 AS pad_left, greatest(w, h) - w - (greatest(w, h) - w) // 2 AS pad_right, (greatest(w, h) - h) // 2 AS pad_top, greatest(w, h) - h - (greatest(w, h) - h) // 2 AS pad_bottom FROM (SELECT p_partkey, p_partkey % 97 + 3 AS w, CAST(p_size AS BIGINT) + 5 AS h FROM part)")
def pad_square(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 97 + 3).alias("w"), (F.col("p_size").cast("long") + 5).alias("h"))
    return B.pad_square(p).select("p_partkey", "side", "pad_left", "pad_right", "pad_top", "pad_bottom")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Liver (ct)' WHEN s_suppkey % 3 = 1 THEN 'task one' ELSE 'unknown' END AS label FROM supplier")
def task_label(spark, sf):
    s = table(spark, sf, "supplier")
    task = F.when(F.col("s_suppkey") % 3 == 0, "liver").when(F.col("s_suppkey") % 3 == 1, "task_one")
    names = spark.createDataFrame([("liver", "Liver (ct)")], "task string, display string")
    return S.task_label(s.withColumn("task", task), "task", names).select("s_suppkey", "label")


@query("SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 4 = 0 THEN ' ' WHEN o_orderkey % 4 = 1 THEN o_orderstatus END), ''), CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN NULL END, 'unknown') AS meta FROM orders")
def meta_value(spark, sf):
    a = F.when(F.col("o_orderkey") % 4 == 0, " ").when(F.col("o_orderkey") % 4 == 1, F.col("o_orderstatus"))
    b = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.col("o_orderpriority"), F.lit(" "))).when(F.col("o_orderkey") % 2 == 0, "None").otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", K.meta_value(a, b).alias("meta"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ['box', 'point'] WHEN 1 THEN ['mask'] WHEN 2 THEN ['point', 'mask'] ELSE ['box'] END AS modes FROM part")
def prompt_mode_normalize(spark, sf):
    text = F.when(F.col("p_size") % 4 == 0, "BBOX, clicks,box").when(F.col("p_size") % 4 == 1, "masks ,mask").when(F.col("p_size") % 4 == 2, "click,masks").otherwise("boxes")
    return table(spark, sf, "part").select("p_partkey", R.prompt_modes(text).alias("modes"))


@query(f"WITH {OK} SELECT seq, round(CASE WHEN tp + fp = 0 THEN NULL ELSE tp::DOUBLE / (tp + fp) END, 6) AS ppv, round(coalesce(fn::DOUBLE / nullif(fp, 0), -1), 6) AS ratio FROM ok")
def safe_div(spark, sf):
    ok = R.status_split(case_results(spark, sf))[0]
    return rounded(ok.select("seq", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("ppv"), F.coalesce(F.try_divide("fn", "fp"), F.lit(-1.0)).alias("ratio")))


@query(f"""WITH {OK} SELECT seq, n_frames = dataset_index % 90 AND prompt_mode = 'box' AS boxes_supplied_for_every_frame, dataset_index % 90 <= dataset_index % 70 AS only_cached_frames_prompted, dataset_index % 90 = 1 AS only_one_frame_prompted,
  prompt_mode = 'mask' OR dataset_index % 4 = 0 AS mask_prompts_used FROM (SELECT * REPLACE (CASE WHEN prompt_mode = 'O' THEN 'box' WHEN dataset_index % 3 = 0 THEN 'mask' ELSE 'point' END AS prompt_mode) FROM ok)""")
def prompt_audit_flags(spark, sf):
    ok, d = R.status_split(case_results(spark, sf))[0], F.col("dataset_index")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))))
    mode = F.when(F.col("prompt_mode") == "O", "box").when(d % 3 == 0, "mask").otherwise("point")
    x = ok.withColumns({"prompt_mode": mode, "actual": upto(d % 90), "cached": upto(d % 70), "mask_frames": F.when(d % 4 == 0, F.array(F.lit(1)))})
    return R2.prompt_audit(x).select("seq", "boxes_supplied_for_every_frame", "only_cached_frames_prompted", "only_one_frame_prompted", "mask_prompts_used")


@query("SELECT p_partkey, (p_size % 5 > 0) AND p_size >= 20 AND p_partkey % 4 >= 2 AND p_partkey % 3 = 2 AND p_partkey % 7 > 0 AND p_partkey % 11 > 0 AND p_partkey % 13 > 0 AS trusted FROM part")
def policy_trust(spark, sf):
    """Stored policies as JSON texts: some too weak, some with a boolean or a text for a number, some malformed."""
    k, size = F.col("p_partkey"), F.col("p_size")
    policy = F.to_json(F.struct(
        (size % 5 > 0).alias("applied"), size.alias("min_component_voxels_3d"), (k % 3).alias("mask_qc_downsample_3d"), F.lit(40).alias("min_slice_area_px_3d"), F.lit(0.25).cast("double").alias("min_slice_area_fraction_3d"),
        (k % 4).alias("min_qualified_slices_3d"), F.lit(True).alias("require_contiguous_qualified_slices_3d")))
    policy = F.when(k % 7 == 0, F.regexp_replace(policy, '"min_slice_area_px_3d":40', '"min_slice_area_px_3d":true')).when(k % 11 == 0, F.regexp_replace(policy, '"min_slice_area_px_3d":40', '"min_slice_area_px_3d":"40"')).when(k % 13 == 0, F.substring(policy, 1, 40)).otherwise(policy)
    return table(spark, sf, "part").withColumn("policy", policy).select("p_partkey", R2.policy_trusted(F.col("policy"), {"min_voxels": 20, "min_frac_2d_area": 0.2}).alias("trusted"))


@query("""SELECT CASE WHEN n = 0 THEN 'id' || p_partkey ELSE 'id' || p_partkey || '_modality' || i END AS identifier, CAST(i AS INT) AS modality_index, 'im' || i AS image, CASE WHEN n = 0 THEN list_transform(range(0, 4), lambda m: m % 2) ELSE list_transform(range(0, 4), lambda m: 0) END AS mask_index,
  list_transform(range(0, 4), lambda m: 'm' || m) AS mask_path FROM (SELECT *, p_size % 3 AS n, unnest(range(0, p_size % 3 + 1)) AS i FROM part) WHERE p_partkey % 4 = 0 OR n = 0
  UNION ALL SELECT 'id' || p_partkey || '_modality' || i, CAST(i AS INT), 'im' || i, list_transform(list_filter(range(0, 4), lambda m: m % 2 = i), lambda m: 0), list_transform(list_filter(range(0, 4), lambda m: m % 2 = i), lambda m: 'm' || m) FROM (SELECT *, p_size % 3 AS n, unnest(range(0, p_size % 3 + 1)) AS i FROM part) WHERE p_partkey % 4 > 0 AND n > 0""")
def split_modalities(spark, sf):
    """Groups of one to three images with four masks, of every fourth group shared by all images."""
    n = (F.col("p_size") % 3).cast("int")
    images = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("im"), i.cast("string")))
    masks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda m: F.struct((m % 2).alias("image_index"), F.concat(F.lit("m"), m.cast("string")).alias("path")))
    g = table(spark, sf, "part").select(F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("identifier"), images.alias("images"), masks.alias("masks"), (F.col("p_partkey") % 4 == 0).alias("shared"))
    out = R2.split_modalities(g, F.col("shared"))
    index = F.transform("masks", lambda m: m["image_index"].cast("long"))
    return out.select("identifier", "modality_index", "image", index.alias("mask_index"), F.transform("masks", lambda m: m["path"]).alias("mask_path"))
