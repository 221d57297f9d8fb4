"""Queries over records of the preprocessing stage: names, rules, slice order, cleaning, reports, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions import keys as K
from maskloom.operators import masks as M
from maskloom.operators import records as R
from maskloom.operators.boxes import uncropped
from maskloom.plans.base import query, rounded
from maskloom.plans.masks import components_sql
from maskloom.plans.views import FILES, MASKS, PIXELS, VOXELS, files, mask_files, pixels, table, voxels
from maskloom.sources import tables as T
from maskloom.sources.folders import new_folder
from maskloom.sources.heads import header_reason

_EXT = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(?i)(\\.nii\\.gz|\\.ppm\\.gz|\\.[^.]+)$', 1))"
_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)(\\.nii\\.gz|\\.ppm\\.gz|\\.[^.]+)$', '')"


def _folder(spark) -> str:
    return new_folder(spark, "io")


@query(f"WITH {FILES} SELECT path, {_STEM} AS stem FROM files")
def stem_of(spark, sf):
    return files(spark, sf).select("path", K.stem_of(F.col("path")).alias("stem"))


@query(f"WITH {MASKS} SELECT path, CAST(regexp_extract(path, '_mask(\\d+)', 1) AS INT) AS mask_idx FROM masks")
def mask_idx_from_name(spark, sf):
    return mask_files(spark, sf).select("path", K.mask_idx_from_name(F.col("path")).alias("mask_idx"))


@query(f"WITH {FILES} SELECT path, regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM files")
def safe_name(spark, sf):
    return files(spark, sf).select("path", K.safe_name(F.col("path")).alias("safe"))


@query("SELECT p_partkey, md5('brand=' || p_brand || ';size=' || p_size) AS config_hash FROM part")
def config_hash(spark, sf):
    entries = F.array_sort(F.array(F.concat(F.lit("size="), F.col("p_size").cast("string")), F.concat(F.lit("brand="), F.col("p_brand"))))
    return table(spark, sf, "part").select("p_partkey", F.md5(F.array_join(entries, ";").cast("binary")).alias("config_hash"))


@query("SELECT p_partkey, 'p' || p_partkey || '.png' AS item FROM part")
def path_item(spark, sf):
    k = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".png"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("{'path': '"), k, F.lit("', 'id': 1}"))).when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(k.alias("path")))).otherwise(k)
    parsed = F.get_json_object(F.replace(raw, F.lit("'"), F.lit('"')), "$.path")
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.when(F.startswith(raw, F.lit("{")), parsed), raw).alias("item"))


@query("SELECT p_partkey, p_type || '/' || regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '_', 'g') || '/' || CASE WHEN p_size % 2 = 0 THEN 'train' ELSE 'test' END AS folder FROM part")
def render_dirs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_type", K.safe_name(F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, "train").otherwise("test")).alias("folder"))


@query("SELECT p_partkey, lower(p_type) || '_' || printf('%06d', p_partkey) || '_img' || printf('%03d', p_size) || '.png' AS name FROM part")
def render_image_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("_", F.lower("p_type"), F.format_string("%06d", "p_partkey"), F.format_string("img%03d.png", "p_size")).alias("name"))


@query("SELECT p_partkey, lower(p_type) || '_' || printf('%06d', p_partkey) || '_mask' || printf('%03d', p_size) || '_%' || lower(p_name) || '%_comp' || printf('%03d', p_size % 4) || '.png' AS name FROM part")
def render_mask_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("_", F.lower("p_type"), F.format_string("%06d", "p_partkey"), F.format_string("mask%03d", "p_size"), F.concat(F.lit("%"), F.lower("p_name"), F.lit("%")), F.format_string("comp%03d.png", F.col("p_size") % 4)).alias("name"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 4 END AS INT) AS image_idx FROM documents")
def matching_image_idx(spark, sf):
    images = F.array(*[F.concat(F.lit(f"s{i}_k"), F.col("doc_id").cast("string"), F.lit("x")) for i in range(3)])
    wanted = F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"), F.lit("_k"))
    hit = F.array_position(F.transform(images, lambda p: F.contains(p, wanted)), F.lit(True)) - 1
    return table(spark, sf, "documents").select("doc_id", F.when(hit >= 0, hit).cast("int").alias("image_idx"))


@query("SELECT p_partkey, 'organ' AS task, list_sort(['c' || (p_size % 3), p_brand]) AS classes FROM part")
def parse_tasks(spark, sf):
    text = F.concat(F.lit("organ = "), F.col("p_brand"), F.lit(", c"), (F.col("p_size") % 3).cast("string"), F.lit("|broken"))
    p = table(spark, sf, "part").select("p_partkey", F.explode(K.parse_pairs(text, "|", "=")).alias("e"))
    return p.select("p_partkey", F.col("e.key").alias("task"), F.array_sort(F.transform(F.split("e.value", ","), lambda c: F.trim(c))).alias("classes"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS min_voxels, CASE WHEN p_size % 3 = 0 THEN 'not_a_number' WHEN p_size > 40 THEN 'out_of_range' END AS reason FROM part")
def parse_options(spark, sf):
    text = F.concat(F.lit("{min_voxels: "), F.when(F.col("p_size") % 3 == 0, "many").otherwise(F.col("p_size").cast("string")), F.lit("; order: position}"))
    pairs = K.parse_pairs(F.regexp_replace(text, "[{}]", ""), ";", ":")
    m = F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["key"], e["value"])))
    x = table(spark, sf, "part").withColumn("v", F.try_element_at(m, F.lit("min_voxels")))
    n = F.expr("try_cast(v as int)")
    return x.select("p_partkey", n.alias("min_voxels"), F.when(n.isNull(), "not_a_number").when(n > 40, "out_of_range").alias("reason"))


@query("SELECT s_suppkey, 's' || s_nationkey AS subdataset, 'images' AS side, '(?P<id>.{2,3})_' || s_suppkey || '\\.png' AS pattern FROM supplier UNION ALL SELECT s_suppkey, 's' || s_nationkey, 'masks', '(?P<id>.+)_m\\.png' FROM supplier")
def parse_grouping(spark, sf):
    text = F.concat(F.lit("[s"), F.col("s_nationkey").cast("string"), F.lit("]{images: (?P<id>.{2,3})_"), F.col("s_suppkey").cast("string"), F.lit("\\.png; masks: (?P<id>.+)_m\\.png}"))
    spark.udtf.register("grouping_rules", R.GroupingRules)
    s = table(spark, sf, "supplier").select("s_suppkey", text.alias("spec"))
    return spark.sql("select s_suppkey, r.* from {s}, lateral grouping_rules(spec) r", s=s)


_RULES = [("Brand#1", "ring", "metal"), ("Brand#1", "10-20", "middle"), ("Brand#2", "widget", "tool"), ("Brand#2", "*", "rest"), ("Brand#2", "1-99", "never"), ("default", "red widget", "red"), ("default", "widget", "tool"), ("default", "7", "seven"), ("default", "30-40", "large")]
_RV = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _RULES)


@query(f"""WITH rules AS (SELECT * FROM (VALUES {_RV}) t(subdataset, rule, class)), m AS (SELECT p_partkey AS mask_id, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_brand ELSE 'default' END AS rs, p_name, p_size FROM part),
  h AS (SELECT mask_id, class, rule, CASE WHEN rule = '*' THEN 1 WHEN contains(p_name, rule) THEN 0 WHEN regexp_full_match(rule, '\\d+-\\d+') AND p_size >= split_part(rule, '-', 1)::INT AND p_size <= split_part(rule, '-', 2)::INT THEN 2 WHEN rule = p_size::VARCHAR THEN 3 END AS p FROM m JOIN rules ON rs = subdataset)
  SELECT p_partkey AS mask_id, class FROM part LEFT JOIN (SELECT mask_id, class, row_number() OVER (PARTITION BY mask_id ORDER BY p, length(rule) DESC, rule, class) AS k FROM h WHERE p IS NOT NULL) b ON b.mask_id = p_partkey AND k = 1""")
def class_match(spark, sf):
    rules = spark.createDataFrame(_RULES, "subdataset string, rule string, class string")
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("mask_id"), F.col("p_brand").alias("subdataset"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("label"))
    return R.class_match(m, rules)


@query("SELECT l_suppkey, l_orderkey AS uid, l_linenumber AS instance, l_partkey AS tie, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_suppkey % 4 > 0 THEN round(-l_quantity * 1.5, 9) END, l_orderkey * 100000 + l_partkey) AS INT) AS slice_number FROM lineitem")
def dicom_slice_order(spark, sf):
    li = table(spark, sf, "lineitem")
    has = F.col("l_suppkey") % 4 > 0
    o = F.when(has, F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, -1, 0)]))
    p = F.array(F.lit(3.0), F.lit(4.0), F.col("l_quantity") * 1.5)
    x = li.select("l_suppkey", F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("instance"), F.col("l_partkey").alias("tie"), o.alias("orientation"), p.alias("position"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("instance_number"))
    return R.slice_order(x, "l_suppkey").select("l_suppkey", "uid", "instance", "tie", "slice_number")


@query("WITH i AS (SELECT o_orderkey AS uid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS slice_number, o_custkey AS study FROM orders) SELECT study, slice_number, count(*) AS frames FROM lineitem JOIN i ON l_orderkey = uid GROUP BY 1, 2")
def slice_uid_join(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    i = o.select(F.col("o_orderkey").alias("uid"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("slice_number"), F.col("o_custkey").alias("study"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uid")).join(i, "uid").groupBy("study", "slice_number").agg(F.count("*").alias("frames"))


@query("SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS A, max(CASE WHEN l_returnflag = 'N' THEN l_partkey END) AS N, max(CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS R, any_value(s_name) AS s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def contour_patient_join(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("original_id", F.format_string("SCD%07d", "l_suppkey"))
    s = table(spark, sf, "supplier").withColumn("original_id", F.format_string("SCD%07d", "s_suppkey"))
    wide = li.groupBy("original_id", "l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_partkey"))
    return wide.join(s.select("original_id", "s_name"), "original_id").drop("original_id")


@query("SELECT l_suppkey, count(*) AS n, round(sum(greatest(least(l_extendedprice, 50000), 1000)), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 10 GROUP BY 1")
def profile_join(spark, sf):
    prof = table(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(1000.0).alias("lo"), F.lit(50000.0).alias("hi"))
    img = table(spark, sf, "supplier").join(prof, "s_nationkey")
    x = table(spark, sf, "lineitem").join(img, F.col("l_suppkey") == F.col("s_suppkey"))
    return rounded(x.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.greatest(F.least("l_extendedprice", "hi"), "lo")).alias("total")), 2)


@query("SELECT o_orderkey AS locator, place, part, identifier FROM (SELECT o_orderkey, o_orderkey * 2 AS place, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [{'part': 0, 'identifier': 'a' || o_orderkey}, {'part': 1, 'identifier': 'b' || o_orderkey}] ELSE [{'part': 0, 'identifier': 'id' || o_orderkey}] END, recursive := true) FROM orders)")
def split_replace(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("locator"), (F.col("o_orderkey") * 2).alias("place"), F.concat(F.lit("id"), F.col("o_orderkey").cast("string")).alias("identifier"))
    outs = o.where("locator % 3 = 0").select("locator", F.posexplode(F.array(F.concat(F.lit("a"), F.col("locator").cast("string")), F.concat(F.lit("b"), F.col("locator").cast("string")))).alias("part", "output"))
    return R.split_replace(o, outs)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'mask' WHEN s_nationkey = 3 THEN 'point' WHEN s_nationkey % 4 = 1 THEN 'box' ELSE 'auto' END AS mode FROM supplier")
def prompt_modes_resolve(spark, sf):
    s, n = table(spark, sf, "supplier"), F.col("s_nationkey")
    modes = spark.createDataFrame([("t0", "mask"), ("ds/sub3", "point"), ("sub1", "box")], "name string, mode string")
    x = s.select("s_suppkey", F.concat(F.lit("t"), (F.col("s_suppkey") % 5).cast("string")).alias("task_id"), F.lit(None).cast("string").alias("task_label"), F.lit("ds").alias("dataset"), F.when(n == 3, "sub3").when(n % 4 == 3, "sub9").otherwise(F.concat(F.lit("sub"), (n % 4).cast("string"))).alias("subdataset"))
    return R.prompt_modes_resolve(x, modes, "auto").select("s_suppkey", "mode")


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'zero_bytes' WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'bad_gzip' END AS reason, count(*) AS files FROM documents GROUP BY 1")
def corrupt_pair_filter(spark, sf):
    d = F.col("doc_id")
    head = F.when((d % 3 == 0) & (d % 2 == 0), F.unhex(F.lit("1F8B08"))).otherwise(F.unhex(F.lit("504E47")))
    x = files(spark, sf).withColumns({"length": F.when(d % 7 == 0, None).when(d % 5 == 0, 0).otherwise(10), "head": head})
    return x.groupBy(R.corrupt_reason(F.col("length"), F.col("head"), F.col("path")).alias("reason")).agg(F.count("*").alias("files"))


@query("""SELECT CASE WHEN doc_id % 11 = 0 THEN 'zero_bytes' WHEN doc_id % 4 = 0 THEN 'bad_gzip' WHEN doc_id % 4 = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'short_header' WHEN 1 THEN 'bad_magic' END WHEN doc_id % 4 = 2 THEN 'bad_header_length' END AS reason, count(*) AS files FROM documents GROUP BY 1""")
def corrupt_header_filter(spark, sf):
    """Heads of compressed volumes: some no gzip at all, some cut, some with another length or magic."""
    import gzip

    @F.pandas_udf("binary")
    def packed(raw):
        return raw.map(lambda b: gzip.compress(bytes(b), 1))

    d = F.col("doc_id")
    zeros = lambda n: F.repeat(F.lit("00"), n)
    size = F.when(d % 4 == 2, "5D010000").otherwise("5C010000")
    magic = F.when((d % 4 == 1) & (d % 3 == 1), "6E2B3200").otherwise("6E2B3100")
    raw = F.unhex(F.concat(size, zeros(340), magic, F.repeat(F.lit("AB"), 900)))
    head = packed(F.when((d % 4 == 1) & (d % 3 == 0), F.substring(raw, 1, 200)).otherwise(raw))
    x = files(spark, sf).select(F.lit("a.nii.gz").alias("path"), F.when(d % 11 == 0, 0).otherwise(500).alias("length"), F.when(d % 4 == 0, F.unhex(F.lit("504E47"))).otherwise(head).alias("head"))
    return x.groupBy(header_reason(F.col("length"), F.col("head"), F.col("path")).alias("reason")).agg(F.count("*").alias("files"))


@query("SELECT p_partkey, 'i' || p_partkey AS image, 'm' || p_partkey AS mask FROM part WHERE p_type = 'ECONOMY' AND p_size % 2 = 0")
def first_pair_filter(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    x = p.select("p_partkey", "p_type", F.array(F.concat(F.lit("i"), k), F.lit("x")).alias("images"), F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("m"), k))).otherwise(F.array().cast("array<string>")).alias("masks"))
    return x.where(K.modality_wanted(F.col("p_type"), ["economy"]) & (F.size("images") > 0) & (F.size("masks") > 0)).select("p_partkey", F.element_at("images", 1).alias("image"), F.element_at("masks", 1).alias("mask"))


@query("SELECT 'results' AS artifact, count(*) AS rows, 2 AS columns FROM orders UNION ALL SELECT 'memory', 0, 0 WHERE EXISTS (SELECT 1 FROM orders)")
def artifact_scan(spark, sf):
    path = _folder(spark)
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(f"{path}/results_v2.csv")
    return T.artifact_counts(spark, T.artifacts(spark, path, {"results": ["results.csv", "results_v2.csv"], "memory": ["memory.csv"]}))


@query("SELECT doc_id, quality = 1 AS ok FROM labels WHERE quality = 1 OR doc_id % 2 = 0")
def qc_cache_scan(spark, sf):
    path = _folder(spark)
    rows = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"), (F.col("doc_id") % 2).alias("params"))
    rows.repartition("params").write.partitionBy("params").parquet(path)
    return T.quality_cache(spark, path, "params", 0, [1]).select("doc_id", "ok")


@query("SELECT p_type AS task, list_sort(list(DISTINCT p_brand)) AS datasets FROM part GROUP BY 1")
def task_catalog_sink(spark, sf):
    path = _folder(spark)
    table(spark, sf, "part").groupBy(F.col("p_type").alias("task")).agg(F.sort_array(F.collect_set("p_brand")).alias("datasets")).write.json(path)
    return spark.read.schema("task string, datasets array<string>").json(path)


@query("SELECT p_type AS modality, p_brand AS name, count(*) FILTER (p_size % 3 < 2) AS accepted FROM part GROUP BY 1, 2")
def manifest_sink(spark, sf):
    path, p = _folder(spark), table(spark, sf, "part")
    status = F.when(F.col("p_size") % 3 == 0, "accepted").when(F.col("p_size") % 3 == 1, "partial").otherwise("rejected")
    doc = p.groupBy(F.col("p_type").alias("modality"), F.col("p_brand").alias("name")).agg(F.collect_list(F.struct("p_partkey", status.alias("status"))).alias("groups"))
    doc.withColumn("preprocessing_schema_version", F.lit(2)).write.json(path)
    back = spark.read.schema("modality string, name string, groups array<struct<p_partkey long, status string>>").json(path)
    return back.select("modality", "name", F.size(F.filter("groups", lambda g: g["status"] != "rejected")).cast("long").alias("accepted"))


@query("SELECT c_name AS dataset_name, CASE WHEN c_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS preprocessed FROM customer")
def catalog_update_sink(spark, sf):
    path, c = _folder(spark), table(spark, sf, "customer")
    done = c.where("c_custkey % 3 = 0").select("c_name", F.lit("yes").alias("status"))
    c.select("c_name").join(done, "c_name", "left").select(F.col("c_name").alias("dataset_name"), F.coalesce("status", F.lit("no")).alias("preprocessed")).write.option("header", True).csv(path)
    return spark.read.option("header", True).csv(path)


@query("SELECT doc_id, CAST(i AS INT) AS point, doc_id % 50 + i AS x, i * 2 AS y FROM documents, range(0, 3) r(i) WHERE doc_id % 4 > 0")
def annotation_polygon_source(spark, sf):
    d = F.col("doc_id")
    pts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((d % 50 + i).alias("x"), (i * 2).cast("long").alias("y")))
    raw = F.when(d % 4 == 0, "{broken").otherwise(F.to_json(F.struct(F.struct(pts.alias("points")).alias("region"))))
    x = table(spark, sf, "documents").select("doc_id", F.from_json(raw, "region struct<points array<struct<x long, y long>>>").alias("r")).where("r.region is not null")
    return x.select("doc_id", F.posexplode("r.region.points").alias("point", "p")).select("doc_id", "point", "p.x", "p.y")


@query(f"WITH {PIXELS} SELECT case_id, frame_idx, px, round(least(greatest(ln(prob / (1 - prob)), -8), 8), 6) AS logit FROM pixels")
def logit(spark, sf):
    return rounded(pixels(spark, sf).select("case_id", "frame_idx", "px", F.least(F.greatest(F.ln(F.col("prob") / (1 - F.col("prob"))), F.lit(-8.0)), F.lit(8.0)).alias("logit")))


@query(f"WITH {PIXELS}, m AS (SELECT case_id, min(v) AS m FROM (SELECT case_id, floor(prob * 8) AS v, count(*) AS n, max(count(*)) OVER (PARTITION BY case_id) AS t FROM pixels GROUP BY 1, 2) WHERE n = t GROUP BY 1) SELECT case_id, frame_idx, px, prob > 0.5 AS by_threshold, floor(prob * 8) > m AS by_mode FROM pixels JOIN m USING (case_id)")
def binarize(spark, sf):
    p = pixels(spark, sf).withColumn("v", F.floor(F.col("prob") * 8))
    n = p.groupBy("case_id", "v").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m"))
    return p.join(n, "case_id").select("case_id", "frame_idx", "px", (F.col("prob") > 0.5).alias("by_threshold"), (F.col("v") > F.col("m.v")).alias("by_mode"))


@query("SELECT p_partkey, CASE WHEN sqrt(pow(r - 250, 2) + pow(g - 10, 2) + pow(b - 10, 2)) <= 120 THEN 'red' WHEN sqrt(pow(r - 100, 2) + pow(g - 100, 2) + pow(b - 100, 2)) <= 120 THEN 'grey' END AS colour FROM (SELECT p_partkey, p_partkey % 256 AS r, p_size * 5 AS g, (p_partkey * 7) % 256 AS b FROM part)")
def nearest_colour(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_size") * 5).alias("g"), ((F.col("p_partkey") * 7) % 256).alias("b"))
    return R.nearest_colour(p, [("grey", (100, 100, 100)), ("red", (250, 10, 10))], 120.0).select("p_partkey", "colour")


def _boxes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 90).alias("x0"), (F.col("p_size") % 80).alias("y0"), F.lit(8).alias("w"), F.lit(6).alias("h"))


@query("SELECT p_partkey, p_partkey % 90 + 5 AS ux0, p_size % 80 + 7 AS uy0, p_partkey % 90 + 13 AS ux1, p_size % 80 + 13 AS uy1 FROM part")
def uncrop_box(spark, sf):
    return uncropped(_boxes(spark, sf), 5, 7, 100, 3).select("p_partkey", "ux0", "uy0", "ux1", "uy1")


@query("SELECT p_partkey, p_partkey % 90 <= 3 OR p_size % 80 <= 3 OR p_partkey % 90 + 8 >= 97 OR p_size % 80 + 6 >= 97 AS near_edge FROM part")
def near_crop_edge(spark, sf):
    return uncropped(_boxes(spark, sf), 5, 7, 100, 3).select("p_partkey", "near_edge")


@query("""WITH i AS (SELECT p_partkey, p_partkey % 400 + 100 AS w, p_size * 10 + 60 AS h, l AS layer, CAST(pow(2, l) AS INT) AS n FROM part, range(0, 2) r(l)), s AS (SELECT *, CAST(floor(0.34 * least(w, h) * 2 / n) AS BIGINT) AS lap FROM i),
  c AS (SELECT *, CAST(ceil((lap * (n - 1) + w) / n::DOUBLE) AS BIGINT) AS cw, CAST(ceil((lap * (n - 1) + h) / n::DOUBLE) AS BIGINT) AS ch FROM s)
  SELECT p_partkey, w, h, CAST(layer AS INT) AS layer, CASE WHEN n > 1 THEN (cw - lap) * a ELSE 0 END AS x0, CASE WHEN n > 1 THEN (ch - lap) * b ELSE 0 END AS y0, least(CASE WHEN n > 1 THEN (cw - lap) * a ELSE 0 END + cw, w) AS x1, least(CASE WHEN n > 1 THEN (ch - lap) * b ELSE 0 END + ch, h) AS y1 FROM c, range(0, 2) ra(a), range(0, 2) rb(b) WHERE a < n AND b < n""")
def crop_boxes(spark, sf):
    i = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 400 + 100).alias("w"), (F.col("p_size") * 10 + 60).alias("h"))
    return R.crop_boxes(i, 1, 0.34)


_LONG = f"{VOXELS}, s AS (SELECT DISTINCT case_id, y FROM voxels WHERE label = 2), l AS (SELECT case_id, max(n) AS longest FROM (SELECT case_id, g, count(*) AS n FROM (SELECT case_id, y - row_number() OVER (PARTITION BY case_id ORDER BY y) AS g FROM s) GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {_LONG}, v AS (SELECT case_id, 8 * count(*) AS vox, count(DISTINCT y) AS ys FROM voxels WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0 GROUP BY 1) SELECT case_id, CASE WHEN vox < 560 THEN 'too_few_voxels' WHEN ys < 22 THEN 'axis_too_short' WHEN coalesce(longest, 0) < 22 THEN 'no_contiguous' END AS reason FROM v LEFT JOIN l USING (case_id)")
def evaluate_quality(spark, sf):
    v = voxels(spark, sf)
    runs = M.longest_run(v.where("label = 2").select("case_id", F.col("y").alias("slice")).distinct(), ["case_id"])
    return R.evaluate_quality(M.mask_stats(v, 2), runs, 560, 22)


@query(f"WITH {VOXELS}, c AS (SELECT case_id, 8 * count(*) FILTER (z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0) AS voxels, count(*) AS exact FROM voxels GROUP BY 1) SELECT case_id, CASE WHEN voxels >= 620 OR voxels < 0.8 * 620 THEN voxels ELSE exact END AS voxels, CASE WHEN voxels >= 620 OR voxels < 0.8 * 620 THEN 'coarse' ELSE 'exact' END AS phase, CASE WHEN voxels >= 620 OR voxels < 0.8 * 620 THEN voxels ELSE exact END >= 620 AS ok FROM c WHERE voxels > 0")
def check_quality_two_phase(spark, sf):
    v = voxels(spark, sf)
    coarse = M.mask_stats(v, 2).select("case_id", F.col("voxels_est").alias("voxels"))
    return R.two_phase(coarse, lambda ids: v.join(ids, "case_id").groupBy("case_id").agg(F.count("*").alias("voxels")), 620)


# The background that the border reaches by sides, step by step; what is left of the background is filled.
@query(f"""WITH RECURSIVE {VOXELS}, f AS MATERIALIZED (SELECT DISTINCT case_id, label, y, x FROM voxels), m AS (SELECT DISTINCT case_id, label FROM f),
  free AS MATERIALIZED (SELECT case_id, label, CAST(p // 64 AS INT) AS y, CAST(p % 64 AS INT) AS x FROM m CROSS JOIN range(0, 4096) r(p) ANTI JOIN (SELECT case_id, label, y * 64 + x AS p FROM f) USING (case_id, label, p)),
  outer_ AS (SELECT * FROM free WHERE y IN (0, 63) OR x IN (0, 63) UNION SELECT b.case_id, b.label, b.y, b.x FROM outer_ o CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx) JOIN free b ON b.case_id = o.case_id AND b.label = o.label AND b.y = o.y + dy AND b.x = o.x + dx)
  SELECT * FROM f UNION ALL SELECT case_id, label, y, x FROM free ANTI JOIN outer_ USING (case_id, label, y, x)""")
def fill_holes(spark, sf):
    return R.fill_holes(voxels(spark, sf).select("case_id", "label", "y", "x").distinct(), ["case_id", "label"], 64, 64)


@query(f"""WITH RECURSIVE {VOXELS}, {components_sql("parts", "voxels", "case_id, label", "yx")}, n AS (SELECT case_id, label, component, count(*) AS n, max(count(*)) OVER (PARTITION BY case_id, label) AS most FROM parts GROUP BY 1, 2, 3)
  SELECT case_id, label, y, x, component FROM parts JOIN n USING (case_id, label, component) WHERE n >= 6 OR (most < 6 AND component = 1)""")
def remove_islands(spark, sf):
    parts = M.connected_components(voxels(spark, sf).select("case_id", "label", "y", "x").distinct(), ["case_id", "label"], ("y", "x"))
    return R.remove_islands(parts, ["case_id", "label"], 6)


@query(f"WITH {VOXELS}, k AS (SELECT case_id, z FROM voxels WHERE label = 1 GROUP BY 1, 2 HAVING count(*) >= 30) SELECT case_id, z, count(*) AS voxels FROM voxels SEMI JOIN k USING (case_id, z) GROUP BY 1, 2")
def frame_keep(spark, sf):
    v = voxels(spark, sf)
    keep = v.where("label = 1").groupBy("case_id", "z").agg(F.count("*").alias("n")).where("n >= 30")
    return v.join(keep, ["case_id", "z"], "left_semi").groupBy("case_id", "z").agg(F.count("*").alias("voxels"))
