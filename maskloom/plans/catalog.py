"""Queries over paths, names, groups, splits, manifests and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions import keys as K
from maskloom.operators import grouping as G
from maskloom.plans.base import query
from maskloom.plans.views import FILES, MASKS, SEQUENCES, files, mask_files, sequences, table
from maskloom.sources.tables import tree_hash

_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_DIR = "regexp_replace(path, '/?[^/]*$', '')"
_EXT = f"lower(regexp_extract({_BASE}, '(?i)(\\.nii\\.gz|\\.ppm\\.gz|\\.[^.]+)$', 1))"
_STEM = f"regexp_replace({_BASE}, '(?i)(\\.nii\\.gz|\\.ppm\\.gz|\\.[^.]+)$', '')"
_SPLIT = "CASE WHEN list_contains(string_split(" + _DIR + ", '/'), 'test') THEN 'test' ELSE 'train' END"
_KEY = f"trim(regexp_replace(regexp_replace(lower({_STEM}), 'mask|label|segmentation|seg', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_')"
UNIT = "(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"

#: Ten documents make a group; the number in `_img` tells images apart.
CONFIGS = [
    G.Subdataset("short", "ct", r"(?P<id>case\d{4})(?P<frame>[0-4])_img(?P<id2>\d+)\.(?:nii\.gz|png|dcm)", r"(?P<id>case\d{4})(?P<frame>[0-4])_mask(?P<id2>\d+)_%\w+%\.png"),
    G.Subdataset("volumes", "mr", r"(?P<id>case\d{4})\d_img\d+\.nii\.gz", r"(?P<id>case\d{4})\d_mask\d+_%organ%\.png"),
]
_IMG = f"""{FILES}, matched AS (
  SELECT path, 'short' AS subdataset, regexp_extract({_BASE}, '^(case\\d{{4}})([0-4])_img(\\d+)\\.(nii\\.gz|png|dcm)$', 1) AS identifier, regexp_extract({_BASE}, '^(case\\d{{4}})([0-4])_img(\\d+)\\.(nii\\.gz|png|dcm)$', 2) AS frame, regexp_extract({_BASE}, '^(case\\d{{4}})([0-4])_img(\\d+)\\.(nii\\.gz|png|dcm)$', 3) AS id2, {_SPLIT} AS split FROM files WHERE regexp_full_match({_BASE}, '(case\\d{{4}})([0-4])_img(\\d+)\\.(nii\\.gz|png|dcm)')
  UNION ALL SELECT path, 'volumes', regexp_extract({_BASE}, '^(case\\d{{4}})', 1), NULL, NULL, {_SPLIT} FROM files WHERE regexp_full_match({_BASE}, '(case\\d{{4}})\\d_img\\d+\\.nii\\.gz'))"""
_MSK = f"""{MASKS}, mmatched AS (
  SELECT path, 'short' AS subdataset, regexp_extract({_BASE}, '^(case\\d{{4}})', 1) AS identifier, regexp_extract({_BASE}, '^case\\d{{4}}(\\d)', 1) AS frame, {_SPLIT} AS split FROM masks WHERE regexp_full_match({_BASE}, '(case\\d{{4}})([0-4])_mask(\\d+)_%\\w+%\\.png')
  UNION ALL SELECT path, 'volumes', regexp_extract({_BASE}, '^(case\\d{{4}})', 1), NULL, {_SPLIT} FROM masks WHERE regexp_full_match({_BASE}, '(case\\d{{4}})\\d_mask\\d+_%organ%\\.png'))"""
_GROUPS = f"""{_IMG}, groups AS (SELECT subdataset, split, identifier, CASE WHEN frame IS NULL THEN '{{}}' ELSE '{{"frame":"' || frame || '"}}' END AS extra_key, list_sort(list(path)) AS images,
  arg_min(CASE WHEN frame IS NULL THEN '{{}}' ELSE '{{"frame":"' || frame || '","id2":"' || id2 || '"}}' END, path) AS additional FROM matched GROUP BY 1, 2, 3, 4)"""


def _groups(spark, sf):
    return G.build_groups(G.regex_multi_match(files(spark, sf).drop("doc_id"), CONFIGS))


def _masks(spark, sf):
    return G.regex_multi_match(mask_files(spark, sf).select("path"), CONFIGS, "masks")


@query(f"WITH {FILES} SELECT path, {_EXT} AS ext, {_STEM} AS stem FROM files", name="ext_of")
def ext_of(spark, sf):
    return files(spark, sf).select("path", K.ext_of(F.col("path")).alias("ext"), K.stem_of(F.col("path")).alias("stem"))


@query(f"WITH {FILES} SELECT path FROM files WHERE contains(lower({_STEM}), '_img003')")
def mask_key_filter(spark, sf):
    return files(spark, sf).where(K.has_mask_key(F.col("path"), "_IMG003")).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT list_has_any(string_split(lower({_DIR}), '/'), ['src3', 'fr'])")
def exclude_folder_filter(spark, sf):
    return files(spark, sf).where(~K.in_folders(F.col("path"), ["SRC3", "fr"])).select("path")


@query(f"WITH {FILES} SELECT CASE WHEN {_EXT} IN ('.nii.gz', '.dcm') THEN '3D' ELSE '2D' END AS pipeline, CASE WHEN {_EXT} IN ('.nii.gz', '.dcm') THEN 3 ELSE 2 END AS dim, count(*) AS files FROM files GROUP BY 1, 2")
def pipeline_of(spark, sf):
    p = F.col("path")
    return files(spark, sf).groupBy(K.pipeline_of(p).alias("pipeline"), K.dim_of(p).alias("dim")).agg(F.count("*").alias("files"))


@query(f"WITH {FILES} SELECT path, CASE WHEN {_EXT} IN ('.nii.gz', '.dcm') THEN 3 ELSE 2 END AS dim FROM files")
def dim_of(spark, sf):
    return files(spark, sf).select("path", K.dim_of(F.col("path")).alias("dim"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_type || ' , ' || upper(p_name) || ',', ','), lambda x: lower(trim(x))), lambda x: x <> '') AS modalities FROM part")
def modality_normalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", K.modality_list(F.concat("p_type", F.lit(" , "), F.upper("p_name"), F.lit(","))).alias("modalities"))


@query("SELECT p_partkey FROM part WHERE lower(trim(p_type)) IN ('economy', 'promo')")
def modality_filter(spark, sf):
    return table(spark, sf, "part").where(K.modality_wanted(F.col("p_type"), [" Economy", "PROMO "])).select("p_partkey")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, CASE WHEN p_size % 2 = 0 THEN p_type END, p_brand, '') AS modality FROM part")
def modality_resolve(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.coalesce(F.when(F.col("p_size") % 3 == 0, F.col("p_name")), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), "p_brand", F.lit("")).alias("modality"))


@query(f"WITH {MASKS} SELECT path, regexp_extract(path, '%([^%]+)%', 1) AS class, CAST(regexp_extract(path, '_mask(\\d+)', 1) AS INT) AS mask_idx FROM masks")
def class_from_name(spark, sf):
    p = F.col("path")
    return mask_files(spark, sf).select("path", K.class_from_name(p).alias("class"), K.mask_idx_from_name(p).alias("mask_idx"))


@query(f"WITH {FILES} SELECT path, CAST(regexp_extract(path, '_img(\\d+)', 1) AS INT) AS idx, CAST(NULL AS INT) AS mask_idx FROM files")
def idx_from_name(spark, sf):
    p = F.col("path")
    return files(spark, sf).select("path", K.idx_from_name(p).alias("idx"), K.mask_idx_from_name(p).alias("mask_idx"))


@query(f"WITH {MASKS} SELECT path, {_KEY} AS stem_key FROM masks")
def stem_key(spark, sf):
    return mask_files(spark, sf).select("path", K.stem_key(F.col("path")).alias("stem_key"))


@query(f"WITH {FILES} SELECT doc_id, path AS clean, regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, substr(md5(path), 1, 8) AS short_id FROM files")
def clean_path(spark, sf):
    odd = F.concat(F.lit("file:"), F.regexp_replace("path", "/", "\\\\\\\\"), F.lit(" "))
    f = files(spark, sf).withColumn("clean", K.clean_path(odd))
    return f.select("doc_id", "clean", K.safe_name(F.col("clean")).alias("safe"), K.short_id(F.col("clean")).alias("short_id"))


@query("SELECT s_suppkey, 'P-' || lpad(CAST(s_suppkey AS VARCHAR), greatest(4, length(CAST(s_suppkey AS VARCHAR)))::INT, '0') AS padded, s_name AS other FROM supplier")
def pad_id(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", K.pad_id(F.concat(F.lit("P-"), F.col("s_suppkey").cast("string")), "P-", 4).alias("padded"), K.pad_id(F.col("s_name"), "P-", 4).alias("other"))


@query("SELECT o_orderkey, substr(md5(o_orderpriority || ':' || o_orderkey), 1, 8) AS short_id FROM orders")
def short_id(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", K.short_id(F.concat("o_orderpriority", F.lit(":"), F.col("o_orderkey").cast("string"))).alias("short_id"))


@query(f"WITH {FILES}, e AS (SELECT split_part(path, '/', 1) AS source, split_part(path, '/', 2) AS lang, list_distinct(list(CASE WHEN {_EXT} = '.png' THEN 'image' ELSE 'volume' END)) AS k FROM files GROUP BY 1, 2) SELECT source, lang, CASE WHEN len(k) = 1 THEN k[1] ELSE 'mixed' END AS category FROM e")
def file_type_category(spark, sf):
    f = files(spark, sf).withColumn("ext", K.ext_of(F.col("path")))
    parts = F.split("path", "/")
    return f.groupBy(parts[0].alias("source"), parts[1].alias("lang")).agg(K.file_type_category(F.collect_set("ext")).alias("category"))


@query(f"WITH {FILES} SELECT split_part(path, '/', 1) AS source, sha256(string_agg(path || chr(0), '' ORDER BY path)) AS input_hash, md5(string_agg(path, ';' ORDER BY path)) AS config_hash FROM files GROUP BY 1")
def input_hash(spark, sf):
    f = files(spark, sf).groupBy(F.split("path", "/")[0].alias("source")).agg(F.array_sort(F.collect_list("path")).alias("p"))
    nul = F.decode(F.unhex(F.lit("00")), "utf-8")
    return f.select("source", F.sha2(F.concat(F.array_join("p", "\0"), nul), 256).alias("input_hash"), F.md5(F.array_join("p", ";").cast("binary")).alias("config_hash"))


# Leaves of equal path are one with their number; nodes by the first 6, 4, 2 and 0 hex digits.
@query(f"""WITH {FILES}, l AS (SELECT split_part(path, '/', 1) AS source, sha256(path) AS h, count(*) AS n FROM files GROUP BY 1, 2),
  a AS (SELECT source, h[1:6] AS pre, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS h FROM l GROUP BY 1, 2), b AS (SELECT source, pre[1:4] AS pre, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM a GROUP BY 1, 2),
  c AS (SELECT source, pre[1:2] AS pre, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM b GROUP BY 1, 2) SELECT source, sha256(string_agg(h, ',' ORDER BY h)) AS tree_hash FROM c GROUP BY 1""")
def input_tree_hash(spark, sf):
    return tree_hash(files(spark, sf).withColumn("source", F.split("path", "/")[0]), ["source"], "path")


@query(f"WITH {FILES} SELECT path, CASE WHEN regexp_full_match({_BASE}, 'case(\\d+)_img\\d+\\.png') THEN regexp_extract({_BASE}, 'case(\\d+)_', 1) END AS by_file, CASE WHEN regexp_full_match({_BASE}, 'case(\\d+)_img\\d+\\.png') THEN regexp_extract({_BASE}, 'case(\\d+)_', 1) ELSE {_SPLIT} END AS by_folder, {_STEM} AS by_name, regexp_extract(path, '^([^/]+)/', 1) AS by_path FROM files")
def extract_id(spark, sf):
    p, pat = F.col("path"), r"case(?P<id>\d+)_img\d+\.png"
    return files(spark, sf).select("path", K.extract_id(p, "regex-file", pat).alias("by_file"), K.extract_id(p, "regex-folder", pat).alias("by_folder"), K.extract_id(p, "filename").alias("by_name"), K.extract_id(p, "regex", r"(?P<id>[^/]+)/.*").alias("by_path"))


@query(f"WITH {_IMG} SELECT path, subdataset, split || '_' || identifier || CASE WHEN frame IS NULL THEN '' ELSE '___ID2__' || id2 || '___' || frame END AS composite_id FROM matched")
def composite_id(spark, sf):
    m = G.regex_multi_match(files(spark, sf).drop("doc_id"), CONFIGS)
    return m.select("path", "subdataset", K.composite_id(G.split_of(F.col("path")), F.col("identifier"), F.col("extras")).alias("composite_id"))


@query(f"WITH {_IMG} SELECT path, subdataset, identifier FROM matched")
def regex_multi_match(spark, sf):
    return G.regex_multi_match(files(spark, sf).drop("doc_id"), CONFIGS).select("path", "subdataset", "identifier")


@query(f"WITH {_IMG} SELECT path, min(subdataset) AS subdataset, min(identifier) AS identifier FROM matched GROUP BY 1")
def regex_first_match(spark, sf):
    return G.regex_first_match(files(spark, sf).drop("doc_id"), CONFIGS)


@query(f"WITH {_GROUPS} SELECT * FROM groups")
def build_groups(spark, sf):
    return _groups(spark, sf)


_JOINED = f"""{_GROUPS}, {_MSK}, m AS (SELECT subdataset, split, identifier, CASE WHEN frame IS NULL THEN '{{}}' ELSE '{{"frame":"' || frame || '"}}' END AS extra_key, list_sort(list(path)) AS masks FROM mmatched GROUP BY 1, 2, 3, 4),
  joined AS (SELECT g.subdataset, g.split, g.identifier, g.extra_key, images, coalesce(masks, []) AS masks FROM groups g LEFT JOIN m USING (subdataset, split, identifier, extra_key))"""


@query(f"WITH {_JOINED} SELECT * FROM joined")
def group_mask_join(spark, sf):
    return G.group_mask_join(_groups(spark, sf).drop("additional"), _masks(spark, sf))


@query(f"WITH {_JOINED} SELECT subdataset || '.' || split || ':' || identifier AS group_name FROM joined WHERE len(masks) = 0")
def unannotated_groups(spark, sf):
    return G.unannotated(G.group_mask_join(_groups(spark, sf), _masks(spark, sf)))


@query(f"WITH {_GROUPS}, {_MSK}, t AS (SELECT identifier, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS h FROM groups GROUP BY 1) SELECT DISTINCT path, identifier, CASE WHEN h = 1 THEN 'train' ELSE 'test' END AS split FROM mmatched JOIN t USING (identifier)")
def group_mask_join_default(spark, sf):
    m = _masks(spark, sf).select("path", "identifier").distinct()
    return G.group_mask_join_default(_groups(spark, sf), m)


@query(f"""WITH {_IMG}, two AS (SELECT subdataset, path, split, identifier FROM matched UNION ALL SELECT subdataset, path, split, 'again' FROM matched WHERE path LIKE '%5_img%' AND frame IS NULL)
  SELECT subdataset, path, list_sort(list(DISTINCT split || '|' || identifier || '|{{}}')) AS groups FROM two WHERE subdataset = 'volumes' GROUP BY 1, 2 HAVING count(DISTINCT identifier) > 1""", name="duplicate_path_check")
def duplicate_path_check(spark, sf):
    m = G.regex_multi_match(files(spark, sf).drop("doc_id"), CONFIGS).where("subdataset = 'volumes'")
    return G.duplicate_paths(m.unionByName(m.where("path like '%5_img%'").withColumn("identifier", F.lit("again"))))


@query(f"WITH {_GROUPS}, g AS (SELECT *, max(CASE WHEN split = 'test' AND subdataset = 'volumes' THEN 1 ELSE 0 END) OVER (PARTITION BY subdataset) AS h FROM groups WHERE subdataset = 'volumes' OR split = 'train') SELECT subdataset, identifier, extra_key, CASE WHEN h = 1 THEN split WHEN {UNIT.format(seed=7, key='subdataset || identifier || extra_key')} < 0.8 THEN 'train' ELSE 'test' END AS split FROM g")
def bernoulli_split(spark, sf):
    g = _groups(spark, sf).where("subdataset = 'volumes' or split = 'train'").select("subdataset", "identifier", "extra_key", "split")
    return G.bernoulli_split(g, F.concat("subdataset", "identifier", "extra_key"), 0.8, 7)


_TASKROWS = f"{SEQUENCES}, t AS (SELECT idx, dataset, subdataset, dim, unnest(tasks) AS task FROM sequences)"


@query(f"WITH {_TASKROWS} SELECT task, list_sort(list(DISTINCT 'c' || (idx % 4))) AS classes, list_sort(list(DISTINCT dataset || '/' || subdataset)) AS places FROM t GROUP BY 1", name="global_tasks")
def global_tasks(spark, sf):
    s = sequences(spark, sf).select("dataset", "subdataset", F.explode("tasks").alias("task"), F.concat(F.lit("c"), (F.col("idx") % 4).cast("string")).alias("class"))
    return G.global_tasks(s)


@query(f"WITH {SEQUENCES} SELECT subdataset AS task, list_sort(list(DISTINCT dataset || '/' || subdataset)) AS places, ['c'] AS classes FROM sequences GROUP BY 1")
def tasks_from_pairs(spark, sf):
    return G.global_tasks(sequences(spark, sf).select(F.col("subdataset").alias("task"), F.lit("c").alias("class"), "dataset", "subdataset"))


_REFINE = f"{SEQUENCES}, tc AS (SELECT 'k' || (i % 5) AS task, 'c' || (i % 7) AS class FROM range(0, 12) r(i))"


@query(f"""WITH {_REFINE}, p AS (SELECT idx AS pair_id, 'c' || (idx % 7) AS class, list_sort(tasks) AS tasks FROM sequences), f AS (SELECT pair_id, list_sort(list(DISTINCT u.task)) AS fit FROM (SELECT pair_id, class, unnest(tasks) AS task FROM p) u JOIN tc ON tc.task = u.task AND tc.class = u.class GROUP BY 1)
  SELECT pair_id, class, coalesce(fit, tasks) AS tasks FROM p LEFT JOIN f USING (pair_id)""")
def task_refine(spark, sf):
    tc = spark.range(12).select(F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("task"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("class"))
    p = sequences(spark, sf).select(F.col("idx").alias("pair_id"), F.concat(F.lit("c"), (F.col("idx") % 7).cast("string")).alias("class"), "tasks")
    return G.task_refine(p, tc)


@query(f"WITH {_TASKROWS} SELECT dim, task, idx FROM t WHERE (task, dataset, subdataset) IN (SELECT task, dataset, subdataset FROM t WHERE idx % 3 = 0)")
def task_membership(spark, sf):
    s = sequences(spark, sf)
    places = s.where("idx % 3 = 0").select(F.explode("tasks").alias("task"), "dataset", "subdataset").distinct()
    return G.task_membership(s, places)


@query(f"WITH {_TASKROWS} SELECT DISTINCT subdataset, task FROM t WHERE task IN (SELECT 'k' || i FROM range(0, 3) r(i))")
def subdataset_tasks(spark, sf):
    rules = spark.range(3).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("task"))
    return sequences(spark, sf).select("subdataset", F.explode("tasks").alias("task")).join(rules, "task").select("subdataset", "task").distinct()


_PROC = "g AS (SELECT doc_id AS group_id, list_transform(range(0, doc_id % 3 + 1), lambda i: 'p' || doc_id || '_' || i) AS proc_images FROM documents)"


@query(f"""WITH {_PROC}, m AS (SELECT doc_id AS group_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 4 AS INT) END AS image_index, CAST(doc_id % 5 AS INT) AS dimension FROM labels)
  SELECT group_id, image_index, dimension, CASE WHEN image_index IS NULL THEN 'index_missing' WHEN image_index >= coalesce(len(proc_images), 0) THEN 'index_out_of_range' WHEN dimension NOT IN (2, 3) THEN 'bad_dimension' END AS reason, CASE WHEN reason IS NULL THEN proc_images[image_index + 1] END AS image FROM m LEFT JOIN g USING (group_id)""")
def pair_explicit(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    g = d.select(F.col("doc_id").alias("group_id"), F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string"))).alias("proc_images"))
    m = lab.select(F.col("doc_id").alias("group_id"), F.when(F.col("doc_id") % 11 == 0, None).otherwise((F.col("doc_id") % 4).cast("int")).alias("image_index"), (F.col("doc_id") % 5).cast("int").alias("dimension"))
    return G.pair_explicit(m, g).select("group_id", "image_index", "dimension", "reason", "image")


@query(f"""WITH {FILES}, {MASKS}, i AS (SELECT doc_id // 10 AS group_id, path, CAST(regexp_extract({_BASE}, '_img(\\d+)', 1) AS INT) AS n, {_KEY} AS k FROM files), m AS (SELECT doc_id // 10 AS group_id, path, CAST(regexp_extract({_BASE}, '_mask(\\d+)', 1) AS INT) AS n FROM masks)
  SELECT m.group_id, m.path AS mask, max(i.path) AS image FROM m LEFT JOIN i ON m.group_id = i.group_id AND m.n = i.n GROUP BY 1, 2""")
def pair_fallback(spark, sf):
    grouped = lambda df: df.select(F.floor(F.col("doc_id") / 10).cast("long").alias("group_id"), "path")
    return G.pair_fallback(grouped(mask_files(spark, sf)), grouped(files(spark, sf)))


@query("WITH p AS (SELECT doc_id, 'case' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '_0000' ELSE '' END || '_k' || printf('%03d', doc_id % 9) || '_mask.png' AS pred FROM documents), t AS (SELECT 'case' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '_0000' ELSE '' END || '.nii.gz' AS gt, 'case' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '_0000' ELSE '' END AS b FROM labels) SELECT pred, coalesce(a.gt, c.gt) AS gt FROM p LEFT JOIN t a ON regexp_replace(pred, '_k\\d+_mask\\.png$', '') = a.b LEFT JOIN t c ON regexp_replace(regexp_replace(pred, '_k\\d+_mask\\.png$', ''), '_0000$', '') = c.b")
def pred_gt_join(spark, sf):
    name = lambda k: F.concat(F.lit("case"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % k == 0, "_0000").otherwise(""))
    p = table(spark, sf, "documents").select(F.concat(name(2), F.format_string("_k%03d_mask.png", F.col("doc_id") % 9)).alias("pred"))
    return G.pred_gt_join(p, table(spark, sf, "labels").select(F.concat(name(4), F.lit(".nii.gz")).alias("gt")))


@query(f"WITH {FILES}, {MASKS} SELECT f.path AS image, m.path AS mask FROM files f JOIN masks m ON regexp_replace({_STEM.replace('path', 'f.path')}, '_img\\d+$', '') = regexp_replace({_STEM.replace('path', 'm.path')}, '_mask\\d+_%\\w+%$', '')")
def stem_pair_join(spark, sf):
    i = files(spark, sf).select(F.col("path").alias("image"), F.regexp_replace(K.stem_of(F.col("path")), r"_img\d+$", "").alias("k"))
    m = mask_files(spark, sf).select(F.col("path").alias("mask"), F.regexp_replace(K.stem_of(F.col("path")), r"_mask\d+_%\w+%$", "").alias("k"))
    return i.join(m, "k").select("image", "mask")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels", name="exists_check")
def exists_check(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti").distinct()


@query("SELECT doc_id AS key FROM documents INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def common_keys(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("key")).intersect(table(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey"))


@query("SELECT doc_id, CASE WHEN side THEN 'left' ELSE 'right' END AS side FROM (SELECT doc_id, true AS side FROM documents WHERE doc_id % 3 > 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, false FROM labels WHERE doc_id % 3 = 0)")
def unmatched_both_ways(spark, sf):
    return G.unmatched_both_ways(table(spark, sf, "documents").where("doc_id % 3 > 0"), table(spark, sf, "labels"), "doc_id")


@query("SELECT 'Brand#' || i AS dataset FROM range(1, 60) r(i) WHERE 'Brand#' || i NOT IN (SELECT p_brand FROM part)")
def missing_requested(spark, sf):
    wanted = spark.range(1, 60).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("dataset"))
    return wanted.exceptAll(table(spark, sf, "part").select(F.col("p_brand").alias("dataset")).distinct())


@query(f"WITH {FILES} SELECT DISTINCT {_DIR} AS folder FROM files")
def distinct_paths(spark, sf):
    return files(spark, sf).select(K.dir_of(F.col("path")).alias("folder")).dropDuplicates()


@query(f"WITH {FILES} SELECT split, count(*) AS files FROM (SELECT 'train' AS split FROM files WHERE path LIKE '%/train/%' UNION ALL SELECT 'test' FROM files WHERE path LIKE '%/test/%') GROUP BY 1")
def union_splits(spark, sf):
    f = files(spark, sf).withColumn("split", G.split_of(F.col("path")))
    return f.where("split = 'train'").unionByName(f.where("split = 'test'")).groupBy("split").agg(F.count("*").alias("files"))


@query(f"WITH {FILES} SELECT DISTINCT {_DIR} AS folder FROM files WHERE contains(lower({_DIR}), 'rc1')")
def folder_resolve(spark, sf):
    d = K.dir_of(F.col("path"))
    return files(spark, sf).select(d.alias("folder")).where(F.contains(F.lower("folder"), F.lit("rc1"))).distinct()


@query(f"WITH {FILES} SELECT DISTINCT {_DIR} AS folder FROM files WHERE regexp_extract({_DIR}, '([^/]*)$', 1) = 'test' OR contains(regexp_extract({_DIR}, '([^/]*)$', 1), 'tes')")
def mask_folder_resolve(spark, sf):
    d = files(spark, sf).select(K.dir_of(F.col("path")).alias("folder"))
    return d.where((K.base_of(F.col("folder")) == "test") | F.contains(K.base_of(F.col("folder")), F.lit("tes"))).distinct()


@query(f"WITH {FILES} SELECT {_EXT} AS ext, count(*) AS files FROM files GROUP BY 1")
def ext_histogram(spark, sf):
    return files(spark, sf).groupBy(K.ext_of(F.col("path")).alias("ext")).agg(F.count("*").alias("files"))


@query("SELECT count(text) AS text, count(lang) AS lang, count(*) FILTER (length(text) > 4000) AS long_text, count(*) AS rows FROM documents")
def key_presence(spark, sf):
    return table(spark, sf, "documents").agg(F.count_if(F.isnotnull("text")).alias("text"), F.count_if(F.isnotnull("lang")).alias("lang"), F.count_if(F.length("text") > 4000).alias("long_text"), F.count("*").alias("rows"))


@query(f"WITH {FILES}, n AS (SELECT doc_id % 50 AS patient, {_DIR} AS folder, count(*) AS n FROM files GROUP BY 1, 2) SELECT patient, folder, n FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY n DESC, folder) AS r FROM n) WHERE r = 1")
def best_folder(spark, sf):
    return G.best_folder(files(spark, sf).withColumn("patient", F.col("doc_id") % 50), "patient")


_INDEX = "i AS (SELECT 'id' || doc_id AS identifier, 'img' || doc_id AS first_image, 'msk' || doc_id AS first_mask FROM documents), d AS (SELECT 'new' || doc_id || '_' || k AS identifier, 'img' || doc_id AS first_image, 'msk' || (doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS first_mask, ['p' || k] AS proc_images FROM labels, range(0, 2) r(k))"


@query(f"WITH {_INDEX} SELECT coalesce(d.identifier, i.identifier) AS identifier, i.first_image, i.first_mask, d.proc_images, d.identifier IS NOT NULL AS matched FROM i LEFT JOIN d ON i.first_image = d.first_image AND i.first_mask = d.first_mask")
def manifest_merge(spark, sf):
    s = lambda p, c=F.col("doc_id"): F.concat(F.lit(p), c.cast("string"))
    i = table(spark, sf, "documents").select(s("id").alias("identifier"), s("img").alias("first_image"), s("msk").alias("first_mask"))
    lab = table(spark, sf, "labels").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    shift = F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    d = lab.select(F.concat(s("new"), F.lit("_"), F.col("k").cast("string")).alias("identifier"), s("img").alias("first_image"), s("msk", shift).alias("first_mask"), F.array(s("p", F.col("k"))).alias("proc_images"))
    return G.manifest_merge(i, d)


@query("WITH g AS (SELECT o_custkey AS locator, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'accepted' WHEN 'P' THEN 'partial' ELSE 'rejected' END AS status FROM orders), one AS (SELECT locator, arg_min(status, seq) AS status FROM g GROUP BY 1) SELECT count(*) AS attempted, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'partial') AS partial FROM one")
def report_status_counts(spark, sf):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "failed").when(s == "O", "accepted").when(s == "P", "partial").otherwise("rejected")
    return G.report_status_counts(table(spark, sf, "orders").select(F.col("o_custkey").alias("locator"), F.col("o_orderkey").alias("seq"), status.alias("status")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 = 0 THEN 'partial' WHEN o_orderkey % 3 > 0 THEN 'accepted' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'rejected' END AS status FROM orders")
def group_status(spark, sf):
    o = table(spark, sf, "orders")
    stage = F.when(F.col("o_orderkey") % 5 == 0, F.lit("write"))
    return o.select("o_orderkey", G.group_status(F.col("o_orderkey") % 3, stage, F.array()).alias("status"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P') AND o_orderkey % 2 = 0")
def status_filter(spark, sf):
    return table(spark, sf, "orders").where(~F.col("o_orderstatus").isin("F", "P")).where("o_orderkey % 2 = 0").select("o_orderkey")


@query("SELECT p_partkey, list_transform(list_filter(string_split('size=' || p_size || ' | brand = ' || p_brand || '|junk|t=' || p_type, '|'), lambda x: contains(x, '=')), lambda x: trim(x[1:instr(x, '=') - 1]) || '=' || trim(x[instr(x, '=') + 1:])) AS classes FROM part")
def parse_classes(spark, sf):
    spec = F.concat(F.lit("size="), F.col("p_size").cast("string"), F.lit(" | brand = "), F.col("p_brand"), F.lit("|junk|t="), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.transform(K.parse_pairs(spec, "|", "="), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("classes"))
