"""Readers and writers: catalogs, listings, manifests, tolerant JSON lines, caches, partitioned results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import IntegerType, StructField, StructType

from maskloom.functions.keys import ext_of, parse_pairs
from maskloom.operators.profiles import ranked

#: Columns of a dataset catalog that hold comma lists.
LISTS = ("modality", "image_file_type", "mask_file_type", "train_folders", "test_folders", "mask_folders")
GROUPS = "subdatasets array<struct<modality string, name string, train array<struct<identifier string, images array<string>, masks array<string>>>, test array<struct<identifier string, images array<string>, masks array<string>>>>>"


def catalog(raw: DataFrame) -> DataFrame:
    """A dataset catalog read as text: trimmed, blanks to null, comma lists split, strategy `regex` and background 0 by default, flag as boolean."""
    x = raw.select(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c.strip().lower().replace(" ", "_").replace("?", "")) for c in raw.columns])
    lists = {c: F.filter(F.transform(F.split(c, ","), lambda v: F.trim(v)), lambda v: v != "") for c in LISTS if c in x.columns}
    return x.withColumns(lists | {"grouping_strategy": F.lower(F.coalesce("grouping_strategy", F.lit("regex"))), "background_value": F.coalesce(F.expr("try_cast(background_value as int)"), F.lit(0)), "preprocessed": F.lower(F.coalesce("preprocessed", F.lit("no"))) == "yes"})


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog(spark.read.option("header", True).option("multiLine", True).csv(path))


def ct_datasets(cat: DataFrame) -> DataFrame:
    """Names of datasets with `ct` among their modalities."""
    return cat.where(F.array_contains(F.transform("modality", F.lower), "ct")).select("dataset_name").distinct()


def list_files(spark: SparkSession, root: str, exts: list[str]) -> DataFrame:
    """Paths, sizes and times below a folder, for allowed extensions; the content is not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return f.where(ext_of(F.col("path")).isin(*exts)).dropDuplicates(["path"]).orderBy("path")


def list_tables(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """path, length, files of each table below a folder: a file with the extension, or a folder named like one with its part files."""
    top = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    below = F.regexp_replace("path", f"^.*?{re.escape(top)}/", "")
    first = F.regexp_extract(below, f"^(.*?{re.escape(ext)})(?:/.*)?$", 1)  # the outermost name with the extension
    return list_files(spark, root, [ext]).groupBy(first.alias("path")).agg(F.sum("length").alias("length"), F.count("*").alias("files"))


def groups(doc: DataFrame) -> DataFrame:
    """Rows of a nested groups document: subdataset, modality, split, locator and the group's fields."""
    s = doc.select(F.inline("subdatasets"))
    side = lambda name: s.select("modality", F.col("name").alias("subdataset"), F.lit(name).alias("split"), F.posexplode(name).alias("position", "g"))
    return side("train").unionByName(side("test")).select("modality", "subdataset", "split", "position", "g.identifier", "g.images", "g.masks")


def nested(rows: DataFrame) -> DataFrame:
    """The document of `groups` from rows (modality, subdataset, split, identifier, images, masks), one row per subdataset: for subdatasets that fit a row. `write_groups` is for all."""
    g = F.struct("identifier", "images", "masks")
    part = lambda s: F.array_sort(F.filter(F.collect_list(F.when(F.col("split") == s, g)), lambda x: x.isNotNull())).alias(s)
    return rows.groupBy("modality", F.col("subdataset").alias("name")).agg(part("train"), part("test"))


#: Columns of a part of a groups document, and of its heads.
PART = "modality string, subdataset string, split string, part long, first long, groups array<struct<identifier string, images array<string>, masks array<string>>>"
HEAD = "modality string, subdataset string, train long, test long, parts long"


def write_groups(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A groups document of any size as JSON lines below `path`, written by Spark's committer: `parts` has rows of up to `most` groups of a subdataset and split in order, `heads` a row per
    subdataset with its groups and parts. The heads come last, so a document without them is not whole."""
    x = ranked(rows.select("modality", "subdataset", "split", "identifier", "images", "masks"), ["modality", "subdataset", "split"], ["identifier", "images", "masks"])
    x = x.withColumn("part", F.floor((F.col("position") - 1) / most))
    g = F.array_sort(F.collect_list(F.struct("position", F.struct("identifier", "images", "masks").alias("g"))))
    parts = x.groupBy("modality", "subdataset", "split", "part").agg((F.col("part") * most + 1).alias("first"), F.transform(g, lambda e: e["g"]).alias("groups"))
    parts.write.option("compression", "gzip").json(f"{path}/parts")
    n = rows.sparkSession.read.schema(PART).json(f"{path}/parts").select("modality", "subdataset", "split", F.size("groups").alias("n"))
    count = lambda split: F.coalesce(F.sum(F.when(F.col("split") == split, F.col("n"))), F.lit(0)).cast("long").alias(split)
    n.groupBy("modality", "subdataset").agg(count("train"), count("test"), F.count("*").alias("parts")).write.json(f"{path}/heads")


def group_heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEAD).json(f"{path}/heads")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a document in parts, as those of `groups`, of the subdatasets that have a head."""
    parts, heads = spark.read.schema(PART).json(f"{path}/parts"), group_heads(spark, path)
    same = parts["modality"].eqNullSafe(heads["modality"]) & parts["subdataset"].eqNullSafe(heads["subdataset"])
    x = parts.join(heads, same, "left_semi").select("modality", "subdataset", "split", "first", F.posexplode("groups").alias("i", "g"))
    return x.select("modality", "subdataset", "split", (F.col("first") - 1 + F.col("i")).alias("position"), "g.identifier", "g.images", "g.masks")


def tolerant_json(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows of JSON lines (column `value`), and counts of blank and malformed lines."""
    x = lines.withColumn("blank", F.trim("value") == "").withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = ~F.col("blank") & (F.col("r").isNull() | F.col("r._bad").isNotNull())
    return x.where(~F.col("blank") & ~bad).select("r.*").drop("_bad"), x.agg(F.count_if("blank").alias("blank"), F.count_if(bad).alias("malformed"), F.count_if(~F.col("blank") & ~bad).alias("rows"))


def fresh_stats(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cached rows of wanted files whose size and time are still the same."""
    return cache.join(files.select("path", "length", "mtime"), ["path", "length", "mtime"], "left_semi")


#: Column and number of the parts that a cache is laid out in, by a hash of its keys.
BUCKET, BUCKETS = "cache_bucket", 64


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def in_buckets(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def bucket_rows(spark: SparkSession, path: str, schema, new: DataFrame) -> DataFrame:
    """The rows of a cache laid out in buckets that lie in those of `new` (a column BUCKET): other parts are not read."""
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
    return spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(path).where(F.col(BUCKET).isin(touched))


def _same_keys(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])


def append_stats(path: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Append the rows whose keys the cache at `path` does not have yet, and return the cache; nulls count as values.

    The cache is laid out by a hash of the keys (always the same number of buckets); only the parts that new keys may lie in are read, and no file is written anew."""
    spark = rows.sparkSession
    new = in_buckets(rows.dropDuplicates(keys), keys, buckets)
    if _exists(spark, path):
        old = bucket_rows(spark, path, rows.schema, new).select(*[F.col(k).alias(f"__{k}") for k in keys])
        new = new.join(old, _same_keys(keys), "left_anti")
    new.repartition(F.col(BUCKET)).write.mode("append").partitionBy(BUCKET).parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def upsert(path: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Put rows in the cache at `path` in place of those with the same keys, and return the cache; of `rows` with the same keys one stays.

    The cache is laid out as by `append_stats`. Only the parts that have a key of `rows` are read and replaced, by dynamic partition overwrite: the files of all others stay as they are."""
    spark = rows.sparkSession
    new = in_buckets(rows.dropDuplicates(keys), keys, buckets)
    if _exists(spark, path):
        new = cache_merge(bucket_rows(spark, path, rows.schema, new).select(*new.columns), new, [*keys, BUCKET])
    new.repartition(F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def resume_rows(jsonl: DataFrame, csv: DataFrame, keys: list[str], order: str) -> tuple[str | None, DataFrame]:
    """The rows to resume from, and their source: of both logs the ok rows count; the JSON lines win unless the table has more.

    Of JSON lines the last row (by `order`) of each key stays, and all rows without a whole key; rows of the table stay as they are. Without rows the source is None."""
    ok = lambda df: df.where(F.lower("status") == "ok")
    lines, rows = ok(jsonl), ok(csv)
    n_lines, n_rows = lines.count(), rows.count()
    if n_lines and n_lines >= n_rows:
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        rest = [c for c in lines.columns if c not in keys]
        last = lines.where(whole).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
        return "jsonl", last.select(*lines.columns).unionByName(lines.where(~whole))
    return ("csv", rows) if n_rows else (None, rows)


def cache_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows; the new one wins."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__new").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def tree_hash(rows: DataFrame, keys: list[str], text: str, steps: tuple[int, ...] = (6, 4, 2, 0)) -> DataFrame:
    """keys and `tree_hash`: a digest of the texts of each group, the same in any order and dealing, without a group in one place.

    A leaf is the SHA-256 of a text with its number, `hash:number`. Leaves whose hashes begin with the same 6 hex digits make a node, the SHA-256 of the sorted leaves joined by commas; nodes of the same
    4 digits the next one, and so on to the root. Digests of parts add up: leaves of equal hash add their numbers. Null texts do not count; a group of nulls has the digest of nothing."""
    leaf = rows.where(F.col(text).isNotNull()).groupBy(*keys, F.sha2(F.col(text).cast("string"), 256).alias("h")).agg(F.count("*").alias("n"))
    node = leaf.select(*keys, F.substring("h", 1, steps[0]).alias("at"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("h"))
    for size in steps:
        if not size:  # groups of nulls join at the root
            node = node.unionByName(rows.select(*keys).distinct().select(*keys, F.lit("").alias("at"), F.lit(None).cast("string").alias("h")))
        node = node.groupBy(*keys, F.substring("at", 1, size).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return node.select(*keys, F.col("h").alias("tree_hash"))


def artifacts(spark: SparkSession, folder: str, names: dict[str, list[str]]) -> dict[str, DataFrame | None]:
    """For each kind of artifact the first of its CSV files that is in the folder, read as text columns; None where none is."""
    found = {kind: next((f"{folder}/{n}" for n in own if _exists(spark, f"{folder}/{n}")), None) for kind, own in names.items()}
    return {kind: spark.read.option("header", True).csv(path) if path else None for kind, path in found.items()}


def artifact_counts(spark: SparkSession, found: dict[str, DataFrame | None]) -> DataFrame:
    """artifact, rows, columns; zeros for a missing one."""
    one = lambda kind, df: df.agg(F.lit(kind).alias("artifact"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns")) if df is not None else spark.range(1).select(F.lit(kind).alias("artifact"), F.lit(0).cast("long").alias("rows"), F.lit(0).alias("columns"))
    return reduce(DataFrame.unionByName, [one(kind, df) for kind, df in found.items()])


def quality_cache(spark: SparkSession, path: str, params: str, own: int, trusted: list[int]) -> DataFrame:
    """Rows of a quality cache laid out by parameter set: all of the set `own`, and of the sets in `trusted` those that passed; the parts of other sets are not read."""
    cache = spark.read.parquet(path).where(F.col(params).isin(own, *trusted))
    return cache.where((F.col(params) == own) | F.col("ok")).drop(params)


def write_by_model(df: DataFrame, path: str) -> DataFrame:
    """Results as Parquet by model, and the rows of each. Models are few and large: Spark deals each over as many tasks as its size asks for, and small ones share a task."""
    df.hint("rebalance", "model").write.mode("overwrite").partitionBy("model").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("model").agg(F.count("*").alias("rows"))


def rle_cells(text: Column) -> Column:
    """Places (from 0, row by row) of a run-length text of 1-based starts and lengths; empty for a missing one."""
    n = F.transform(F.filter(F.split(F.coalesce(F.trim(text), F.lit("")), " +"), lambda x: x != ""), lambda x: x.cast("int"))
    runs = F.transform(F.filter(F.transform(n, lambda x, i: F.when(i % 2 == 0, F.struct((x - 1).alias("a"), F.get(n, i + 1).alias("k")))), lambda r: r.isNotNull()), lambda r: F.when(r["k"] > 0, F.sequence(r["a"], r["a"] + r["k"] - 1)))
    return F.flatten(F.filter(runs, lambda r: r.isNotNull()))


def options(defaults: dict[str, str], general: Column, own: Column) -> Column:
    """Options by falling precedence: the subdataset's own, the dataset's, the defaults; texts are `key: value; ...`."""
    as_map = lambda c: F.map_from_entries(F.transform(parse_pairs(c, ";", ":"), lambda e: F.struct(e["key"], e["value"])))
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    merged = F.map_zip_with(F.map_zip_with(base, as_map(general), lambda k, a, b: F.coalesce(b, a)), as_map(own), lambda k, a, b: F.coalesce(b, a))
    return merged
