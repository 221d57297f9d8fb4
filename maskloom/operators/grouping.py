"""From file listings to groups, splits, checks, tasks and pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import keys as K


@dataclass(frozen=True)
class Subdataset:
    """Name, modality and the patterns of its image and mask paths."""

    name: str
    modality: str
    images: str
    masks: str


def regex_multi_match(files: DataFrame, configs: list[Subdataset], side: str = "images") -> DataFrame:
    """Each file with every config whose pattern its name matches: id, extra captures. The files are read once: a projection tries all patterns."""
    name, hits = K.base_of(F.col("path")), []
    for c in configs:
        p = K.Pattern(getattr(c, side))
        hits.append(F.when(p.matches(name), F.struct(F.lit(c.name).alias("subdataset"), p.group(name, "id").alias("identifier"), p.extras(name).alias("extras"))))
    found = files.select("*", F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    return found.where("identifier is not null")


def regex_first_match(files: DataFrame, configs: list[Subdataset], side: str = "images") -> DataFrame:
    """Each file with the first config that matches."""
    name = K.base_of(F.col("path"))
    tests = [(K.Pattern(getattr(c, side)), c.name) for c in configs]
    hit = F.coalesce(*[F.when(p.matches(name) & p.group(name, "id").isNotNull(), F.struct(F.lit(n).alias("subdataset"), p.group(name, "id").alias("identifier"))) for p, n in tests])
    return files.withColumn("hit", hit).where("hit is not null").select("*", "hit.*").drop("hit")


def split_of(path: Column) -> Column:
    return F.when(F.array_contains(F.split(K.dir_of(path), "/"), "test"), "test").otherwise("train")


def group_key(extras: Column) -> Column:
    """Stable text of the captures without `id2`."""
    return F.to_json(F.map_from_entries(F.array_sort(F.filter(F.map_entries(extras), lambda e: e["key"] != "id2"))))


def build_groups(matched: DataFrame) -> DataFrame:
    """Images by split, subdataset, id and captures but `id2`; images by path; `additional` from the first image."""
    x = matched.withColumn("split", split_of(F.col("path"))).withColumn("extra_key", group_key(F.col("extras")))
    return x.groupBy("subdataset", "split", "identifier", "extra_key").agg(F.array_sort(F.collect_list("path")).alias("images"), F.min_by(F.to_json("extras"), "path").alias("additional"))


def group_mask_join(groups: DataFrame, masks: DataFrame) -> DataFrame:
    """Masks of the same subdataset, split, id and captures, attached to groups that have images; the others have none."""
    m = masks.withColumn("split", split_of(F.col("path"))).withColumn("extra_key", group_key(F.col("extras")))
    m = m.groupBy("subdataset", "split", "identifier", "extra_key").agg(F.array_sort(F.collect_list("path")).alias("masks"))
    return groups.join(m, ["subdataset", "split", "identifier", "extra_key"], "left").withColumn("masks", F.coalesce("masks", F.array().cast("array<string>")))


def group_mask_join_default(groups: DataFrame, masks: DataFrame) -> DataFrame:
    """Without configs: masks go to the train group of their id, else to the test group, else nowhere."""
    by = groups.groupBy("identifier").agg(F.max((F.col("split") == "train").cast("int")).alias("has_train"))
    return masks.join(by, "identifier").select("path", "identifier", F.when(F.col("has_train") == 1, "train").otherwise("test").alias("split"))


def duplicate_paths(matched: DataFrame) -> DataFrame:
    """Paths that are in more than one group of a subdataset, with their groups."""
    x = matched.withColumn("g", F.concat_ws("|", split_of(F.col("path")), "identifier", group_key(F.col("extras"))))
    return x.groupBy("subdataset", "path").agg(F.array_sort(F.collect_set("g")).alias("groups")).where("size(groups) > 1")


def unannotated(groups: DataFrame) -> DataFrame:
    return groups.where(F.size("masks") == 0).select(F.concat(F.col("subdataset"), F.lit("."), F.col("split"), F.lit(":"), F.col("identifier")).alias("group_name"))


def bernoulli_split(groups: DataFrame, key: Column, share: float, seed: int) -> DataFrame:
    """Where a subdataset has no test group: each group to train with probability `share`."""
    tests = groups.groupBy("subdataset").agg(F.max((F.col("split") == "test").cast("int")).alias("has_test"))
    drawn = F.when(K.unit(key, seed) < share, "train").otherwise("test")
    return groups.join(tests, "subdataset").withColumn("split", F.when(F.col("has_test") == 1, F.col("split")).otherwise(drawn)).drop("has_test")


def global_tasks(rows: DataFrame) -> DataFrame:
    """Rows (task, class, dataset, subdataset) as task -> classes and datasets with subdatasets."""
    return rows.groupBy("task").agg(F.array_sort(F.collect_set("class")).alias("classes"), F.array_sort(F.collect_set(F.concat_ws("/", "dataset", "subdataset"))).alias("places"))


def task_refine(pairs: DataFrame, task_classes: DataFrame) -> DataFrame:
    """Tasks of a pair kept only if they have its class; all of them where none has."""
    each = pairs.select("pair_id", "class", F.explode("tasks").alias("task"))
    fit = each.join(task_classes, ["task", "class"], "left_semi").groupBy("pair_id").agg(F.array_sort(F.collect_set("task")).alias("fit"))
    return pairs.join(fit, "pair_id", "left").select("pair_id", "class", F.coalesce("fit", F.array_sort("tasks")).alias("tasks"))


def task_membership(seqs: DataFrame, places: DataFrame) -> DataFrame:
    """(dim, task) buckets of the sequences whose dataset and subdataset the task knows."""
    return seqs.select("idx", "dim", "dataset", "subdataset", F.explode("tasks").alias("task")).join(places, ["task", "dataset", "subdataset"], "left_semi").select("dim", "task", "idx")


def pair_explicit(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Masks with the image at their index, or a reason why not."""
    x = masks.join(images, "group_id", "left")
    n = F.coalesce(F.size("proc_images"), F.lit(0))
    reason = F.when(F.col("image_index").isNull(), "index_missing").when((F.col("image_index") < 0) | (F.col("image_index") >= n), "index_out_of_range").when(~F.coalesce(F.col("dimension").isin(2, 3), F.lit(False)), "bad_dimension")
    return x.withColumn("reason", reason).withColumn("image", F.when(F.col("reason").isNull(), F.get("proc_images", F.col("image_index")))).drop("proc_images")


def pair_fallback(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Mask to image of its group by `_mask` number, then by image number, then by normal stem; the last image of a key counts."""
    last = lambda key: images.select("group_id", key.alias("k"), "path").where("k is not null").groupBy("group_id", "k").agg(F.max("path").alias("image"))
    by_number, by_stem = last(K.idx_from_name(F.col("path")).cast("string")), last(K.stem_key(F.col("path")))
    out = masks
    for i, (table, key) in enumerate(((by_number, K.mask_idx_from_name(F.col("path")).cast("string")), (by_number, K.idx_from_name(F.col("path")).cast("string")), (by_stem, K.stem_key(F.col("path"))))):
        t = table.withColumnRenamed("image", f"image_{i}")
        out = out.withColumn("k", key).join(t, ["group_id", "k"], "left").drop("k")
    return out.select("group_id", F.col("path").alias("mask"), F.coalesce("image_0", "image_1", "image_2").alias("image"))


def pred_gt_join(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions to truth by base name without `_k###_mask`, then also without `_0000`."""
    base = F.regexp_replace(K.stem_of(F.col("pred")), r"_k\d+_mask$", "")
    p = preds.withColumn("b1", base).withColumn("b2", F.regexp_replace("b1", "_0000$", ""))
    t1, t2 = truth.select(K.stem_of(F.col("gt")).alias("b1"), F.col("gt").alias("gt1")), truth.select(K.stem_of(F.col("gt")).alias("b2"), F.col("gt").alias("gt2"))
    return p.join(t1, "b1", "left").join(t2, "b2", "left").select("pred", F.coalesce("gt1", "gt2").alias("gt"))


def manifest_merge(index: DataFrame, done: DataFrame) -> DataFrame:
    """Index entries with the processed entries of the same first image and mask; entries without stay as they are."""
    d = done.select("first_image", "first_mask", F.col("identifier").alias("new_identifier"), "proc_images")
    x = index.join(d, ["first_image", "first_mask"], "left")
    return x.select(F.coalesce("new_identifier", "identifier").alias("identifier"), "first_image", "first_mask", "proc_images", F.col("new_identifier").isNotNull().alias("matched"))


def unmatched_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def group_status(usable: Column, failed_stage: Column, reasons: Column) -> Column:
    """accepted; partial when usable outputs exist beside a failure; failed with a stage; else rejected."""
    del reasons
    return F.when((usable > 0) & failed_stage.isNotNull(), "partial").when(usable > 0, "accepted").when(failed_stage.isNotNull(), "failed").otherwise("rejected")


def report_status_counts(rows: DataFrame) -> DataFrame:
    """One count per source group: attempted and each status. `rows` has locator, status and seq; the first row of a group counts."""
    one = rows.groupBy("locator").agg(F.min_by("status", "seq").alias("status"))
    return one.agg(F.count("*").alias("attempted"), *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "failed", "partial")])


def best_folder(files: DataFrame, owner: str) -> DataFrame:
    """Folder with most files of each owner; ties to the smaller name."""
    n = files.groupBy(owner, K.dir_of(F.col("path")).alias("folder")).agg(F.count("*").alias("n"))
    top = n.groupBy(owner).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("folder"))).alias("x"))
    return top.select(owner, F.col("x.folder").alias("folder"), (-F.col("x.m")).alias("n"))
