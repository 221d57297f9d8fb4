"""Documents in parts, caches in buckets, the tree digest, and typed stream state."""

import datetime
import glob
import hashlib
import os
import random

from pyspark.sql import functions as F

from maskloom.sources import tables as T
from maskloom.sources.folders import new_folder, shared_folder
from maskloom.streaming import logs as L

GROUPS = "modality string, subdataset string, split string, identifier string, images array<string>, masks array<string>"


def test_a_hot_subdataset_makes_no_single_row(spark):
    rows = [("ct", "hot", "train" if i % 3 else "test", f"i{i:05d}", [f"p{i}"], []) for i in range(3000)] + [("mr", None, "train", None, None, None), (None, "x", "test", "a", [], ["m"]), ("ct", "hot", "test", "i00000", ["p0"], [])]
    df, path = spark.createDataFrame(rows, GROUPS), new_folder(spark, "groups")
    T.write_groups(df, path, 100)
    parts = spark.read.schema(T.PART).json(f"{path}/parts")
    assert parts.agg(F.max(F.size("groups"))).first()[0] == 100 and parts.where("subdataset = 'hot'").count() == 20 + 11
    back = T.read_groups(spark, path)
    assert sorted(map(repr, back.drop("position").collect())) == sorted(map(repr, df.collect()))
    at = {(r["split"], r["position"]): r["identifier"] for r in back.where("subdataset = 'hot'").collect()}
    assert [at["test", i] for i in range(1001)] == sorted(r[3] for r in rows if r[1] == "hot" and r[2] == "test")
    heads = {(r["modality"], r["subdataset"]): (r["train"], r["test"], r["parts"]) for r in T.group_heads(spark, path).collect()}
    assert heads == {("ct", "hot"): (2000, 1001, 31), ("mr", None): (1, 0, 1), (None, "x"): (0, 1, 1)}


def files(path):
    return {os.path.relpath(f, path[7:]) for f in glob.glob(path[7:] + "/*/*.parquet")}


def test_upsert_leaves_other_parts_as_files(spark):
    path = new_folder(spark, "cache")
    frame = lambda rows: spark.createDataFrame(rows, "k long, bucket string, v int")
    T.upsert(path, frame([(i, "b", 0) for i in range(500)] + [(None, None, 0)]), ["k", "bucket"])
    before = files(path)
    got = T.upsert(path, frame([(7, "b", 1), (None, None, 2), (1000, "b", 3), (1000, "b", 3)]), ["k", "bucket"])
    assert got.columns == ["k", "bucket", "v"]
    values = {(r["k"], r["bucket"]): r["v"] for r in got.collect()}
    assert values == {**{(i, "b"): 0 for i in range(500)}, (7, "b"): 1, (None, None): 2, (1000, "b"): 3} and got.count() == 502
    touched = {f.split("/")[0] for f in before ^ files(path)}
    assert 1 <= len(touched) <= 3 and len(before & files(path)) >= 55


def test_append_writes_no_file_anew_and_reads_its_own_parts(spark):
    path = new_folder(spark, "cache")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v int")
    T.append_stats(path, frame([(i, 0) for i in range(300)]), ["k"])
    before = files(path)
    new = frame([(5, 1), (1234, 1), (1234, 1)])
    touched = {r[0] for r in T.in_buckets(new, ["k"]).select(T.BUCKET).distinct().collect()}
    for f in before:  # what is not asked for is not opened
        if int(f.split("/")[0].split("=")[1]) not in touched:
            open(f"{path[7:]}/{f}", "wb").write(b"broken")
    T.append_stats(path, new, ["k"])
    assert before < files(path) and len(files(path) - before) == 1
    only = spark.read.schema("k long, v int, cache_bucket int").parquet(path).where(F.col(T.BUCKET).isin(sorted(touched))).where("v = 1").collect()
    assert [(r["k"], r["v"]) for r in only] == [(1234, 1)]


def test_a_batch_reads_the_parts_of_its_own_keys(spark):
    path = new_folder(spark, "unseen")
    frame = lambda ks: spark.createDataFrame([(k, k) for k in ks], "k long, v long")
    run = L.append_unseen(path, "k", "q")
    run(frame(range(300)), 0)
    own = {r[0] for r in frame([5, 7, 999]).select(F.pmod(F.xxhash64("k"), F.lit(64))).distinct().collect()}
    for f in glob.glob(f"{path[7:]}/*/*/*/*.parquet"):
        if int(f.split("bucket=")[1].split("/")[0]) not in own:
            open(f, "wb").write(b"broken")
    run(frame([5, 7, 999]), 1)
    assert [r["k"] for r in spark.read.parquet(f"{path}/query=q/batch=1").collect()] == [999]


def tree(texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    count = {}
    for t in texts:
        count[sha(t)] = count.get(sha(t), 0) + 1
    nodes = {}
    for h, n in count.items():
        nodes.setdefault(h[:6], []).append(f"{h}:{n}")
    for size in (4, 2, 0):
        up = {}
        for at, leaves in nodes.items():
            up.setdefault(at[:size], []).append(sha(",".join(sorted(leaves))))
        nodes = up
    return sha(",".join(sorted(nodes.get("", [])))) if count else None


def test_tree_hash_of_any_dealing(spark):
    rng = random.Random(4)
    texts = [f"p{rng.randrange(400)}" for _ in range(1000)]
    df = spark.createDataFrame([("a", t) for t in texts] + [("b", "é"), ("b", None), (None, "x")], "g string, t string")
    want = {"a": tree(texts), "b": tree(["é"]), None: tree(["x"])}
    for given in (df, df.orderBy(F.rand(1)).repartition(7)):
        assert {r["g"]: r["tree_hash"] for r in T.tree_hash(given, ["g"], "t").collect()} == want
    assert {r["g"] for r in T.tree_hash(df.where("t is null"), ["g"], "t").collect()} == {"b"}


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def run_stream(spark, source, checkpoint, keep_days, out):
    rows = spark.readStream.schema("m string, d string, ts timestamp").parquet(source)
    told = []
    q = L.milestones(rows, ["m", "d"], {"x": 10, "y": 4}, "ts", "1 hour", keep_days).writeStream.outputMode("append").foreachBatch(lambda b, n: told.extend(tuple(r) for r in b.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    out.append(sorted(told, key=repr))


def test_milestones_are_told_once_over_restarts_and_silent_groups_forgotten(spark):
    source, checkpoint, out = new_folder(spark, "source"), new_folder(spark, "checkpoint"), []
    frame = lambda rows: spark.createDataFrame(rows, "m string, d string, ts timestamp")
    L.stateful(spark)
    try:
        frame([("a", "x", day(0))] * 5 + [("b", "y", day(0))] * 4 + [(None, "y", day(0))]).write.mode("append").parquet(source)
        run_stream(spark, source, checkpoint, 30, out)
        assert set(out[0]) == {("a", "x", "milestone", 10 * k) for k in range(1, 6)} | {("b", "y", "milestone", 10 * k) for k in range(1, 11)} | {("b", "y", "complete", 100), (None, "y", "milestone", 10), (None, "y", "milestone", 20)}
        frame([("a", "x", day(1))] * 6 + [("b", "y", day(1))] * 3).write.mode("append").parquet(source)
        run_stream(spark, source, checkpoint, 30, out)
        assert set(out[1]) == {("a", "x", "milestone", 10 * k) for k in range(6, 11)} | {("a", "x", "complete", 100)}
        run_stream(spark, source, checkpoint, 30, out)
        assert out[2] == []
        frame([("c", "y", day(100))]).write.mode("append").parquet(source)  # the watermark goes on: a and b are forgotten
        run_stream(spark, source, checkpoint, 30, out)
        frame([("b", "y", day(101))] * 4).write.mode("append").parquet(source)
        run_stream(spark, source, checkpoint, 30, out)
        assert ("b", "y", "complete", 100) in out[-1]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_progress_of_groups_with_and_without_a_total(spark):
    s = spark.createDataFrame([("a", 4, 2.0), ("b", 9, 1.0), (None, 1, 1.0)], "d string, n long, mean double")
    t = spark.createDataFrame([("a", 10), ("b", 5)], "d string, total long")
    got = {r["d"]: (r["done"], r["percent"], r["eta_seconds"]) for r in L.progress(s, "n", "mean", t, "d", "total").collect()}
    assert got == {"a": (4, 40.0, 12.0), "b": (9, 180.0, 0.0), None: (1, None, None)}


def test_a_local_session_without_a_shared_folder_has_one_of_its_own(spark):
    class Conf:
        def get(self, *a):
            return None

    class Bare:
        conf, sparkContext = Conf(), spark.sparkContext

    first = shared_folder(Bare())
    assert first == shared_folder(Bare()) and os.path.isdir(first[7:])


def test_tables_that_are_folders_of_part_files_have_one_row(spark, tmp_path):
    """A table is a file or a folder of parts; below a folder that has the extension itself the tables are told from the root on."""
    root = tmp_path / "all.parquet"
    spark.range(300).repartition(3).write.parquet(str(root / "b.parquet"))
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "one"))
    (root / "a.parquet").write_bytes(next((tmp_path / "one").glob("part-*.parquet")).read_bytes())
    for path in (str(root), f"file://{root}/"):
        got = {r["path"]: (r["files"], r["length"] > 0) for r in T.list_tables(spark, path, ".parquet").collect()}
        assert got == {"a.parquet": (1, True), "b.parquet": (3, True)}


def test_a_large_model_is_dealt_over_tasks_by_its_size(spark, tmp_path):
    """One model of a few MB with an advised size of 256 KB: many files, none much larger; eight tasks a model would have made at most eight."""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        df = spark.range(0, 600_000, 1, 16).selectExpr("if(id % 1000 = 0, 'small', 'large') as model", "sha2(cast(id as string), 256) as text")
        got = {r["model"]: r["rows"] for r in T.write_by_model(df, str(tmp_path / "m")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert got == {"small": 600, "large": 599_400}
    assert len(list((tmp_path / "m" / "model=large").glob("*.parquet"))) > 8
