"""Token ids in shard files with a minimal perfect hash index from document keys to shard offsets.

Layout below one folder, all written by Spark's committer, so a lost executor leaves no half file:

- `payload/`: one row per block: shard, block, the raw little-endian unsigned 32-bit ids of whole documents
  in ascending key order, and the block's directory (keys, occurrence numbers, lengths). A block closes at
  `block_ids` ids; only a single longer document makes a longer one.
- `shards/`: per shard its documents, ids and the ids in all shards before it.
- `index/`: one row per hash bucket of about `bucket_keys` keys: a hash-and-displace function
  that is minimal and perfect on the bucket's keys (one displacement per group of about four keys), and by slot a
  32-bit fingerprint, shard, block, offset in the block, length and start in the whole store.
- `files/`: which file holds each shard and each bucket, and `meta/`: the number of buckets.

A look-up hashes the key to a bucket, reads one displacement, compares one fingerprint: constant time. Up to `DIRECT` keys are looked up
in the files that hold their buckets and fetched from those that hold their shards, and from no others; more keys meet the whole index in a join.
A key that was not stored is refused unless its fingerprint agrees by chance (2^-32).

Defined cases: a null text is empty and has just its end id; a null key sorts first and can be looked up;
rows with the same key are all kept, told apart by `occurrence` (0, 1, ... by text); an empty
table makes an empty store; other columns are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.llm.shared import tidy, written
from maskloom.llm.token_ids import encoder

_PAYLOAD = "shard int, block int, doc_ids array<long>, occurrences array<int>, lengths array<int>, ids binary"
_INDEX = "bucket long, n int, displacements binary, fingerprints binary, shards binary, blocks binary, offsets binary, lengths binary, starts binary"
_FILES = "kind string, number long, file string"
#: Keys that are few enough to be looked up file by file; what the driver learns of them is their buckets and shards.
DIRECT = 10_000
_FOUND = "doc_id long, occurrence int, shard int, block int, offset long, n_tokens long, start long"
_NULL = np.int64(-(1 << 63) + 1)


def _mix(keys: np.ndarray, occurrences: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of (key, occurrence); multiply-xor-shift rounds."""
    x = keys.astype(np.int64).view(np.uint64) ^ (occurrences.astype(np.uint64) << np.uint64(40))
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slot(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> np.ndarray:
    """Displacements, one per group, that send the distinct hashes `h` one to one to 0..len(h)-1."""
    n, groups = len(h), max(1, (len(h) + 3) // 4)
    group = (h % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    ends = np.cumsum(sizes)
    taken, out = np.zeros(n, bool), np.zeros(groups, np.uint32)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        own, first = h[order[ends[g] - sizes[g] : ends[g]]], 0
        while True:
            tries = np.arange(first, first + 64, dtype=np.uint32)
            slots = np.sort(_slot(own[None, :], tries[:, None], n), axis=1)
            good = ~taken[slots].any(1)
            if slots.shape[1] > 1:
                good &= (slots[:, 1:] != slots[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                taken[slots[k]], out[g] = True, tries[k]
                break
            first += 64
            if first > 1 << 26:
                raise ValueError("keys are not distinct")
    return out


def _bucket(buckets: int):
    """The bucket of (doc_id, occurrence), computed by Spark alone so that both sides of a look-up agree."""
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(int(_NULL))), "occurrence"), F.lit(buckets)).alias("bucket")


def write_store(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, block_ids: int = 1 << 19, bucket_keys: int = 4096) -> str:
    """Write the store of all `docs` below `path` (which must not exist) and return `path`."""
    spark, end = docs.sparkSession, end_id.to_bytes(4, "little")
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("occurrences", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, number, block = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        keys, times, sizes, parts, held, last, seen = [], [], [], [], 0, object(), 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, block, keys, times, sizes, b"".join(parts)), arrow)], schema=arrow)

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                seen = seen + 1 if k == last else 0
                last = k
                keys.append(k), times.append(seen), sizes.append(len(ids) // 4), parts.append(ids)
                held += len(ids) // 4
                if held >= block_ids:
                    yield closed()
                    keys, times, sizes, parts, held, block = [], [], [], [], 0, block + 1
        if keys:
            yield closed()
        tidy()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(shard, _PAYLOAD).write.option("compression", "zstd").parquet(f"{path}/payload")

    directory = spark.read.schema(_PAYLOAD).parquet(f"{path}/payload").select(
        "shard", "block", "doc_ids", "occurrences", "lengths", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("block_ids"))
    # One row per shard: as many as the writing stage had tasks.
    per_shard = directory.groupBy("shard").agg(F.sum("block_ids").alias("n_ids"), F.sum(F.size("doc_ids")).alias("n_docs"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/shards")
    shards = spark.read.schema("shard int, n_ids long, n_docs long, base long").parquet(f"{path}/shards")

    total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_keys))
    # Blocks of a shard are few, and so are rows of this window.
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = directory.select("shard", "block", "block_ids").withColumn("ahead", F.coalesce(F.sum("block_ids").over(earlier), F.lit(0))).join(shards.select("shard", "base"), "shard")
    entries = (
        directory.drop("block_ids").mapInPandas(_with_offsets, "shard int, block int, doc_id long, occurrence int, length int, offset long")
        .join(heads.select("shard", "block", (F.col("base") + F.col("ahead")).alias("first")), ["shard", "block"])
        .select(_bucket(buckets), "doc_id", "occurrence", "shard", "block", "offset", "length", (F.col("first") + F.col("offset")).alias("start"))
    )
    entries.groupBy("bucket").applyInPandas(_build, _INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    spark.createDataFrame([(buckets,)], "buckets long").coalesce(1).write.parquet(f"{path}/meta")
    holds = lambda name, schema, column: spark.read.schema(schema).parquet(f"{path}/{name}").select(F.lit(name).alias("kind"), F.col(column).cast("long").alias("number"), F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"))
    holds("payload", _PAYLOAD, "shard").distinct().unionByName(holds("index", _INDEX, "bucket")).write.parquet(f"{path}/files")
    return path


def _with_offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.itertuples(index=False):
            n = np.asarray(r.lengths, np.int64)
            yield pd.DataFrame({"shard": r.shard, "block": r.block, "doc_id": pd.array(r.doc_ids, "Int64"), "occurrence": np.asarray(r.occurrences, np.int32), "length": n.astype(np.int32), "offset": np.cumsum(n) - n})


def _hashes(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys, times = pdf["doc_id"].astype("Int64").fillna(int(_NULL)).to_numpy(np.int64), pdf["occurrence"].to_numpy(np.int64)
    return _mix(keys, times, 0), (_mix(keys, times, 1) >> np.uint64(32)).astype("<u4")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h, prints = _hashes(pdf)
    d = perfect_hash(h)
    at = np.argsort(_slot(h, d[(h % np.uint64(len(d))).astype(np.int64)], len(h)))
    raw = lambda c, kind: pdf[c].to_numpy()[at].astype(kind).tobytes()
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "n": [len(h)], "displacements": [d.astype("<u4").tobytes()], "fingerprints": [prints[at].tobytes()], "shards": [raw("shard", "<i4")], "blocks": [raw("block", "<i4")], "offsets": [raw("offset", "<i8")], "lengths": [raw("length", "<i4")], "starts": [raw("start", "<i8")]})


def _part(spark: SparkSession, path: str, name: str, schema: str, column: str, numbers: list[int]) -> DataFrame:
    """The rows of `numbers` (shards or buckets) of a part of the store, from the files that hold them alone."""
    files = spark.read.schema(_FILES).parquet(f"{path}/files").where((F.col("kind") == name) & F.col("number").isin(numbers)).select("file").distinct().collect()
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{name}/{r['file']}" for r in files]).where(F.col(column).isin(numbers))


def lookup(spark: SparkSession, path: str, keys: DataFrame, direct: int = DIRECT) -> DataFrame:
    """Where each of the distinct (doc_id, occurrence) of `keys` lies; keys that are not stored give no row."""
    buckets = spark.read.schema("buckets long").parquet(f"{path}/meta").first()[0]
    wanted = keys.select(F.col("doc_id").cast("long"), F.col("occurrence").cast("int")).distinct().select(_bucket(buckets), "doc_id", "occurrence")
    few = [r["bucket"] for r in wanted.select("bucket").limit(direct + 1).collect()] if direct else []
    if direct and len(few) <= direct:
        index = _part(spark, path, "index", _INDEX, "bucket", sorted(set(few)))
    else:
        index = spark.read.schema(_INDEX).parquet(f"{path}/index")

    def find(wanted: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(row):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in _FOUND.split(", ")})
        r = row.iloc[0]
        h, prints = _hashes(wanted)
        d = np.frombuffer(r["displacements"], "<u4")
        s = _slot(h, d[(h % np.uint64(len(d))).astype(np.int64)], int(r["n"]))
        ok = np.frombuffer(r["fingerprints"], "<u4")[s] == prints
        s, got = s[ok], wanted[ok]
        take = lambda c, kind: np.frombuffer(r[c], kind)[s]
        return pd.DataFrame({"doc_id": got["doc_id"].astype("Int64").array, "occurrence": got["occurrence"].to_numpy(), "shard": take("shards", "<i4"), "block": take("blocks", "<i4"), "offset": take("offsets", "<i8"), "n_tokens": take("lengths", "<i4").astype(np.int64), "start": take("starts", "<i8")})

    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, _FOUND)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """crc32 of each document's ids in the block, sliced from the raw payload."""
    for b in batches:
        for r in b.itertuples(index=False):
            n = np.asarray(r.lengths, np.int64)
            ends, raw = np.cumsum(n), memoryview(r.ids)
            yield pd.DataFrame({"shard": r.shard, "block": r.block, "offset": ends - n, "n_tokens": n, "ids_crc32": np.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())], np.int64)})


def checksums(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the keys: places from the index, ids from the payload.

    The payload is scanned where it lies; only checksums meet the index's places, on (shard, block, offset, n_tokens)."""
    payload = spark.read.schema(_PAYLOAD).parquet(f"{path}/payload").select("shard", "block", "lengths", "ids")
    sums = payload.mapInPandas(_slices, "shard int, block int, offset long, n_tokens long, ids_crc32 long")
    return lookup(spark, path, keys, 0).join(sums, ["shard", "block", "offset", "n_tokens"]).select("doc_id", "occurrence", "start", "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, keys: DataFrame, direct: int = DIRECT) -> DataFrame:
    """The raw ids of the keys, one row each: doc_id, occurrence, start, n_tokens, ids. Few keys read the files that hold them alone."""
    found = lookup(spark, path, keys, direct)
    shards = []
    if direct:
        found = written(found, "token-places")
        shards = [r["shard"] for r in found.select("shard").limit(direct + 1).collect()]
    if direct and len(shards) <= direct:
        payload = _part(spark, path, "payload", _PAYLOAD, "shard", sorted(set(shards)))
    else:
        payload = spark.read.schema(_PAYLOAD).parquet(f"{path}/payload")
    raw = payload.select("shard", "block", F.col("ids").alias("raw"))
    return raw.join(found, ["shard", "block"]).select("doc_id", "occurrence", "start", "n_tokens", F.expr("substring(raw, cast(4 * offset + 1 as int), cast(4 * n_tokens as int))").alias("ids"))


def stored_keys(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """All (doc_id, occurrence) that a store of `docs` has."""
    return docs.groupBy(F.col(key).cast("long").alias("doc_id")).count().select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("occurrence"))
