"""Intermediate tables in the folder that all executors share, and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.sources.folders import new_folder


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that `spark.checkpoint.dir` names (an error where a cluster has none)."""
    return new_folder(spark, name)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` cut off from its lineage: written to the shared folder with Spark's committer and read back.

    A lost executor costs the tasks of the reading stage only. The schema is kept, so empty tables work."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by `written` once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(key: str, mod: int):
    """crc32 of the key as text, modulo `mod`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def in_share(key: str, share: float):
    """Whether a key is in a sample of that share of all keys, by its hash; shares go down to 2^-62."""
    return F.shiftrightunsigned(F.xxhash64(key), 2) < (1 << 62 if share >= 1 else max(1, int(share * (1 << 62))))


def tidy() -> None:
    """Give memory that a finished task no longer needs back to the system: Python workers live on beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
