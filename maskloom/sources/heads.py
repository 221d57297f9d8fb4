"""The first bytes of files, and why a file's header cannot be used."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.keys import ext_of
from maskloom.operators.records import corrupt_reason, nifti_reason

#: Bytes of a NIfTI header.
HEADER = 348


def file_heads(spark: SparkSession, root: str, most: int = 65_536, whole: int = 1 << 26, exts: list[str] | None = None) -> DataFrame:
    """path, length and the first `most` bytes (`head`) of the files below `root`.

    Files of up to `whole` bytes are read by Spark, which leaves out the content of longer ones already in the scan. Of those each task opens one at a time and reads `most` bytes, by pyarrow's
    file systems, so memory does not grow with a file; their place has to be one that pyarrow can open. Spark's scan gives no row for an empty file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if exts:
        files = files.where(ext_of(F.col("path")).isin(*exts))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            heads = []
            for path in b["path"]:
                at, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with at.open_input_stream(inner, buffer_size=most, compression=None) as f:
                    heads.append(f.read(most))
            yield b.assign(head=heads)

    small = files.where(F.col("length") <= whole).select("path", "length", F.substring("content", 1, most).alias("head"))
    large = files.where(F.col("length") > whole).select("path", "length").mapInPandas(opened, "path string, length long, head binary")
    return small.unionByName(large)


def inflated(head: Column, most: int = HEADER) -> Column:
    """The first `most` bytes that a gzip file's head holds, or as many as there are before an error; memory is bounded by both."""

    @F.pandas_udf("binary")
    def run(heads: pd.Series) -> pd.Series:
        def one(data):
            if data is None:
                return None
            try:
                return zlib.decompressobj(31).decompress(bytes(data), most)
            except zlib.error:
                return b""

        return heads.map(one)

    return run(head)


def header_reason(length: Column, head: Column, path: Column) -> Column:
    """Why a file cannot be read: missing, zero_bytes, bad_gzip; for `.nii` and, inflated, `.nii.gz` files also short_header, bad_header_length, bad_magic. Null for good files and other kinds."""
    gz = F.endswith(F.lower(path), F.lit(".nii.gz"))
    inner = nifti_reason(inflated(F.when(gz, head)), F.lit(".nii"))
    return F.coalesce(corrupt_reason(length, head, path), F.when(gz, inner), nifti_reason(head, path))
