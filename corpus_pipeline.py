"""The corpus pipeline: from documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import decontamination, language, near_dedup, packing, secrets
from maskloom.llm.shared import discard, written
from maskloom.llm.token_ids import tokenizer_path

#: Documents whose nearest profile is farther than this (as a share of the most possible) are in no known language. Texts of a learnt language
#: stay well below, of one word as of thousands (0.60 at most in the given tables); random letters of their alphabet are over 0.71.
FARTHEST = 0.7


def _whole(docs: DataFrame) -> DataFrame:
    """A document's columns in one, beside its text: columns of operators may have names that documents have as well."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "text")


def _columns(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of documents with their types, some anew."""
    return rows.select(*[(new[c].cast(t) if c in new else F.col("__doc").getField(c)).alias(c) for c, t in docs.dtypes])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or in no known language; a missing lang becomes the predicted one."""
    found = language.predict(_whole(docs), language.learn(docs), ["__doc"])
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("distance") <= FARTHEST))
    return _columns(kept, docs, lang=F.coalesce("__doc.lang", "lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near-duplicate rows, that with the smallest key; rows without a key count as well."""
    return near_dedup.unique_rows(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows in whose text a benchmark item was found; keys play no part, so rows without one or with another row's are judged by themselves."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by their kind; n_chars follows the text."""
    out = secrets.redact(secrets.scan(_whole(docs)))
    return _columns(out, docs, text=F.col("text"), n_chars=F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("__doc.n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 1024, one row per piece, with its ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Rank profiles, edit matching and byte-pair packing are not expressible in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:  # what a stage has read is not needed any more
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
