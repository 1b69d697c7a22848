"""The corpus pipeline: quality filter, near-duplicate removal, decontamination, secret redaction, packing.

Each stage is one of the operators of fathom.llm, applied to all that the stage before kept. All but the
last return the columns of documents; columns that documents hasn't are not handed on. Null texts are scored,
kept or dropped like empty ones; an empty table goes through as such. Rows that share an id but not the text are
one document to the near-duplicate stage, and apart in the others; rows equal in both are one row after it. A row
without an id counts by its text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate, minhash, packing, quality, secrets
from fathom.llm.common import small, small_batches, stored, table, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage in small batches: all stages run in one application, whose Python workers and direct memory keep the largest size they had."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@lean
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.filtered(docs.select(*COLUMNS), quality.train(docs, table(spark, sf_dir, "labels")))


@lean
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the document with the smallest id, once. Rows without an id come after all others."""
    digest = F.xxhash64("text")
    rows = docs.select(*COLUMNS, F.coalesce("doc_id", F.pmod(digest, F.lit(1 << 60)) + (7 << 60)).alias("_id"), digest.alias("_digest"))
    dropped = stored(minhash.near_duplicates(rows, id_col="_id", shingle=5, percent=80).where("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    kept = without(rows, dropped, "_id")
    key = ["_id", "_digest"]
    twice = stored(kept.groupBy(*key).count().where("count > 1").select(*key), "twice")
    if twice.limit(1).count():
        kept = kept.join(small(twice), key, "left_anti").unionByName(kept.join(small(twice), key, "left_semi").dropDuplicates(key))
    return kept.select(*COLUMNS)


@lean
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is tiled in."""
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_digest"))
    keyed = rows.select(F.struct("doc_id", "_digest").alias("_key"), "text")
    found = stored(decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_key").select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id._digest").alias("_of")).distinct(), "contaminated")
    return rows.join(small(found), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), "left_anti").select(*COLUMNS)


@lean
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars counted anew where the text changed."""
    clean = secrets.redacted(docs.select(*COLUMNS).withColumn("_was", F.col("text")), secrets.train(secrets.labelled_findings(spark)))
    return clean.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col("_was")), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


@lean
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths with their ids."""
    cut = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids"))
    return packing.sequences(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The classifier, the forest and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Every stage's result is stored in the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
