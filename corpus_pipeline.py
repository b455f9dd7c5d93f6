"""A training-corpus pipeline of five stages over ``documents``; each works on all that the one before it kept.

Tables may be empty; repeated rows of one document count as one from the near-duplicate stage on. See the operators for nulls and ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenstride.llm import mixing, neardup, pieces, pii, quality
from evenstride.llm.common import delete, new_path, released, table


#: Similarity in percent from which the near-duplicate stage links two documents: that of op3_minhash, which the stage's test compares with.
NEAR_PERCENT = 85


KEYS = ["__id", "__none", "__th"]


def _keyed(rows: DataFrame, text_hash: Column) -> DataFrame:
    """Rows with what tells them apart, without nulls: doc_id, whether it is null, and a hash of the text."""
    return rows.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__th": text_hash})


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; each row is judged by its own text and language."""
    bad = quality.judge(docs, table(spark, sf_dir, "labels")).where("not kept")
    bad = _keyed(bad, F.col("th")).select(*KEYS, F.col("lang").alias("__lang")).distinct()
    rows = _keyed(docs, F.xxhash64("text")).withColumn("__lang", F.coalesce("lang", F.lit("")))
    return rows.join(bad, [*KEYS, "__lang"], "left_anti").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of near-duplicates; of equal rows without words one too."""
    stay = _keyed(neardup.chosen(docs, percent=NEAR_PERCENT), F.col("th")).select(*KEYS)
    return _keyed(docs, F.xxhash64("text")).join(stay, KEYS, "left_semi").dropDuplicates(KEYS).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data pseudonymised within its format."""
    return pii.pseudonymise_documents(docs).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mixing.take(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix, with whether they decode to its text."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]
#: SQL can't express the language model, the keyed permutations or the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is written to the shared folder; what a stage itself wrote on the way goes then."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage-" + "-".join(name.split()))
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
