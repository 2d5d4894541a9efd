"""From documents to token ids: language ID, near-dedup, benchmark decontamination, PII redaction, BPE.

Every stage takes all that the one before it kept. No SQL can express the learned and hashed stages,
so ORACLE_SQL is None and tests/llm/test_stages.py compares each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import bpe, decontam, langid, pii, similar
from foliograph.llm.common import table
from foliograph.llm.graph import saved, saved_alone


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the trees, counted on a sample of docs, identify; null, empty and letterless texts go."""
    return langid.keep_known(spark, docs, langid.train(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id: SimHash fingerprints of five-word shingles, byte-position index, count filter; then similarity of the shingles, 0.8 and more."""
    return similar.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark text go."""
    return decontam.remove_spans(spark, docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return pii.redact(spark, docs, pii.train(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), and digests of the ids and of the bytes that they decode to."""
    # written between the two, so that a task has one Python worker at a time, not one for each
    return bpe.decode(saved(bpe.encode(docs))).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each read from the Parquet table that the one before it wrote into the shared folder. Once a stage is done, what it has written on its way and the table that it has read are removed."""
    docs, held = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs, held = saved_alone(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), held)
    return STAGES[-1][1](spark, docs, sf_dir)
