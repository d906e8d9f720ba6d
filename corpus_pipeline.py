"""From documents to a training mix: five stages, each over all that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns documents; the last returns
what the mix takes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickpath.llm import bag_minhash, fair_mix, randomness, rule_cascade, string_tiling
from clickpath.llm.common import forget, table, whole_text
from clickpath.runtime import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return rule_cascade.judge(docs, COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the least doc_id; of rows that repeat it, the one with the least text
    by hash (then the least of all columns), which spoke for it.

    Rows without a doc_id belong to no class and stay.
    """
    kept = bag_minhash.near_duplicates(docs).where("doc_id = class_id").select("doc_id", "n_rows")
    joined = docs.select(*COLUMNS).join(kept, "doc_id")
    least = F.min(F.struct(F.md5(whole_text()).alias("_hash"), *COLUMNS)).alias("r")
    repeated = joined.where("n_rows > 1").groupBy(F.col("doc_id").alias("_id")).agg(least)
    return (joined.where("n_rows = 1").select(*COLUMNS)
            .unionByName(repeated.select(*[F.col(f"r.{c}").alias(c) for c in COLUMNS]))
            .unionByName(docs.where("doc_id IS NULL").select(*COLUMNS)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaked = string_tiling.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(stored(leaked, "leaked"), "doc_id", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return randomness.mask_secrets(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return fair_mix.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("secret scan", mask_secrets),
    ("mixing", mix_sources),
]

#: Signatures, tilings and the test battery have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return docs
