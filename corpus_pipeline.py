"""The corpus pipeline: quality classifier, quality rules, near duplicates, mixture, BPE; each stage works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Null and empty texts fail the rules; null ids and repeated rows, very long texts, tables without rows and extra columns are
what each stage's operator says of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plexmat.llm import bpe, chosen_path, line_rules, mixing, rule_ensemble
from plexmat.llm.common import shared_dir


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores as good; the others go. Labels come from the labels table."""
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and aren't depleted, without the lines over their host's limit; near copies count as one there, as the next stage is theirs."""
    return line_rules.apply_rules(docs, spare_copies=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return chosen_path.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources reads them."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the text decoded from them, of every mixed document."""
    from public_tokenizers import path

    return bpe.digest_documents(docs, path("byte_bpe_50k.json"))


STAGES = [("classifier", classify), ("rules", rules), ("near_duplicates", near_duplicates), ("mixture", mixture), ("bpe", encode)]

#: SQL has neither the fitted rules, nor the permutations, nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/plexmat/stage-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
