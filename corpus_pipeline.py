"""From raw documents to packed sequences: quality rules, near-duplicates,
personal data, packing. Each stage works on all that the one before it kept; a
stage's result is written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import near_texts, op1_packing, op4_rules, op10_pii
from statloom.llm.common import written

POLICY = "web-2"


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the policy keeps. A null text has no words and goes; repeated rows
    are rows of their own; any other columns stay, whatever their names."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept = op4_rules.apply_policy(op4_rules.ledger(docs, row), POLICY).where("kept")
    return kept.select("row.*")


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with four fifths or more of their different
    five-word shingles in common: that of the smallest id, a null id only where there is no other;
    repeated rows are copies; texts of fewer words are one shingle; any columns stay."""
    return near_texts.first_of_groups(docs, near_texts.near_texts(docs.select("doc_id", "text")))


def private(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data as the names of their kinds; null texts stay null,
    repeated rows rows of their own."""
    return op10_pii.redacted(docs)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is an empty one, of its end alone."""
    return op1_packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", private), ("packing", packing)]

#: Tokenizers and SimHash aren't SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
