"""A corpus pipeline of five operators; each stage's documents are written and reread as the next one's.

Every stage takes the columns of documents by name and ignores others.  Null texts count
as empty; the first stage drops these and all that have fewer than ten words.  Null ids,
languages, sources and n_chars stay null.  Repeated rows are judged each until
near-duplicates leave one of them.  An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versograph.llm import op05_bpe, op07_decontaminate, op08_secrets, op09_rules, op10_simhash
from versograph.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie too far from their language and source go."""
    return op09_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked fingerprints stays."""
    return op10_simhash.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return op07_decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return op08_secrets.redacted_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents left."""
    return op05_bpe.encode_documents(docs, *op05_bpe.public_codec(), ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", bpe_encoding),
]

#: SQL can't express the robust estimates, the near-duplicate classes, the alignments or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
