"""A training corpus from the documents table: rules, line and document deduplication, redaction, packing.

STAGES are applied in order; each takes all rows that the one before kept, and its frame is written as
Parquet and read again before the next. All but the last return the columns of documents. Null text
fails the rules; other defined results are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import jaccard, line_dedup, packing, pii, quality
from sieveworks.llm._common import cut, table
from sieveworks.llm.queries import public_file


def _with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the default policy."""
    return quality.keep(docs)


def drop_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are in an earlier document or place; those left without a word go."""
    done = line_dedup.dedup(docs, short_equal=True)
    left = (F.col("_lines_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _with_size(done.where(left).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return jaccard.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    done = pii.scan(docs.select(F.struct("*").alias("row"), "text"), keep=("row",), redacted=True)
    return _with_size(done.select(*[(F.col("redacted") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_duplicate_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Tokenisation and boosted trees are beyond SQL: tests/llm/ compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
