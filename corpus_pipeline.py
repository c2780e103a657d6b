"""The training-data pipeline: five stages over the table of documents.

Each stage takes (spark, docs, folder), works on all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's documents; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, near, pieces, quality, substring
from tidewatch.llm.common import table, tokenizer_path
from tidewatch.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, folder, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 connect, the one with the smallest doc_id."""
    return near.deduplicated(docs, words=5)


def substring_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without spans of 13 and more words that an earlier document has; n_chars counts what is left."""
    return substring.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, table(spark, folder, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sampled segmentations of each document with their ids, from the first on."""
    return pieces.encoded(docs, tokenizer_path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", piece_stage),
]

#: learned scores and sampled segmentations have no SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs
