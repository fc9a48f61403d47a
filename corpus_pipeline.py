"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
works on all that its predecessor kept. run() writes each stage's rows to the shared folder and reads them again, as the
driver does between stages; a stage's rows go when the next stage's are written.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns (whatever their names) go through
every stage: a null or empty text fails the quality rules, so that later stages see none of them; a repeated row is judged
like its first, counts as a document of its own in line dedup, and near-dedup keeps one of its copies; a row without
doc_id stays in near-dedup where no row of its class has one. Extra columns leave each stage but the last as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm.bpe import encode_documents
from barwright.llm.common import Scratch, read
from barwright.llm.decontaminate import clean_documents
from barwright.llm.linedup import drop_common_lines
from barwright.llm.neardup import keep_one
from barwright.llm.quality import kept_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    return kept_documents(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more of the documents go from all of them; n_chars follows the text."""
    return drop_common_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the least doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return encode_documents(docs, keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", bpe_encoding),
]

#: SQL expresses neither the trained labels nor the alignments; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "stage")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name.replace(" ", "-"))
            scratch.drop_all_but(docs)
    return docs
