"""A training corpus from documents: quality rules, line dedup, near-dedup, source mixing, segmentation.

Each stage takes what its predecessor kept; all but the last return the columns of documents. Null and empty texts have no words
and go with the quality rules; a later stage that is given them keeps them. A null doc_id or source is a value like others, repeated
rows are rows, no text is cut, columns may have any names, and empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.common import forget, saved
from spanveil.llm.linededup import drop_frequent_lines
from spanveil.llm.mixing import mix_documents
from spanveil.llm.neardup import first_of_group
from spanveil.llm.quality import keep_good
from spanveil.llm.segment import numbered_repeats, sample_segmentations


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that at least ten documents hold; the documents stay."""
    return drop_frequent_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicate texts, the one with the smallest doc_id; a doc_id with two unlike texts may keep one."""
    return first_of_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample segmentations of each text. Rows that repeat a document, as the mix makes them, are numbered (``pass``), and each gets
    samples of its own."""
    return sample_segmentations(numbered_repeats(docs), repeat="pass")


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mix sources", mix), ("sentencepiece", encode)]

#: The last stage samples segmentations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is removed as soon as its successor has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
