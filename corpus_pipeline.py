"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination and packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

An empty table stays empty at each stage. A null text stays null until it is packed, as the end token alone. Rows with a null doc_id count as
rows of their own; repeated rows are told apart only as each stage says. Very long texts are whole at each stage, and further columns,
whatever their names, are passed on to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, linededup, neardup, packing, toxicity
from tessella.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, with the threshold of their language, doesn't reject. Null and empty texts have the score of no words; without labels all stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; each template stays in its first document. Null texts stay null, a text whose lines all go is empty."""
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 0.8 or more of their runs of five words in common. Rows without words all stay."""
    return neardup.drop_near_duplicates(docs, 5, 80, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts have none; with an empty benchmark all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a null or empty text is one token, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the classifier, the near-dedup of whole texts at this size, or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
