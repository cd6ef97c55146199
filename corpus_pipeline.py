"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and all rows its predecessor kept; its result is written as Parquet to the
shared folder and reread as the next one's docs. Columns of other names pass through all stages but the last.

Defined cases, the same in every stage: null texts count as empty; an empty table stays one; rows without doc_id are rows
like others (of a group of near copies a row with an id is kept first); repeated rows are scored, cut and packed each for
itself, and collapse to one in near-dedup; rows of one doc_id with unlike texts are different documents throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logfold.llm import linededup, mixing, packing, quality, simhash
from logfold.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more stay; the others go."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from the texts; every row stays."""
    return linededup.drop_repeated_chunks(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (Jaccard likeness of five-word shingles of 0.8 or more)."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target shares: documents are repeated, cut or left out by blocks."""
    return mixing.mixture(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality", keep_quality), ("line_dedup", cut_repeated_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_windows),
]

#: Tokenizing, XXH64 and trained trees have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
