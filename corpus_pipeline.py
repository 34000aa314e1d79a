"""A corpus pipeline: quality, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), docs being all that the stage before it kept, and returns a
DataFrame; all but the last return the columns of documents. Between stages the rows are written as
Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import stored, table
from docloom.llm.exact_dedup import drop_exact_duplicates
from docloom.llm.mixing import mix_documents
from docloom.llm.near_dup import drop_near_duplicates
from docloom.llm.packing import pack_documents
from docloom.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 or more)."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), least=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return drop_exact_duplicates(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), the smallest doc_id."""
    return drop_near_duplicates(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of training; a document of which it takes a part counts as taken."""
    return mix_documents(docs, weights=(5, 2, 1), max_repeat=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens: one row per piece of a document."""
    return pack_documents(docs, most=1024, with_ids=False).drop("ids")


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the packing cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
