"""A training corpus from raw documents: quality rules, line and near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import free_name, written
from quirelake.llm.line_dedup import dedup_lines
from quirelake.llm.mixing import mix_documents
from quirelake.llm.packing import pack_documents
from quirelake.llm.quality_rules import quality_rules
from quirelake.llm.simhash import one_of_each


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    verdict = free_name(docs, "__quality")
    return quality_rules(docs, docs.columns, result=verdict).where(f"{verdict}.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds; n_chars follows the text."""
    lines = free_name(docs, "__lines")
    left = dedup_lines(docs, result=lines)
    kept = F.col(f"{lines}.kept")
    changed = {"text": kept, "n_chars": F.char_length(kept).cast("long")}
    return left.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources holds them."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SimHash groups, perplexity bands and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
