"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import drop_tables, materialize, tables_so_far
from quillgraph.llm.line_dedup import without_repeated_lines
from quillgraph.llm.mixing import mixed_documents
from quillgraph.llm.near_dedup import one_of_each_class
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.quality import kept_documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 9)."""
    return kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line chunks (operator 6)."""
    return without_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (operator 1)."""
    return one_of_each_class(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights (operator 8): a row for each pass over a document."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences (operator 2)."""
    return pack_documents(docs, TOKENIZER)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the distances' references, nor sampling, nor best-fit packing; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again; what a stage has read goes when it is done."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_so_far(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
            drop_tables(spark, since, docs)
    return docs
