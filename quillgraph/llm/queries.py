"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.oracles import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.near_dedup import near_classes

    return near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillgraph.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.sharding import shard_documents

    d = shard_documents(_table(spark, sf_dir, "documents"), 16)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.exact_topk import exact_topk

    return exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.html_main import extract_main

    return extract_main(_table(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.mixing import taken_words

    return taken_words(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.quality import quality_verdicts

    return quality_verdicts(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.span_dedup import dedup_spans

    return dedup_spans(_table(spark, sf_dir, "documents"), both_ends=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minhash_near_dedup, op2_best_fit_packing, op3_kd_sharding, op4_exact_topk, op5_personal_data, op6_line_dedup, op7_html_main_text, op8_source_mixing, op9_quality_rules, op10_span_dedup, pipeline)
    return {f.__name__: f for f in own}
