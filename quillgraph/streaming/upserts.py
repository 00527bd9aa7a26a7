"""Snapshot merges from a stream of staged files: each batch goes through the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.upserts import merged_snapshot


def merge_stream(spark: SparkSession, incoming: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merges every micro-batch of incoming (id, ..., update_date, seq) into versions of a Parquet table.

    Version n of the table is table/v=n, n batches on from version 0; a batch that
    is run again writes the same version.
    """

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        target = f"{table}/v={number + 1}"
        old = session.read.parquet(f"{table}/v={number}")
        merged_snapshot(old, batch).write.mode("overwrite").parquet(target)

    return incoming.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of a table that merge_stream has written."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(table)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return spark.read.parquet(f"{table}/v={max(int(x.getPath().getName().removeprefix('v=')) for x in there)}")
