"""Shared helpers of the training-data operators: shipping, materialising, input columns."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.tables import shared_folder, ship

__all__ = ["columns_of", "documents_of", "drop_tables", "keyed", "materialize", "shared_folder", "ship", "ship_file", "small_batches", "tables_so_far"]
_NO_ID = -(2**63)


#: Rows of an Arrow batch while a table is written: bounds what JVM and Python hold at once.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file to the workers, once for each Spark context; they find it by SparkFiles.get(the returned name)."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_quillgraph_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    return os.path.basename(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows in what runs inside."""
    before = spark.conf.get(_BATCH, None)
    if before and 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. The
    table goes with drop_tables, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillgraph-{uuid.uuid4().hex}-{name}"
    with small_batches(spark):
        df.write.parquet(path)
    p, fs = _place(spark, path)
    fs.deleteOnExit(p)
    _tables(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillgraph_path = path
    return out


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _tables(spark: SparkSession) -> list[str]:
    return spark.sparkContext.__dict__.setdefault("_quillgraph_tables", [])


def tables_so_far(spark: SparkSession) -> int:
    return len(_tables(spark))


def drop_tables(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables that materialize wrote after `since` (of tables_so_far), but for those that it returned as `keep`."""
    made, kept = _tables(spark), {x._quillgraph_path for x in keep}
    for path in made[since:]:
        if path not in kept:
            p, fs = _place(spark, path)
            fs.delete(p, True)
    made[since:] = [x for x in made[since:] if x in kept]


def columns_of(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, each cast to its type; a missing one is null.

    Further columns, whatever their names, are left out, so they can't clash
    with the columns an operator adds.
    """
    there = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{c}`").cast(t) if c in there else F.lit(None).cast(t)).alias(c)
            for c, t in types.items()
        ]
    )


def documents_of(df: DataFrame) -> DataFrame:
    return columns_of(df, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")


def keyed(df: DataFrame) -> DataFrame:
    """Adds k1, k2: a document's identity by its id and its text.

    Rows equal in both are copies of one document and are treated alike. A null
    id counts as one reserved id.
    """
    return df.withColumn("k1", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn(
        "k2", F.xxhash64(F.coalesce("text", F.lit("")))
    )
