"""The shared folder, tables in it that cut a plan or keep a state, and what workers need to run."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_quillgraph_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "quillgraph.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "quillgraph").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(target)
    context._quillgraph_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a local run (one JVM) takes a temporary folder of its
    own; on a cluster, where no other machine would see that, it is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
    own = getattr(spark.sparkContext, "_quillgraph_folder", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext._quillgraph_folder = own
    return own


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/quillgraph-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, group: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; group: bytes of a row group, which each task holds in memory (else as Parquet has it)."""
    path = shared_path(df.sparkSession)
    (df.write.option("parquet.block.size", group) if group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
