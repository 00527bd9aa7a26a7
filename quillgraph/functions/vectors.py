"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a block: what a task holds of either side at once.
BLOCK_QUERIES, BLOCK_VECTORS = 256, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, least: float = 1e-9) -> Column:
    """Cosine; 0 where a side is null or shorter than `least`."""
    x, y = norm(a), norm(b)
    return F.coalesce(F.when((x >= least) & (y >= least), dot(a, b) / (x * y)), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 where both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def _blocks(vectors: DataFrame, size: int, prefix: str) -> tuple[DataFrame, int]:
    """(block, ids, vectors) of vectors (id, emb), and how many blocks there are."""
    n = max(1, -(-vectors.count() // size))
    b = vectors.select("id", "emb").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)))
    return b.groupBy(F.col("_b").alias(f"{prefix}_block")).agg(F.collect_list("id").alias(f"{prefix}_ids"), F.collect_list("emb").alias(f"{prefix}_vectors")), n


def block_scores(queries: DataFrame, vectors: DataFrame, least: float = 1e-9) -> DataFrame:
    """(qid, cid, cosine, distance) of all of queries (id, emb) with all of vectors (id, emb), multiplied block by block.

    Every block of queries meets every block of vectors in an equi-join on block
    numbers, and neither side is broadcast. Vectors have one length; none is null.
    A cosine is 0 where a side is shorter than `least`.
    """
    q, _ = _blocks(queries, BLOCK_QUERIES, "q")
    c, n = _blocks(vectors, BLOCK_VECTORS, "c")
    both = q.withColumn("c_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).join(c, "c_block")
    kinds = dict(queries.dtypes)["id"], dict(vectors.dtypes)["id"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                side = lambda name: b.column(name).slice(i, 1).flatten()  # noqa: B023, E731
                x, y = (np.asarray(side(f"{s}_vectors").flatten().to_numpy(zero_copy_only=False), float).reshape(len(side(f"{s}_ids")), -1) for s in "qc")
                product, xx, yy = x @ y.T, (x * x).sum(1), (y * y).sum(1)
                norms = np.sqrt(xx)[:, None] * np.sqrt(yy)
                known = (np.sqrt(xx) >= least)[:, None] & (np.sqrt(yy) >= least)
                cosines = np.where(known, product / np.where(known, norms, 1), 0.0)
                # differences, as the norms' sum less the product would lose digits of near vectors
                for at in range(len(x)):
                    apart = np.sqrt(((x[at] - y) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([pa.repeat(side("q_ids")[at], len(y)), side("c_ids"), pa.array(cosines[at]), pa.array(apart)], names=["qid", "cid", "cosine", "distance"])

    return both.select("q_ids", "q_vectors", "c_ids", "c_vectors").mapInArrow(multiply, f"qid {kinds[0]}, cid {kinds[1]}, cosine double, distance double")
