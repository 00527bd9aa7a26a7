"""Exact top-k by inner product with a vector-approximation file.

Every distinct integer vector gets an approximation: per dimension the number of
a cell of a uniform grid. Approximations are packed into blocks, blocks into
parts. A task holds one block of queries against the approximations of one part,
block by block, and bounds each score from the cells alone; a candidate stays
while its upper bound reaches the k-th best lower bound that the task has seen,
so that a task passes on about k candidates a query, however many it has read.
Over all parts the k-th best lower bound leaves the candidates whose exact
vectors are read, in the order of upper bounds: first the k best by upper bound,
then only those whose upper bound reaches the k-th exact score so far, after
which the result is certain.

Equal vectors are one candidate; of a vector, only its few smallest ids can be
in any list, since scores are equal and ties go to the smaller id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import columns_of, materialize, ship

CELLS = 256
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 256
#: Blocks of approximations that one task reads for a block of queries.
PART_BLOCKS = 64


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows null, empty, or with null or non-finite components are left out."""
    e = columns_of(vectors, vec_id="bigint", embedding="array<double>").filter("vec_id is not null and size(embedding) > 0")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.filter(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"))


def _shapes(rows: DataFrame, cells: int) -> DataFrame:
    """(dim, n, lo, width): for each vector length its vectors and the grid of its components; one row a length."""
    limits = rows.select("dim", F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / cells)).cast("bigint")
    grid = limits.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", width.alias("width")))).alias("g"))
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, "dim").select("dim", "n", F.col("g.lo").alias("lo"), F.col("g.width").alias("width"))


def _packed(rows: DataFrame, block: int, numbers: str, name: str) -> DataFrame:
    """(dim, block, ids, data): rows (dim, n, vec_id, x array) in blocks, their numbers as bytes of a numpy type."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.stack([np.asarray(v, numbers) for v in pdf["x"]])
        return pd.DataFrame({"dim": [int(key[0])], "block": [int(key[1])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "data": [x.tobytes()]})

    b = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / block).cast("bigint"))).select("dim", "block", "vec_id", "x")
    return materialize(b.groupBy("dim", "block").applyInPandas(pack, "dim int, block bigint, ids binary, data binary"), name)


def _scan(need: int):
    """Tasks over rows in the order of (dim, q_block, part, block): for each query the candidates that may be among its `need` best."""

    def bounds(q: np.ndarray, q_ids: np.ndarray, blocks: Iterator[dict]) -> pa.RecordBatch:
        best = np.full((len(q), need), -np.inf)
        pending: list[tuple[np.ndarray, ...]] = []
        for r in blocks:
            lo, width = np.asarray(r["lo"], float), np.asarray(r["width"], float)
            ids = np.frombuffer(r["ids"], np.int64)
            middle = lo + np.frombuffer(r["data"], np.uint8).reshape(len(ids), -1) * width + (width - 1) / 2
            mid = q @ middle.T
            # half a cell each way, and what floating point may lose
            reach = (np.abs(q) @ ((width - 1) / 2) + 1e-9 * (np.abs(q) @ np.abs(middle).max(0)) + 1e-6)[:, None]
            top = np.partition(mid, -need, axis=1)[:, -need:] if mid.shape[1] > need else mid
            both = np.hstack([best, top - reach])
            best = np.partition(both, -need, axis=1)[:, -need:]
            row, col = np.nonzero(mid + reach >= best.min(1)[:, None])
            pending.append((row, ids[col], (mid - reach)[row, col], (mid + reach)[row, col]))
            if sum(len(p[0]) for p in pending) > 1_000_000:  # what a later block has ruled out
                pending = [tuple(x[keep] for x in p) for p in pending for keep in [p[3] >= best.min(1)[p[0]]]]
        row, c, lower, upper = (np.concatenate(x) for x in zip(*pending, strict=True))
        keep = upper >= best.min(1)[row]
        return pa.RecordBatch.from_arrays([pa.array(q_ids[row[keep]]), pa.array(c[keep]), pa.array(lower[keep]), pa.array(upper[keep])], names=["q", "c", "lower", "upper"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows))
        for _, some in itertools.groupby(rows, key=lambda r: (r["dim"], r["q_block"], r["part"])):
            first = next(some)
            q_ids = np.frombuffer(first["q_ids"], np.int64)
            q = np.frombuffer(first["q_data"], np.int64).reshape(len(q_ids), -1).astype(np.float64)
            yield bounds(q, q_ids, itertools.chain([first], some))

    return scan


def exact_topk(vectors: DataFrame, queries, k: int = 20, scale: float = 64.0, cells: int = CELLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best by inner product of the scaled integer vectors.

    vectors: vec_id, embedding. queries: a condition on vec_id; candidates are
    all rows but the query's own. Ties go to the smaller vec_id. Only vectors of
    equal length are compared. Rows without a vec_id, and vectors that are null,
    empty or hold null or non-finite components, take no part. Rows that repeat a
    vec_id count each, but never for that id's own query.
    """
    spark = vectors.sparkSession
    ship(spark)
    all_rows = materialize(quantised(vectors, scale).withColumn("dim", F.size("v")), "vectors")
    asked = all_rows.filter(queries).select("vec_id", "v")
    # a query's own rows, one unless its id is repeated, may stand among its best
    own = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    need = k + own
    # the smallest ids of each distinct vector; the window drops the rest before its shuffle, too
    few = Window.partitionBy("v").orderBy("vec_id")
    ids = all_rows.withColumn("rn", F.row_number().over(few)).filter(F.col("rn") <= need).groupBy("dim", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    ids = materialize(ids.withColumn("rep", F.monotonically_increasing_id()), "classes")
    query_classes = materialize(ids.join(asked.select("v").distinct(), "v", "left_semi").select("dim", "v", F.col("rep").alias("vec_id")), "queries")
    # only lengths that a query has
    ids = materialize(ids.join(query_classes.select("dim").distinct(), "dim", "left_semi"), "candidates")
    shapes = materialize(_shapes(ids, cells), "shapes")
    grid = F.arrays_zip("lo", "width")
    approximation = F.zip_with("v", grid, lambda x, g: F.floor((x - g["lo"]) / g["width"]).cast("smallint"))
    cand = _packed(ids.join(shapes, "dim").select("dim", "n", F.col("rep").alias("vec_id"), approximation.alias("x")), BLOCK_VECTORS, "uint8", "approximations")
    asked_n = query_classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    quer = _packed(query_classes.join(asked_n, "dim").select("dim", "n", "vec_id", F.col("v").alias("x")), BLOCK_QUERIES, "int64", "query-blocks")
    both = cand.join(quer.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "dim").join(shapes.select("dim", "lo", "width"), "dim")
    both = both.withColumn("part", F.floor(F.col("block") / PART_BLOCKS))
    pairs = max(1, cand.count() * quer.count() // PART_BLOCKS)
    key = ("dim", "q_block", "part")
    both = both.repartition(max(4 * spark.sparkContext.defaultParallelism, min(pairs, 100_000)), *key).sortWithinPartitions(*key, "block")
    bounds = materialize(both.mapInArrow(_scan(need), "q bigint, c bigint, lower double, upper double"), "bounds")
    kth = Window.partitionBy("q").orderBy(F.col("lower").desc())
    least = bounds.withColumn("rn", F.row_number().over(kth)).filter(F.col("rn") <= need).groupBy("q").agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n"))
    left = bounds.join(least, "q").filter((F.col("upper") >= F.col("least")) | (F.col("n") < need))
    order = Window.partitionBy("q").orderBy(F.col("upper").desc(), "c")
    left = materialize(left.withColumn("place", F.row_number().over(order)).select("q", "c", "upper", "place"), "left")
    exact_c, exact_q = ids.select(F.col("rep").alias("c"), F.col("v").alias("cv"), "ids"), query_classes.select(F.col("vec_id").alias("q"), F.col("v").alias("qv"))
    score = F.aggregate(F.zip_with("cv", "qv", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
    read = lambda p: p.join(exact_c, "c").join(exact_q, "q").select("q", "c", "ids", score.alias("score"))
    first = materialize(read(left.filter(F.col("place") <= need)), "first")
    certain = first.groupBy("q").agg(F.min("score").alias("least"))
    rest = left.filter(F.col("place") > need).join(certain, "q").filter(F.col("upper") >= F.col("least"))
    scored = first.unionByName(read(rest))
    # as many classes, then rows, as are asked for and may be the query's own
    top = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("ids")[0])
    rows = scored.withColumn("rn", F.row_number().over(top)).filter(F.col("rn") <= need).select("q", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    rows = rows.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= need).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("list"))
    lists = rows.join(query_classes.select(F.col("vec_id").alias("q"), "v"), "q").select("v", "list")
    out = asked.join(lists, "v").withColumn("list", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("vec_id")), 1, k))
    return out.select(F.col("vec_id").alias("query_id"), F.posexplode("list").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
