"""K-d tree sharding: documents split at weighted medians of their metadata.

Every level splits all open nodes at once. A node is split along the dimension
in which its documents spread widest, relative to the whole table; its cut is
the weighted median of that dimension, found by counting weights in 32768 bins
at a time, refined inside the bin that holds the median. Rows equal in the
dimension are told apart by a hash, and rows equal in everything by their number,
so a value or a row that a third of all rows share is cut where the weights ask
for it. A node is split while it has more than the target bytes. Names (source,
language) have hashed places, the same in every table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import documents_of, materialize

#: A dimension's bits in the composite key; a hash fills the rest.
COORD_BITS, TIE_BITS, STEP = 15, 45, 15
#: The tie's lowest bits, which tell rows apart that are equal in everything.
ROW_BITS = 22
#: A cut this close to its share of the node's weight needs no further counting.
TOLERANCE = 0.0005
DIMENSIONS = ("source", "lang", "length", "id")


def _metadata(docs: DataFrame) -> DataFrame:
    """One narrow row per document; text is read here only."""
    d = documents_of(docs)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    top = F.lit(2**COORD_BITS - 1)
    name = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit("")), F.lit(c)), F.lit(2**COORD_BITS))
    return d.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        name("source").alias("source"),
        name("lang").alias("lang"),
        F.least(top, (F.log2(size.cast("double")) * (2**COORD_BITS / 40)).cast("bigint")).alias("length"),
        F.coalesce("doc_id", F.lit(0)).alias("raw_id"),
        # a hash of the row, then one of its number, so that rows equal in everything can be parted
        (F.shiftleft(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(2 ** (TIE_BITS - ROW_BITS))), ROW_BITS) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**ROW_BITS))).alias("tie"),
    )


def kd_leaves(meta: DataFrame, dimensions: tuple[str, ...], leaves: int, tolerance: float = TOLERANCE) -> DataFrame:
    """meta with `leaf`, 0 to leaves - 1.

    meta: size (weight, >= 1), tie (a hash), and one column per dimension with
    values from 0 to 2**COORD_BITS - 1. What is broadcast, and what reaches the
    driver, is one row per tree node: twice the leaves at most.
    """
    out = meta.withColumn("node", F.lit(0).cast("bigint"))
    # node -> (first leaf, leaves below it)
    nodes = {0: (0, leaves)}
    spread = meta.agg(*[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))]).first()
    width = {d: max(1, (spread[f"hi_{d}"] or 0) - (spread[f"lo_{d}"] or 0)) for d in dimensions}
    while open_nodes := {k: v for k, v in nodes.items() if v[1] > 1}:
        extent = {
            r["node"]: r
            for r in out.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(f"x_{d}") for d in dimensions]).collect()
            if r["node"] in open_nodes
        }
        along = {k: max(dimensions, key=lambda d: (extent[k][f"x_{d}"] / width[d], -dimensions.index(d))) for k in extent}
        cuts = _medians(out, dimensions, along, {k: extent[k]["w"] for k in extent}, open_nodes, tolerance)
        after, steps = {k: v for k, v in nodes.items() if k not in open_nodes}, []
        fresh = max(nodes) + 1
        for k, (first, n) in open_nodes.items():
            left, right, fresh = fresh, fresh + 1, fresh + 2
            after[left], after[right] = (first, n // 2), (first + n // 2, n - n // 2)
            if k in cuts:  # a node without rows needs no cut
                steps.append((k, dimensions.index(along[k]), cuts[k], left, right))
        nodes = after
        if steps:
            table = _small(out, steps, "node", "dim", "cut", "lower", "upper")
            out = (
                out.join(F.broadcast(table), "node", "left")
                .withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).when(_key(dimensions) < F.col("cut"), F.col("lower")).otherwise(F.col("upper")))
                .drop("dim", "cut", "lower", "upper")
            )
            out = materialize(out, "nodes")  # narrow rows; else every level would carry the plans of those before
    names = _small(out, [(k, first) for k, (first, _) in nodes.items()], "node", "leaf")
    return out.join(F.broadcast(names), "node").drop("node").withColumn("leaf", F.col("leaf").cast("int"))


def _small(like: DataFrame, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """A table of one row a node."""
    return like.sparkSession.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))


def _key(dimensions: tuple[str, ...]):
    """The composite key along the dimension whose number is in `dim`."""
    value = F.col(dimensions[-1])
    for i, d in enumerate(dimensions[:-1]):
        value = F.when(F.col("dim") == i, F.col(d)).otherwise(value)
    return F.shiftleft(value.cast("bigint"), TIE_BITS) + F.col("tie")


def _medians(rows: DataFrame, dimensions: tuple[str, ...], along: dict[int, str], weight: dict[int, int], parts: dict, tolerance: float) -> dict[int, int]:
    """For each node the smallest key of its right part."""
    bits = COORD_BITS + TIE_BITS
    # node -> (bin's start, weight before the bin, weight wanted on the left)
    state = {k: (0, 0, weight[k] * (parts[k][1] // 2) // parts[k][1]) for k in along}
    cuts: dict[int, int] = {}
    while bits and state:
        shift = bits - STEP
        table = _small(rows, [(k, dimensions.index(along[k]), lo, goal - before) for k, (lo, before, goal) in state.items()], "node", "dim", "start", "want")
        bins = (
            rows.select("node", "size", "tie", *dimensions)
            .join(F.broadcast(table), "node")
            .withColumn("bin", F.shiftright(_key(dimensions) - F.col("start"), shift))
            .filter(F.col("bin").between(0, 2**STEP - 1))
            .groupBy("node", "want", "bin")
            .agg(F.sum("size").alias("w"))
        )
        # at most 2**STEP bins a node reach this window; one row a node reaches the driver
        below = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) - F.col("w")
        found = (
            bins.withColumn("below", below)
            .filter(F.col("below") < F.col("want"))
            .groupBy("node")
            .agg(F.max_by(F.struct("bin", "below", "w"), "bin").alias("b"))
            .collect()
        )
        for k in set(state) - {r["node"] for r in found}:
            cuts[k] = state.pop(k)[0]  # nothing is wanted on the left
        for r in found:
            k, b = r["node"], r["b"]
            lo, before, goal = state.pop(k)
            before, lo = before + b["below"], lo + (b["bin"] << shift)
            if goal - before <= tolerance * weight[k] or (shift == 0 and goal - before < b["w"] / 2):
                cuts[k] = lo
            elif before + b["w"] - goal <= tolerance * weight[k] or shift == 0:
                cuts[k] = lo + (1 << shift)
            else:
                state[k] = (lo, before, goal)
        bits = shift
    return cuts


def with_slots(rows: DataFrame, shard: str = "shard", most: int = 500_000) -> DataFrame:
    """Adds slot: 0 to the shard's row count less 1, each once.

    Rows are numbered inside hash buckets of a shard of about `most` rows, so that no task gets a whole shard.
    """
    buckets = max(64, -(-rows.count() // most))
    b = rows.withColumn("_b", F.pmod(F.col("tie"), F.lit(buckets)).cast("int"))
    counts = b.groupBy(shard, "_b").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy(shard).orderBy("_b")) - F.col("_n"))
    inside = F.row_number().over(Window.partitionBy(shard, "_b").orderBy("tie", "doc_id", "size")) - 1
    return (
        b.withColumn("_i", inside)
        .join(first.select(shard, "_b", "_first"), [shard, "_b"])
        .withColumn("slot", (F.col("_first") + F.col("_i")).cast("bigint"))
        .drop("_b", "_i", "_first")
    )


def shard_documents(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """Every document's shard, so that the shards' bytes are near equal (law `bytes`).

    docs: doc_id, text, lang, source. target_bytes is the size that no leaf should
    exceed; without it, it is the part of one of `shards` in all bytes. Returns
    doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot. Null texts have size
    1; null metadata counts as empty; repeated rows are documents of their own; an
    empty table gives no rows. A document larger than the target makes its shard larger.
    """
    meta = materialize(_metadata(docs), "metadata")
    span = meta.agg(F.min("raw_id").alias("lo"), F.max("raw_id").alias("hi"), F.sum("size").alias("w")).first()
    total = span["w"] or 0
    target = target_bytes or max(1, -(-total // shards))
    lo, hi = span["lo"] or 0, span["hi"] or 0
    scaled = (F.col("raw_id").cast("double") - float(lo)) / max(1.0, float(hi) - float(lo)) * (2**COORD_BITS - 1)
    meta = meta.withColumn("id", scaled.cast("bigint"))
    # a node's leaves are its bytes by the target
    out = kd_leaves(meta, DIMENSIONS, max(1, -(-total // target))).withColumnRenamed("leaf", "shard")
    return with_slots(out).select("doc_id", "size", "text_crc32", "shard", "slot")
