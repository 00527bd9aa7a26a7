"""Mixing sources to target weights by blocks of tokens.

The words of a source, its documents in a fixed order, are cut into blocks of
`block` words. Output shards have fixed numbers of slots; each slot draws its
source by the target shares, so a shard's source counts are multinomial. A
source's slots, over all shards in order, are numbered; slots drawn beyond a
source's target go to the sources that drew too few. Slot j of a source takes
block perm(j), by a keyed pseudorandom permutation of the source's block
indices, a new one for each pass. Blocks and documents meet by block index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import documents_of, materialize, ship
from quillgraph.llm.words import spread

BLOCK_WORDS = 256
SHARD_SLOTS = 1024
MAX_PASSES = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Intervals of the unit line by which drawn numbers meet the sources' shares.
CELLS = 4096
#: Rows that are summed in one task, documents of a source or its counts by shard; parts of a source follow from that.
PART_ROWS = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a four-round Feistel
    network on the next even power of two, walked until it falls below n."""
    x, n = index.astype(np.uint64), n.astype(np.uint64)
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(int) // 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    for _ in range(10_000):
        if not len(todo):
            break
        h, m = half[todo], mask[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in (range(3, -1, -1) if inverse else range(4)):
            if inverse:
                left, right = right ^ (spread(left + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & m), left
            else:
                left, right = right, left ^ (spread(right + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _permute(df: DataFrame, out: str, index: str, n: str, key: str, inverse: bool = False) -> DataFrame:
    @F.pandas_udf("bigint")
    def udf(i: pd.Series, m: pd.Series, k: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(permuted(i.to_numpy(), m.to_numpy(), k.to_numpy().astype(np.int64).view(np.uint64), inverse))

    return df.withColumn(out, udf(index, n, key))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """sizes: source (null sorts last), size. Adds weight and target.

    Weights repeat over the sources by code point; shares are of all sizes
    together; a target stops at `most` times its source's size and the excess is
    shared anew by weight until none is above. One row per source.
    """
    # a row per source only, in one sort that can spill
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("weight", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("full", F.col("size") * most).withColumn("ratio", F.col("full") / F.col("weight"))
    # sources stop in the order of full / weight: with those before stopped, the level is (total - full before) / (weight not stopped)
    by = Window.orderBy("ratio", F.col("source").cast("binary").asc_nulls_last())
    everything = Window.partitionBy()
    s = (
        s.withColumn("before_full", F.sum("full").over(by) - F.col("full"))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.sum("weight").over(by) + F.col("weight"))
        .withColumn("total", F.sum("size").over(everything))
        .withColumn("level", (F.col("total") - F.col("before_full")) / F.col("left_weight"))
    )
    # the first source that does not stop fixes the level; with none, all stop
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything).getField("level")
    s = s.withColumn("first", level)
    target = F.when(F.col("first").isNull(), F.col("full").cast("double")).otherwise(F.least(F.col("full").cast("double"), F.col("first") * F.col("weight")))
    return s.withColumn("target", target).select("source", "size", "weight", "target")


_SOURCE_KEY = "concat(if(source is null, 'n', 's'), coalesce(source, ''))"


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """uid, doc_id, source, s (the source as a key), size in words, h and more columns; written once."""
    d = documents_of(docs).select(
        "doc_id", "source", F.expr(_SOURCE_KEY).alias("s"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("doc_id", "text", "lang").alias("h"), *more,
    )
    return materialize(d.withColumn("uid", F.monotonically_increasing_id()), "sizes")


def _located(rows: DataFrame) -> DataFrame:
    """uid, doc_id, source, s, size, at: the words of its source before a document.

    A source's documents are summed inside hash buckets of about PART_ROWS at most,
    so that no task gets a whole source.
    """
    rows = rows.withColumn("b", F.pmod("h", F.lit(max(256, -(-rows.count() // PART_ROWS)))).cast("int"))
    part = rows.groupBy("s", "b").agg(F.sum("size").alias("n"))
    first = part.withColumn("first", F.sum("n").over(Window.partitionBy("s").orderBy("b")) - F.col("n")).drop("n")
    inside = F.sum("size").over(Window.partitionBy("s", "b").orderBy("h", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.select("uid", "doc_id", "source", "s", "size", "h", "b").withColumn("i", F.coalesce(inside, F.lit(0)))
        .join(first, ["s", "b"]).withColumn("at", F.col("first") + F.col("i"))
        .select("uid", "doc_id", "source", "s", "size", "at")
    )


def _running(counts: DataFrame) -> DataFrame:
    """(shard, s, first): a source's slots in the shards before, by ranges of shards, so that no task gets all shards of a source."""
    whole = counts.groupBy("s", "range").agg(F.sum("n").alias("all"))
    before = whole.withColumn("before", F.sum("all").over(Window.partitionBy("s").orderBy("range")) - F.col("all")).drop("all")
    inside = F.sum("n").over(Window.partitionBy("s", "range").orderBy("shard")) - F.col("n")
    return counts.withColumn("inside", inside).join(before, ["s", "range"]).select("shard", "s", (F.col("before") + F.col("inside")).alias("first"))


def _slots(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(s, j): every slot's source and its number among the source's slots.

    plan: s, slots, lo, hi (share of the unit line), one row per source.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("slots")).first()[0] or 0
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    shares = plan.filter("slots > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))).select("s", "lo", "hi", "cell")
    u = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(2**40)) / float(2**40)
    drawn = (
        spark.range(total).select(F.col("id").alias("i"), F.floor(F.col("id") / shard_slots).alias("shard"))
        .withColumn("u", u).withColumn("cell", cell(F.col("u")))
        .join(shares, "cell").filter("u >= lo and u < hi").select("shard", "i", "s")
    )
    counts = drawn.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n"))
    first = _running(counts.withColumn("range", F.floor(F.col("shard") / PART_ROWS)))
    j = F.row_number().over(Window.partitionBy("shard", "s").orderBy("i")) - 1
    numbered = drawn.withColumn("r", j).join(first, ["shard", "s"]).select("shard", "i", "s", (F.col("first") + F.col("r")).alias("j"))
    # slots beyond a source's number move to the sources that drew too few
    had = plan.join(counts.groupBy("s").agg(F.sum("n").alias("had")), "s", "left").fillna(0, ["had"])
    by = Window.orderBy("s")
    over = F.greatest(F.col("had") - F.col("slots"), F.lit(0))
    under = F.greatest(F.col("slots") - F.col("had"), F.lit(0))
    had = had.withColumn("over0", F.sum(over).over(by) - over).withColumn("under0", F.sum(under).over(by) - under)
    wanted = (
        had.filter(under > 0).withColumn("d", F.explode(F.sequence(F.lit(0).cast("bigint"), under - 1)))
        .select((F.col("under0") + F.col("d")).alias("m"), F.col("s").alias("to"), (F.col("had") + F.col("d")).alias("to_j"))
    )
    marked = numbered.join(had.select("s", "slots", "over0"), "s")
    kept = marked.filter("j < slots").select("shard", "i", "s", "j")
    moved = (
        marked.filter("j >= slots").withColumn("m", F.col("over0") + F.col("j") - F.col("slots"))
        .join(wanted, "m").select("shard", "i", F.col("to").alias("s"), F.col("to_j").alias("j"))
    )
    return kept.unionByName(moved)


def mix(rows: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_PASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, uses) for rows of _rows.

    documents: uid, doc_id, source, s, size, at. sources: s, source, size, target,
    and its blocks. uses: shard, i (slot), s, block, pass, words (the block's first
    words that the slot takes). Null texts have no words and are never taken; a
    null source is a source of its own; repeated rows are documents of their own.
    """
    ship(rows.sparkSession)
    located = materialize(_located(rows), "located")
    sizes = located.groupBy("s", "source").agg(F.sum("size").alias("size"))
    t = source_targets(sizes.select("source", "size"), weights, most)
    t = t.withColumn("s", F.expr(_SOURCE_KEY))
    # whole passes, then as many blocks of a further pass as reach the rest; the last of them is cut to fit
    t = (
        t.withColumn("blocks", F.ceil(F.col("size") / block))
        .withColumn("words", F.least(F.round("target").cast("bigint"), F.col("size") * most))
        .withColumn("passes", F.when(F.col("size") > 0, F.floor(F.col("words") / F.col("size"))).otherwise(0))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("size"))
        .withColumn("last", F.col("size") - (F.col("blocks") - 1) * block)
        .withColumn("key", F.xxhash64(F.lit(seed), "s", "passes"))
        .withColumn("short", F.greatest(F.col("blocks") - 1, F.lit(0)))
    )
    t = _permute(t, "short_at", "short", "blocks", "key", inverse=True)
    plain = F.ceil(F.col("rest") / block)
    # with the short block among the first `plain` ones, one more may be needed
    has_short = F.col("short_at") < plain
    words_of_plain = plain * block - F.when(has_short, block - F.col("last")).otherwise(0)
    more = F.when(F.col("rest") == 0, F.lit(0)).otherwise(plain + F.when(words_of_plain < F.col("rest"), 1).otherwise(0))
    t = t.withColumn("more", F.least(more, F.col("blocks")))
    before_last = (F.col("more") - 1) * block - F.when(F.col("short_at") < F.col("more") - 1, block - F.col("last")).otherwise(0)
    t = t.withColumn("cut", F.when(F.col("more") > 0, F.col("rest") - before_last)).withColumn("slots", F.col("passes") * F.col("blocks") + F.col("more"))
    share = F.sum("slots").over(Window.orderBy("s"))
    everything = F.sum("slots").over(Window.partitionBy())
    t = t.withColumn("lo", (share - F.col("slots")) / everything).withColumn("hi", share / everything)
    t = materialize(t.select("s", "source", "size", "weight", "target", "blocks", "slots", "passes", "last", "cut", "lo", "hi"), "sources")
    u = _slots(t.select("s", "slots", "lo", "hi"), shard_slots, seed).join(t.select("s", "blocks", "slots", "last", "cut"), "s")
    u = u.withColumn("pass", F.floor(F.col("j") / F.col("blocks"))).withColumn("x", F.col("j") % F.col("blocks")).withColumn("key", F.xxhash64(F.lit(seed), "s", "pass"))
    u = _permute(u, "block", "x", "blocks", "key")
    whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("last")).otherwise(F.lit(block))
    words = F.when((F.col("j") == F.col("slots") - 1) & F.col("cut").isNotNull(), F.col("cut")).otherwise(whole)
    uses = u.select("shard", "i", "s", "block", "pass", words.cast("bigint").alias("words"))
    return located, t, uses


def fragments(located: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The blocks that each document meets: s, block, uid, and from, to (words of the block)."""
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    f = located.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    return f.select(
        "s", "block", "uid", "at", "size",
        F.greatest(F.col("at") - F.col("block") * block, F.lit(0)).alias("from"),
        F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block)).alias("to"),
    )


def taken_words(docs: DataFrame, block: int = BLOCK_WORDS, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (repeats counted)."""
    located, sources, uses = mix(_rows(docs), block, **options)
    # a block is used once a pass, and has a row for each
    per_block = uses.groupBy("s", "block").agg(F.collect_list("words").alias("used"))
    got = F.aggregate("used", F.lit(0).cast("bigint"), lambda a, w: a + F.greatest(F.least(F.col("to"), w) - F.col("from"), F.lit(0)))
    taken = fragments(located, block).join(per_block, ["s", "block"]).select("uid", got.alias("t")).groupBy("uid").agg(F.sum("t").alias("taken"))
    return (
        located.join(taken, "uid", "left").join(sources.select("s", F.col("size").alias("source_size"), "target"), "s")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix as documents: for each pass over a document, the words taken of it, joined by blanks.

    A document that a pass takes whole keeps its text as it is. Columns as of
    documents; n_chars counts the new text.
    """
    rows = _rows(docs, "text", "lang")
    located, _, uses = mix(rows, block, **options)
    to = F.least("to", "words")
    span = (
        fragments(located, block).join(uses, ["s", "block"]).filter(to > F.col("from"))
        .select("uid", "pass", (F.col("block") * block + F.col("from") - F.col("at")).cast("int").alias("a"), (to - F.col("from")).cast("int").alias("n"))
    )
    runs = span.groupBy("uid", "pass").agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias("runs"), F.sum("n").alias("words"))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    part = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, r["a"] + 1, r["n"]))), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(part)
    return rows.join(runs, "uid").withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
