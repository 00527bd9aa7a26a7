"""Line dedup by content-defined chunks, in DataFrame functions only.

A text's lines (but for blank ones) are hashed, and a rolling hash over each two
lines in a row says whether that pair is an anchor; a text's first and last pairs
always are. Chunks are the anchor pairs themselves, and the lines from one anchor
to the next, both included, where lines lie between them. What decides a chunk's
ends thus lies inside the chunk, so that a passage has the same chunks wherever it
stands. A chunk that has occurred before, in document and line order, is removed
once its bytes have been compared with those of its first occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import documents_of, drop_tables, keyed, materialize, tables_so_far

#: A pair of lines is no anchor where the rolling hash leaves no remainder by this: two pairs of three are anchors.
DIVISOR = 3
_SHIFT = 2**31


def _with_lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))


def _full(c):
    """Whether there is more than white space."""
    return F.trim(F.translate(c, "\n\t\r\x0b\x0c", "     ")) != ""


def _with_chunks(docs: DataFrame) -> DataFrame:
    """Adds lines and chunks: each chunk is first line * 2**31 + number of lines, blank lines inside it counted."""
    d = _with_lines(docs).withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _full(F.get("lines", i))))
    d = d.withColumn("_h", F.transform("_at", lambda i: F.conv(F.substring(F.md5(F.get("lines", i).cast("binary")), 1, 7), 16, 10).cast("bigint")))
    last = F.size("_at") - 1
    rolling = lambda j: F.get("_h", j) * 31 + F.get("_h", j - 1) * 17
    anchors = F.when(last >= 1, F.filter(F.sequence(F.lit(1), last), lambda j: (j == 1) | (j == last) | (F.pmod(rolling(j), F.lit(DIVISOR)) != 0)))
    d = d.withColumn("_anchors", F.coalesce(anchors, F.array().cast("array<int>")))
    code = lambda a, b: F.get("_at", a).cast("bigint") * _SHIFT + (F.get("_at", b) - F.get("_at", a) + 1)
    pairs = F.transform("_anchors", lambda j: code(j - 1, j))
    spans = F.filter(F.transform("_anchors", lambda j, k: F.when(F.get("_anchors", k + 1) - j > 2, code(j - 1, F.get("_anchors", k + 1)))), lambda c: c.isNotNull())
    return d.withColumn("chunks", F.concat(pairs, spans)).drop("_at", "_h", "_anchors")


def _first(code):
    return F.floor(code / _SHIFT).cast("int")


def _count(code):
    return (code % _SHIFT).cast("int")


def _text_of(code):
    return F.array_join(F.slice("lines", _first(code) + 1, _count(code)), "\n")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, source) plus n_lines, n_removed: texts without repeated chunks.

    First occurrences are in the order of doc_id, text hash and line. A null or
    empty text has one empty line and is unchanged (a null one becomes empty).
    Rows equal in id and text are one document and lose the same chunks. Chunks
    repeated inside one text also go. A single line is never a chunk.
    """
    spark = docs.sparkSession
    since = tables_so_far(spark)
    d = keyed(documents_of(docs))
    # two hashes, so that a chunk whose first one collides still meets its own first occurrence
    key, place = ["hash", "hash2"], F.struct("k1", "k2", "code")
    hashed = F.transform("chunks", lambda c: F.struct(c.alias("code"), F.xxhash64(_text_of(c)).alias("hash"), F.xxhash64(F.lit(1), _text_of(c)).alias("hash2")))
    occ = materialize(_with_chunks(d).select("k1", "k2", F.explode(hashed).alias("c")).select("k1", "k2", "c.code", "c.hash", "c.hash2"), "chunks")
    # written, so that the join deals both sides out anew and a frequent chunk's partition can be split
    repeated = materialize(occ.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select(*key, "first"), "hashes")
    again = materialize(occ.join(repeated, key), "repeated")
    drop_tables(spark, since, again)
    # the texts of repeated chunks, for the comparison of bytes
    lists = again.groupBy("k1", "k2").agg(F.collect_set(F.struct("code", "hash", "hash2", "first")).alias("c"))
    with_lines = _with_lines(d.select("k1", "k2", "text").join(lists.hint("shuffle_hash"), ["k1", "k2"])).select("k1", "k2", F.explode("c").alias("c"), "lines")
    texts = with_lines.select("k1", "k2", "c.code", "c.hash", "c.hash2", "c.first", _text_of(F.col("c.code")).alias("chunk"))
    texts = materialize(texts.withColumn("is_first", place == F.col("first")).drop("first"), "texts")
    firsts = texts.filter("is_first").select(*key, F.col("chunk").alias("chunk_first")).dropDuplicates(key)
    removed = texts.filter("not is_first").join(firsts, key).filter(F.col("chunk") == F.col("chunk_first"))
    gone = materialize(removed.groupBy("k1", "k2").agg(F.collect_set("code").alias("gone")), "gone")
    drop_tables(spark, since, gone)
    out = _with_lines(d.join(gone.hint("shuffle_hash"), ["k1", "k2"], "left"))
    # the lines of chunks that are gone, which may overlap
    lost = F.flatten(F.transform("gone", lambda c: F.sequence(_first(c), _first(c) + _count(c) - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), lost)
    text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return out.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(text).alias("text"),
        "lang", "source",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lines") - F.when(F.col("gone").isNotNull(), F.size(kept)), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The columns of documents; texts that lost lines and have none left but blank ones are left out."""
    d = dedup_lines(docs).filter((F.col("n_removed") == 0) | _full(F.col("text")))
    return d.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
