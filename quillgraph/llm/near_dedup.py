"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row (a shorter text is one shingle); its weight is
its count in the text times the mean inverse document frequency of its words.
Document frequencies cover all documents, in a fixed number of hash buckets.
Improved consistent weighted sampling draws SAMPLES samples of a text's weighted
shingles; two texts agree in a sample with a probability equal to their weighted
Jaccard similarity. Samples are banded; texts that share a band are candidates.
Candidates are verified by the exact weighted Jaccard similarity of their whole
texts. Verified links join texts into classes.

A band's bucket of up to SMALL_BUCKET texts gives all its pairs. A larger one
gives stars first: each text with a leader drawn at random for the bucket; in
further rounds with new leaders only texts of other classes than the leader's are
held against it. Stars only join classes cheaply: at the end the samples of all
texts of a bucket that are still of different classes are compared, and close
pairs verified, cell by cell, so that the classes are those of all pairs that share a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import documents_of, drop_tables, materialize, ship, tables_so_far
from quillgraph.llm.words import chunks, numbered_words, row_of, spread

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 12, 4
SAMPLES = BANDS * BAND_ROWS
#: Hash buckets of the document-frequency table; its size bounds what is broadcast.
DF_BUCKETS = 1 << 17
SMALL_BUCKET = 8
#: Rounds of stars before the rest of each larger bucket is compared whole.
ROUNDS = 4
#: Pairs whose samples agree less are not read: with 48 samples a pair at 0.8 does so once in 10^9.
LEAST_AGREEMENT = 20
#: Rows of a chunk whose shingles are made at once; their numbers have that many bits in the shingles' keys.
_ROW_BITS = 14
_BLOCK = 32_768
#: Texts a side in a cell of a larger bucket's comparison.
_CELL = 512
_SHINGLE_BITS, _IDF_BITS = 42, 8


def _word_buckets(vocabulary: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have a word of each hash bucket, and how many texts there are."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DF_BUCKETS, np.int64), 0
        for b in chunks(batches):
            codes, vocabulary, starts = numbered_words(b.column("text"))
            n += b.num_rows
            pairs = np.sort(row_of(starts) * max(1, len(vocabulary)) + codes)
            once = pairs[np.concatenate([[True], np.diff(pairs) > 0])] if len(pairs) else pairs
            per_word = np.bincount(once % max(1, len(vocabulary)), minlength=len(vocabulary))
            bucket = (_word_buckets(vocabulary) % np.uint64(DF_BUCKETS)).astype(np.int64)
            total += np.bincount(bucket, weights=per_word, minlength=DF_BUCKETS).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *there], pa.int64()), pa.array([n, *total[there]], pa.int64())], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(DF_BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequencies as shares of the largest possible one."""
    return ((1 + np.log((1 + n) / (1 + df))) / (1 + np.log(1 + n))).astype(np.float32)


def weighted_shingles(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, weights, starts): text i's distinct shingles, ascending, with their weights."""
    codes, vocabulary, starts = numbered_words(texts)
    rows = len(starts) - 1
    if rows > 1 << _ROW_BITS:
        raise ValueError(f"{rows} texts at once; the shingles' keys hold {1 << _ROW_BITS}")
    hashes = _word_buckets(vocabulary)
    weight = idf[(hashes % np.uint64(DF_BUCKETS)).astype(np.int64)] if len(hashes) else np.zeros(0, np.float32)
    n = np.diff(starts)
    k = SHINGLE_WORDS
    with np.errstate(over="ignore"):
        h, w = spread(hashes)[codes] if len(codes) else np.zeros(0, np.uint64), weight[codes].astype(np.float64)
        if len(h) >= k:
            mixed = np.zeros(len(h) - k + 1, np.uint64)
            for d in range(k):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[d : len(h) - k + 1 + d]
            sums = np.concatenate([[0.0], np.cumsum(w)])
            mean = (sums[k:] - sums[:-k]) / k
            row = row_of(starts)[: len(mixed)]
            inside = np.arange(len(mixed)) + k <= starts[row + 1]
            mixed, mean, row = spread(mixed[inside]), mean[inside], row[inside]
        else:
            mixed, mean, row = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            extra, extra_w = np.zeros(len(short), np.uint64), np.zeros(len(short))
            for j, i in enumerate(short):
                x = np.uint64(n[i])
                for c in h[starts[i] : starts[i + 1]]:
                    x = x * np.uint64(0x9E3779B97F4A7C15) + c
                extra[j], extra_w[j] = x, w[starts[i] : starts[i + 1]].mean()
            mixed, mean, row = np.concatenate([mixed, spread(extra)]), np.concatenate([mean, extra_w]), np.concatenate([row, short])
        level = np.clip(np.rint(mean * ((1 << _IDF_BITS) - 1)), 1, (1 << _IDF_BITS) - 1).astype(np.uint64)
        key = (row.astype(np.uint64) << np.uint64(_SHINGLE_BITS + _IDF_BITS)) | ((mixed >> np.uint64(64 - _SHINGLE_BITS)) << np.uint64(_IDF_BITS)) | level
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    shingle = key & np.uint64((1 << _SHINGLE_BITS + _IDF_BITS) - 1)
    return shingle, tf * (shingle & np.uint64((1 << _IDF_BITS) - 1)).astype(np.float64), np.searchsorted(key >> np.uint64(_SHINGLE_BITS + _IDF_BITS), np.arange(rows + 1).astype(np.uint64))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) quantiles: r and 1 / r at 2**12 levels, ln c at 2**16, and an odd multiplier a sample."""

    def gamma(p: np.ndarray) -> np.ndarray:
        x = np.sqrt(2 * p) + p
        for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = p
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), x / 2)
        return x

    r = gamma((np.arange(1 << 12) + 0.5) / (1 << 12))
    c = gamma((np.arange(1 << 16) + 0.5) / (1 << 16))
    with np.errstate(over="ignore"):
        odd = spread(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32), odd


def consistent_samples(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples of each text with shingles, SAMPLES a text; texts without any have zeros."""
    r_table, inverse, c_table, odd = _tables()
    n = np.diff(starts)
    out = np.zeros((len(n), SAMPLES), np.uint64)
    full = np.flatnonzero(n)
    # whole texts, about _BLOCK shingles at once, so that what a step needs stays in the cache
    part = (starts[full] // _BLOCK) if len(full) else full
    for some in np.split(full, np.flatnonzero(np.diff(part)) + 1) if len(full) else []:
        lo, hi = starts[some[0]], starts[some[-1] + 1]
        s, ln_w = shingle[lo:hi], np.log(weight[lo:hi]).astype(np.float32)
        begin, count = starts[some] - lo, n[some]
        with np.errstate(over="ignore"):
            for k in range(SAMPLES):
                z = s * odd[k]
                z ^= z >> np.uint64(29)
                z *= np.uint64(0xBF58476D1CE4E5B9)
                level = (z >> np.uint64(52)).astype(np.intp)
                beta = ((z >> np.uint64(12)) & np.uint64(0xFFFFFF)).astype(np.float32)
                beta *= np.float32(2.0**-24)
                ln_c = c_table[((z >> np.uint64(36)) & np.uint64(0xFFFF)).astype(np.intp)]
                t = ln_w * inverse[level]
                t += beta
                np.floor(t, out=t)
                beta -= t
                beta -= np.float32(1)
                beta *= r_table[level]
                beta += ln_c  # ln a = ln c - r (t - beta + 1)
                least = np.minimum.reduceat(beta, begin)
                at = np.flatnonzero(beta == np.repeat(least, count))
                at = at[np.searchsorted(at, begin)]
                out[some, k] = spread(s[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, digest, samples (32 bits each), bands; texts without words have no bands."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            shingle, weight, starts = weighted_shingles(b.column("text"), held.value)
            samples = consistent_samples(shingle, weight, starts)
            has = np.diff(starts) > 0
            bands = np.zeros((b.num_rows, BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(SAMPLES):
                    bands[:, k // BAND_ROWS] = bands[:, k // BAND_ROWS] * np.uint64(0x9E3779B97F4A7C15) + samples[:, k]
                bands = spread(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            lists = lambda x, w: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * w)]), pa.int32()), pa.array(x[has].ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"), lists((samples & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), SAMPLES), lists(bands, BANDS)],
                names=["doc_id", "digest", "samples", "bands"],
            )

    return docs.select("doc_id", "digest", "text").mapInArrow(sign, "doc_id bigint, digest binary, samples array<int>, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts' weighted Jaccard similarity is at least `similarity`."""
    ship(pairs.sparkSession)
    held = pairs.sparkSession.sparkContext.broadcast(idf)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text_a", "text_b"):
            distinct: dict[bytes, int] = {}
            texts_of = []
            for side in ("a", "b"):
                for d, t in zip(b.column(side).to_pylist(), b.column(f"text_{side}"), strict=True):
                    if d not in distinct:
                        distinct[d] = len(distinct)
                        texts_of.append(t.as_py())
            shingle, weight, starts = weighted_shingles(pa.array(texts_of, pa.string()), held.value)
            sums = np.concatenate([[0.0], np.cumsum(weight)])
            total = sums[starts[1:]] - sums[starts[:-1]]
            value = np.zeros(b.num_rows)
            for j, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)):
                x, y = distinct[x], distinct[y]
                p, q = slice(starts[x], starts[x + 1]), slice(starts[y], starts[y + 1])
                at = np.searchsorted(shingle[q], shingle[p])
                at[at == q.stop - q.start] = 0
                same = shingle[q][at] == shingle[p] if q.stop > q.start else np.zeros(p.stop - p.start, bool)
                common = np.minimum(weight[p][same], weight[q][at[same]]).sum()
                both = total[x] + total[y] - common
                value[j] = common / both if both else 0.0
            keep = pa.array(value >= similarity - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    sides = [texts.select(F.col("digest").alias(s), F.col("text").alias(f"text_{s}")) for s in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b").mapInArrow(hold, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b): the least node of each node's component.

    Every node points to its least neighbour, pointers are followed twice, and
    the links between what they point to are the next round's; a star is one
    node after a round. The tables' files follow the number of links.
    """
    n = max(8, links.count() // 200_000)
    labels = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")).coalesce(n), "point")
        far = point.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        two = point.join(far, "to").select("node", F.col("to2").alias("to"))
        point = materialize(two.join(far, "to").select("node", F.col("to2").alias("to")).coalesce(n), "points")
        if labels is None:
            labels = point.withColumnRenamed("to", "label")
        else:
            step = point.select(F.col("node").alias("label"), "to")
            labels = materialize(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")).coalesce(n), "labels")
        ends = [point.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b")]
        between = links.join(ends[0], "a").join(ends[1], "b").filter("a2 != b2")
        links = materialize(between.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct().coalesce(n), "links")
        if links.isEmpty():
            return labels


def _relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels after more links: only the classes that they join are looked at again."""
    if labels is None:
        return components(found)
    of = labels.select(F.col("node"), F.col("label"))
    j = found.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    pairs = materialize(j.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "label-links")
    joined = components(pairs.filter("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    fresh = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(of, "node", "left_anti").select("node", F.col("node").alias("label"))
    step = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialize(of.unionByName(fresh).join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def links_between_classes(members: DataFrame, samples: DataFrame, texts: DataFrame, labels: DataFrame | None, idf: np.ndarray, similarity: float) -> DataFrame:
    """Verified links (a, b) that join all classes with a close pair in a larger bucket.

    members: bucket, digest, n. In each bucket the texts outside its largest
    class are held against all its texts, in cells of about _CELL by _CELL texts.
    Pairs stay inside their cell, which gives links for its own classes only; a
    pair is held in the first bucket that it shares.
    """
    ship(members.sparkSession)
    broadcast = members.sparkSession.sparkContext.broadcast(idf)
    m = members.filter(F.col("n") > SMALL_BUCKET).select("bucket", "digest")
    if labels is not None:
        m = m.join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    else:
        m = m.withColumn("label", F.col("digest"))
    m = materialize(m, "labelled")
    sizes = m.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.sum("c").alias("all"), F.max("c").alias("c"))
    cells = lambda n: F.ceil(n / F.lit(_CELL)).cast("int")
    sizes = sizes.filter(F.col("all") > F.col("c")).select("bucket", "most", cells(F.col("all") - F.col("c")).alias("ni"), cells(F.col("all")).alias("nj"))
    m = m.join(materialize(sizes, "bucket-classes"), "bucket").withColumn("loose", F.col("label") != F.col("most"))
    at = lambda n: F.pmod(F.xxhash64("bucket", "digest"), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["bucket", "digest", "label", "loose"]
    rows = m.filter("loose").select(*names, F.lit(0).alias("side"), at("ni").alias("i"), every("nj").alias("j"))
    cols = m.select(*names, F.lit(1).alias("side"), every("ni").alias("i"), at("nj").alias("j"))
    held = materialize(rows.unionByName(cols), "cells").join(samples.select("digest", "samples", "bands"), "digest")

    def candidates(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows x and y of close pairs of different classes, their agreement, and the classes' numbers."""
        side, loose = t.column("side").to_numpy(), t.column("loose").to_numpy(zero_copy_only=False)
        s = t.column("samples").combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        number = lambda c: t.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
        label, digest = number("label"), np.array(t.column("digest").to_pylist(), object)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        agree = np.zeros((len(x), len(y)), np.uint8)
        for k in range(SAMPLES):
            agree += s[x, k][:, None] == s[y, k][None, :]
        a, b = np.nonzero((agree >= LEAST_AGREEMENT) & (label[x][:, None] != label[y][None, :]))
        agree, a, b = agree[a, b], x[a], y[b]
        same = bands[a] == bands[b]
        here = bands[a, same.argmax(1)] == t.column("bucket")[0].as_py()
        # two loose texts meet twice
        here &= ~loose[b] | (digest[a] < digest[b]).astype(bool)
        return a[here], b[here], agree[here], label

    def of_interest(t: pa.Table) -> pa.Table:
        x, y, _, _ = candidates(t)
        return t.take(pa.array(np.unique(np.concatenate([x, y])))).combine_chunks()

    def linked(t: pa.Table) -> pa.Table:
        x, y, agree, label = candidates(t)
        # texts a few MB at a time, as long ones need much more while their shingles are made
        parts = [weighted_shingles(c.column("text"), broadcast.value) for c in chunks(t.select(["text"]).to_batches())] or [weighted_shingles(pa.array([], pa.string()), broadcast.value)]
        shingle, weight, n = (np.concatenate(x) for x in zip(*[(s, w, np.diff(st)) for s, w, st in parts], strict=True))
        starts = np.concatenate([[0], np.cumsum(n)])
        total = np.array([weight[a:b].sum() for a, b in zip(starts, starts[1:])])

        def similar(i: int, js: np.ndarray) -> np.ndarray:
            p, w = shingle[starts[i] : starts[i + 1]], weight[starts[i] : starts[i + 1]]
            q = np.concatenate([shingle[starts[j] : starts[j + 1]] for j in js])
            v = np.concatenate([weight[starts[j] : starts[j + 1]] for j in js])
            place = np.minimum(np.searchsorted(p, q), len(p) - 1)
            v = np.where(p[place] == q, np.minimum(v, w[place]), 0.0)
            common = np.add.reduceat(v, np.concatenate([[0], np.cumsum(np.diff(starts)[js])[:-1]]))
            return common / (total[i] + total[js] - common) >= similarity - 1e-9

        a, b = [], []
        label = label.copy()
        order = np.lexsort((-agree.astype(int), x))
        x, y = x[order], y[order]
        for some in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else []:
            i = x[some[0]]
            # the closest first, as a link spares the other texts of its class
            for js in (y[some[:1]], y[some[1:]]):
                js = js[label[js] != label[i]]
                for j in js[similar(i, js)] if len(js) else []:
                    if label[j] != label[i]:
                        a.append(i)
                        b.append(j)
                        label[label == label[j]] = label[i]
        digest = t.column("digest").combine_chunks()
        return pa.table({"a": digest.take(pa.array(a, pa.int64())), "b": digest.take(pa.array(b, pa.int64()))})

    def by_cell(of_cell):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, last = [], None
            for b in batches:
                if not b.num_rows:
                    continue
                key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], 1)
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), b.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    if parts and tuple(key[lo]) != last:
                        yield from of_cell(pa.Table.from_batches(parts)).to_batches()
                        parts = []
                    parts.append(b.slice(lo, hi - lo))
                    last = tuple(key[lo])
            if parts:
                yield from of_cell(pa.Table.from_batches(parts)).to_batches()

        return run

    sorted_cells = lambda d: d.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    # texts travel only to the cells where they have a pair
    close = materialize(sorted_cells(held).mapInArrow(by_cell(of_interest), held.schema), "close")
    found = sorted_cells(close.join(texts, "digest")).mapInArrow(by_cell(linked), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, class_id (least doc_id of the class), class_digest, n_links.

    docs: doc_id, text. One row per document. Equal texts are one class without
    sampling; texts without words, and null texts, have only equal texts for
    their class. n_links counts the links of a text that were used for its class,
    not all texts close to it. A null doc_id is kept and ranks first.
    """
    spark = docs.sparkSession
    since = tables_so_far(spark)
    d = documents_of(docs).select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    idf = inverse_frequencies(*document_frequencies(d))
    signed = materialize(signatures(d, idf), "signatures")
    # equal texts have equal samples: any of them stands for the text
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("samples").alias("samples"), F.first("bands").alias("bands"))
    members = texts.select("digest", F.explode("bands").alias("bucket"))
    # sums by bucket are written, so that a join deals both sides out anew and a large bucket can be split
    buckets = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = materialize(members.join(buckets, "bucket"), "members")
    in_buckets = members.select("digest").distinct()
    samples = materialize(texts.select("digest", "doc_id", "samples", "bands").join(in_buckets, "digest", "left_semi"), "samples")
    # the text of one document of each class
    wanted = samples.select(F.col("doc_id").alias("id2"), F.col("digest").alias("digest2"))
    read = d.join(wanted, (d["digest"] == F.col("digest2")) & d["doc_id"].eqNullSafe(F.col("id2"))).select("digest", "text")
    read = materialize(read.dropDuplicates(["digest"]), "texts")
    two = [samples.select(F.col("digest").alias(s), F.col("samples").alias(f"samples_{s}")) for s in ("a", "b")]
    agree = F.aggregate(F.zip_with("samples_a", "samples_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    links, labels, held = None, None, None
    for round_no in range(ROUNDS):
        m = members
        if labels is not None:
            m = m.join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        else:
            m = m.withColumn("label", F.col("digest"))
        # a bucket's leader differs from round to round
        leader = m.groupBy("bucket").agg(F.min_by(F.struct("digest", "label"), F.xxhash64(F.lit(round_no), "bucket", "digest")).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
        leader = materialize(leader.select("bucket", "lead"), "leaders")
        stars = m.filter(F.col("n") > SMALL_BUCKET).join(leader, "bucket").filter(F.col("label") != F.col("lead.label"))
        pairs = stars.select(F.least("digest", "lead.digest").alias("a"), F.greatest("digest", "lead.digest").alias("b"))
        if round_no == 0:  # small buckets are read whole at once
            small = m.filter(F.col("n") <= SMALL_BUCKET)
            x, y = small.select("bucket", F.col("digest").alias("a")), small.select("bucket", F.col("digest").alias("b"))
            pairs = pairs.unionByName(x.join(y, "bucket").filter("a < b").select("a", "b"))
        pairs = pairs.distinct()
        if held is not None:
            pairs = pairs.join(held, ["a", "b"], "left_anti")
        close = materialize(pairs.join(two[0], "a").join(two[1], "b").withColumn("agree", agree).filter(F.col("agree") >= LEAST_AGREEMENT).select("a", "b"), "pairs")
        if close.isEmpty():
            break
        held = close if held is None else held.unionByName(close)
        found = materialize(verified(close, read, idf, similarity), "found")
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = _relabelled(labels, found)
    # what no leader has joined: the texts of other classes in each larger bucket, all of them
    found = materialize(links_between_classes(members, samples, read, labels, idf, similarity), "found")
    if not found.isEmpty():
        links = found if links is None else links.unionByName(found)
        labels = _relabelled(labels, found)
    base = signed.select("doc_id", "digest")
    if links is None:
        out = base.withColumn("class_digest", F.col("digest")).withColumn("n_links", F.lit(0).cast("bigint"))
    else:
        ends = links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_links"))
        # written, so that the join deals both sides out anew and a text with very many copies can be split
        named = materialize(labels.select(F.col("node").alias("digest"), F.col("label").alias("class_digest")).join(ends, "digest", "left"), "named")
        out = base.join(named, "digest", "left").select("doc_id", "digest", F.coalesce("class_digest", "digest").alias("class_digest"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out = materialize(out, "classes")
    least = materialize(out.groupBy("class_digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "class-sizes")
    drop_tables(spark, since, out, least)
    return out.join(least, "class_digest").select("doc_id", "digest", "class_id", "class_digest", "class_size", "n_links")


def one_of_each_class(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents, one of each class: that of the least doc_id, among rows equal in it the first."""
    rows = documents_of(docs)
    d = rows.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    c = near_classes(rows, similarity)
    # rows of one class with its least id: mostly one; those equal in id have one digest or more
    first = c.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_digest", "class_id").agg(F.min("digest").alias("digest"))
    keep = first.select(F.col("class_id").alias("id2"), F.col("digest").alias("digest2"))
    one = d.join(keep, (F.col("digest") == F.col("digest2")) & F.col("doc_id").eqNullSafe(F.col("id2"))).drop("id2", "digest2")
    w = Window.partitionBy("doc_id", "digest").orderBy("source", "lang", "n_chars")
    return one.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*rows.columns)
