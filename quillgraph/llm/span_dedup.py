"""Substring dedup by sliding sentence spans.

A sentence ends at a stop or clause mark (. ! ? , ; :) followed by a blank, or at
a line's end; parting at clause marks, too, lets a passage hold whole ones. From every
sentence starts a run: the fewest sentences, MIN_SENTENCES at least, that have
MIN_WORDS words; with both_ends, as in the query, such a run also ends at every
sentence, so that a repeated passage's last sentences are covered like its first.
Runs are hashed to 128 bits, two independent hashes that must both agree, and
joined over all documents; at 10^13 runs the odds of any two different ones
agreeing are below 10^-12. Where a run has occurred before, in document, text and
sentence order, all its sentences go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import documents_of, drop_tables, keyed, materialize, ship, tables_so_far
from quillgraph.llm.words import chunks, spread

MIN_SENTENCES = 2
#: Shorter runs repeat by chance, as stock phrases do.
MIN_WORDS = 16
_BREAK = re.compile(r"(?<=[.!?,;:])[ \t\r]++(?:\n\s*+)?|(?<![ \t\r])[ \t\r]*+\n\s*+")
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def sentences_of(text: str) -> tuple[list[str], list[str]]:
    """(sentences, breaks): the text is their interleaving; there is one sentence more than breaks, some may be empty."""
    out, breaks, at = [], [], 0
    for m in _BREAK.finditer(text):
        out.append(text[at : m.start()])
        breaks.append(m[0])
        at = m.end()
    out.append(text[at:])
    return out, breaks


def _hashes(sentences: list[str]) -> np.ndarray:
    """Two 64-bit hashes a sentence."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in sentences), np.uint64).reshape(-1, 2)


def runs_of(sentences: list[str], min_sentences: int, min_words: int, both_ends: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash, second hash) of the run from each sentence, for those that have one; both_ends: and of the run up to each."""
    kept = [i for i, s in enumerate(sentences) if s.strip()]
    if len(kept) < min_sentences:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    words = [sentences[i].split() for i in kept]
    total = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    h = _hashes([" ".join(w) for w in words])
    n = len(kept)
    start = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words), start + min_sentences)
    start, end = start[end <= n], end[end <= n]
    if both_ends:
        last = np.arange(1, n + 1)
        begin = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, last - min_sentences)
        run = np.unique(np.concatenate([start * (n + 1) + end, (begin * (n + 1) + last)[begin >= 0]]))
        start, end = run // (n + 1), run % (n + 1)
    # the hash of a run from sums of hashes times powers
    values = []
    with np.errstate(over="ignore"):
        for base, own in zip(_BASES, h.T, strict=True):
            power, back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
            power[1:], back[1:] = np.uint64(base), np.uint64(pow(base, -1, 2**64))
            power, back = np.cumprod(power), np.cumprod(back)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread(own) * power[:-1])])
            values.append(spread((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)).view(np.int64))
    where = np.array(kept, np.int64)
    return where[start], where[end - 1] - where[start] + 1, *values


def dedup_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, both_ends: bool = False) -> DataFrame:
    """doc_id, text, n_sentences, n_removed, removed (start:end of removed sentences, comma-joined).

    One row per document. First occurrences are in the order of doc_id, text hash
    and sentence. Null and empty texts have no sentences and stay (a null one
    becomes empty). Rows equal in id and text are one document and lose the same
    sentences. Runs that a text repeats itself also go. both_ends: runs that end at
    each sentence count besides those that start there, so that every sentence of a
    repeated run of min_sentences and min_words goes; else those after the last start
    of a run may stay.
    """
    ship(docs.sparkSession)
    d = keyed(documents_of(docs).select("doc_id", "text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            row, start, length, value, second = [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                s, n, h, h2 = runs_of(sentences_of(text.as_py() or "")[0], min_sentences, min_words, both_ends)
                row.append(np.full(len(s), i))
                start.append(s)
                length.append(n)
                value.append(h)
                second.append(h2)
            row = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [b.column("k1").take(row), b.column("k2").take(row), pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(length).astype(np.int32)), pa.array(np.concatenate(value)), pa.array(np.concatenate(second))],
                names=["k1", "k2", "start", "n", "hash", "hash2"],
            )

    spark = docs.sparkSession
    since = tables_so_far(spark)
    runs = materialize(d.select("k1", "k2", "text").mapInArrow(find, "k1 bigint, k2 bigint, start int, n int, hash bigint, hash2 bigint"), "runs")
    # counts and firsts are written, so that a join deals both sides out anew and a frequent run's partition can be split
    twice = materialize(runs.groupBy("hash", "hash2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hash", "hash2"), "twice")
    repeated = materialize(runs.join(twice, ["hash", "hash2"]), "repeated")
    drop_tables(spark, since, repeated)
    place = F.struct("k1", "k2", "start")
    first = materialize(repeated.groupBy("hash", "hash2").agg(F.min(place).alias("first")), "first")
    later = repeated.join(first, ["hash", "hash2"]).filter(place != F.col("first"))
    gone = materialize(later.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("gone")), "gone")
    drop_tables(spark, since, gone)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, count, removed, spans = [], [], [], []
            for text, gone in zip(b.column("text"), b.column("gone"), strict=True):
                text, gone = text.as_py() or "", gone.as_py()
                s, breaks = sentences_of(text)
                full = sum(1 for x in s if x.strip())
                count.append(full)
                if not gone:
                    texts.append(text)
                    removed.append(0)
                    spans.append("")
                    continue
                out = np.zeros(len(s) + 1, np.int64)
                for g in gone:
                    out[g["start"]] += 1
                    out[g["start"] + g["n"]] -= 1
                out = np.cumsum(out)[:-1] > 0
                at = np.concatenate([[0], np.cumsum([len(x) + len(y) for x, y in zip(s, [*breaks, ""], strict=True)])])
                texts.append("".join(x + y for x, y, o in zip(s, [*breaks, ""], out, strict=True) if not o).strip())
                removed.append(sum(1 for x, o in zip(s, out, strict=True) if o and x.strip()))
                spans.append(",".join(f"{at[i]}:{at[i] + len(s[i])}" for i in np.flatnonzero(out) if s[i].strip()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.string())],
                names=["doc_id", "text", "n_sentences", "n_removed", "removed"],
            )

    joined = d.join(gone.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(cut, "doc_id bigint, text string, n_sentences bigint, n_removed bigint, removed string")
