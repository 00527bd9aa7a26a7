"""Best-fit packing of tokenised documents with certified bin counts.

Documents become pieces of at most `capacity` tokens. Pieces are dealt into
partitions of bounded size by a hash; each partition packs its lengths best-fit
decreasing and compares the bin count with lower bounds from dual feasible
functions. Where the count equals the bound, the partition is certified: no
packing of its pieces has fewer sequences. Partitions with a gap give the pieces
of their sequences that are not full to new partitions, which pack them anew; a
new packing is used only where it needs fewer sequences. Rounds go on as long as
they save sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import columns_of, drop_tables, materialize, ship, ship_file, tables_so_far
from quillgraph.llm.words import chunks, word_codes

CAPACITY = 4096
END_ID = 1
#: Pieces of a partition; the memory of a packing task is a few MB for that many.
PARTITION_PIECES = 16_384
#: Entries of a worker's word cache, after which it starts again: some 10 MB.
CACHE_WORDS = 250_000
#: Text tokenised at once; what a step needs for it is about 15 times as large.
CHUNK_BYTES = 2_000_000
#: Stops behind a word's letters that are looked up on their own; longer runs are one word with the letters.
MOST_TAIL = 8
#: Fuller sequences are not given to the exchange.
FULL = 0.995
_TRAILING = ".,!|&%$*#?;:"


class WordTokens:
    """Token ids of white-space separated words, by a `tokenizers` file whose
    pre-tokeniser drops white space, so that a text's ids are its words' ids in a row.

    A word of letters with ASCII punctuation behind it is looked up as two keys.
    All lookups are over a chunk's distinct words, in Arrow.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Known keys, with their ids as lists; the first key is the empty one, without ids."""
        self.known = pa.array([""], pa.large_string())
        self.ids = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.uint32()))

    def _add(self, keys: pa.Array) -> None:
        letters = pc.utf8_is_alpha(keys)
        plain = keys.filter(letters).to_pylist()
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            lines = [" ".join(some[j : j + 400]) for j in range(0, len(some), 400)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                self._put(some, ids, np.diff(cuts, prepend=0))
            else:
                self._one_by_one(some)
        self._one_by_one(keys.filter(pc.invert(letters)).to_pylist())

    def _one_by_one(self, keys: list[str]) -> None:
        for i in range(0, len(keys), 20_000):
            some = keys[i : i + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._put(some, np.array([x for y in ids for x in y], np.uint32), np.array([len(x) for x in ids], np.int64))

    def _put(self, keys: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
        self.known = pa.concat_arrays([self.known, pa.array(keys, pa.large_string())])
        self.ids = pa.concat_arrays([self.ids, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.uint32()))])

    def _keys(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word's head and tail: letters, in lower case where they are ASCII, and up to MOST_TAIL stops behind them; else the word and nothing."""
        head = pc.utf8_rtrim(words, characters=_TRAILING)
        tail = pc.subtract(pc.binary_length(words), pc.binary_length(head)).to_numpy(zero_copy_only=False)
        alpha = pc.utf8_is_alpha(head).to_numpy(zero_copy_only=False) & (tail <= MOST_TAIL)
        ascii_head = alpha & pc.string_is_ascii(head).to_numpy(zero_copy_only=False)
        tail = np.where(alpha, tail, 0)
        key = pc.if_else(pa.array(ascii_head), pc.ascii_lower(head), pc.if_else(pa.array(alpha), head, words))
        order, parts = [np.flatnonzero(tail == 0)], [pa.array([""] * int((tail == 0).sum()), pa.large_string())]
        for n in np.unique(tail[tail > 0]).tolist():
            order.append(np.flatnonzero(tail == n))
            parts.append(pc.utf8_slice_codeunits(words.take(pa.array(order[-1])), -n, 2**31 - 1))
        place = np.empty(len(words), np.int64)
        place[np.concatenate(order)] = np.arange(len(words))
        return key, pa.concat_arrays(parts).take(pa.array(place))

    def of_texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): text i's ids, end_id last, are ids[starts[i]:starts[i+1]]."""
        codes, words, starts = word_codes(texts)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        keys = pa.chunked_array(self._keys(words)).combine_chunks().dictionary_encode()
        distinct = keys.dictionary
        number = pc.index_in(distinct, self.known)
        if number.null_count:
            self._add(distinct.filter(pc.is_null(number)))
            number = pc.index_in(distinct, self.known)
        # a word is two keys' ids in a row; the last list is a text's end
        pairs = keys.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()
        two = self.ids.take(number.take(pa.array(pairs)))
        offsets = np.append(two.offsets.to_numpy()[::2], len(two.flatten()) + 1)
        word_ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([two.flatten(), pa.array([end_id], pa.uint32())]))
        codes = np.insert(codes, starts[1:], len(words))
        ids = word_ids.take(pa.array(codes))
        return ids.flatten().to_numpy(), ids.offsets.to_numpy()[starts + np.arange(len(starts))].astype(np.int64)


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    A document's ids are those of its text (null: none) and then end_id; only
    longer ones are cut, every `capacity` ids. A null doc_id stays null; repeated
    rows are documents of their own.
    """
    ship(docs.sparkSession)
    name = ship_file(docs.sparkSession, tokenizer)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(SparkFiles.get(name))
        for b in chunks(batches, size=CHUNK_BYTES):
            ids, starts = tokens.of_texts(b.column("text"), end_id)
            n = np.diff(starts)
            count = -(-n // capacity)
            row = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            begin = starts[row] + piece * capacity
            end = np.minimum(begin + capacity, starts[row + 1])
            data = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(data[i:j]) for i, j in zip(begin, end, strict=True)]
            out = [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(end - begin, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                flat = np.concatenate([[0], np.cumsum(end - begin)])
                out.append(pa.ListArray.from_arrays(pa.array(flat, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])
            pa.default_memory_pool().release_unused()

    return columns_of(docs, doc_id="bigint", text="string").mapInArrow(pieces, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of three families of dual feasible functions, as a bin count."""
    if not len(lengths):
        return 0
    x = np.sort(np.asarray(lengths, np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    best = -(-int(total[-1]) // capacity)
    # u_k: rounds a length up or down to multiples of 1/k, but for exact ones.
    for k in range(1, 21):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        best = max(best, -(-int(np.where(exact, x * k, scaled // capacity * capacity).sum()) // (k * capacity)))
    # U_e: lengths over capacity - e count whole, those under e not at all.
    for e in np.unique(np.concatenate([x[x <= capacity // 2][:: max(1, len(x) // 512)], [0]])):
        lo, hi = np.searchsorted(x, e), np.searchsorted(x, capacity - e, "right")
        best = max(best, len(x) - int(hi) - (-(int(total[hi] - total[lo])) // capacity) if hi > lo else len(x) - int(hi))
    # phi_e: counts how many lengths of e fit; lengths over a half count as what their complement leaves.
    for e in np.unique(np.linspace(1, capacity // 2, 24).astype(int)):
        fits = capacity // e
        value = np.where(2 * x > capacity, fits - (capacity - x) // e, np.where(2 * x == capacity, fits / 2, np.where(x >= e, 1, 0)))
        best = max(best, int(np.ceil(value.sum() / fits - 1e-9)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins. Ties keep the given order."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, bins = 0, 0  # bit r of `there`: a bin with r tokens left
    for i in order:
        n = int(lengths[i])
        fit = there >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                there ^= 1 << left
        else:
            b, left, bins = bins, capacity, bins + 1
        where[i], offset[i] = b, capacity - left
        if left - n:
            if not open_bins[left - n]:
                there |= 1 << (left - n)
            open_bins[left - n].append(b)
    return where, offset, bins


_PLACED = "uid bigint, length bigint, partition bigint, sequence_id bigint, offset bigint, fill bigint, gap bigint"


def _pack_group(group: int, pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """A partition packed best-fit decreasing; gap is its number of sequences less its lower bound."""
    pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable", ignore_index=True)
    x = pdf["length"].to_numpy()
    where, offset, bins = best_fit_decreasing(x, capacity)
    fill = np.bincount(where, weights=x, minlength=bins)
    return pd.DataFrame({
        "uid": pdf["uid"], "length": x, "partition": group, "sequence_id": group * 2**20 + where, "offset": offset,
        "fill": fill[where].astype(np.int64), "gap": bins - lower_bound(x, capacity),
    })


def _repacking(base: int, capacity: int):
    """Packs a group anew where that needs fewer sequences, else keeps its sequences; its gap is that of what stands."""

    def repack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        new = _pack_group(base + int(key[0]), pdf, capacity)
        had, has = pdf["sequence_id"].nunique(), new["sequence_id"].nunique()
        if has < had:
            return new
        return pdf[["uid", "length", "partition", "sequence_id", "offset", "fill", "gap"]].assign(partition=base + int(key[0]), gap=new["gap"].iloc[0] + had - has)

    return repack


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, sequence_id, offset, partition, partition_gap) for pieces (uid long, length long), 1 <= length <= capacity.

    While partitions have more sequences than their bounds, their sequences that
    are not full are dealt into new partitions and packed best-fit decreasing; a
    new packing stands where it has fewer sequences than its pieces had. The
    rounds end when one saves no sequence, or when as many are left as all tokens
    together need. partition_gap is a partition's sequences less its bound: 0
    certifies that no packing of its pieces has fewer. Empty input gives no rows.
    """
    total = pieces.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).first()
    groups = max(1, -(-total["n"] // PARTITION_PIECES))
    fewest = -(-(total["tokens"] or 0) // capacity)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(int(key[0]), pdf, capacity)

    packed = materialize(pieces.select(F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("g"), "uid", "length").groupBy("g").applyInPandas(pack, _PLACED), "packed")
    first, round_no, before = groups, 0, None
    loose = (F.col("gap") > 0) & (F.col("fill") < int(capacity * FULL))
    while True:
        starts = F.col("offset") == 0  # one row of each sequence
        now = packed.agg(F.count(F.when(starts, 1)).alias("sequences"), F.count(F.when(loose, 1)).alias("loose"), F.count(F.when(loose & starts, 1)).alias("open")).first()
        if now["open"] < 2 or now["sequences"] == fewest or now["sequences"] == before:
            break
        before = now["sequences"]
        again = max(1, -(-now["loose"] // PARTITION_PIECES))
        # a whole sequence goes to one group, so that a group may keep it as it is
        moved = packed.filter(loose).withColumn("g", F.pmod(F.xxhash64("sequence_id", F.lit(round_no)), F.lit(again)))
        packed = materialize(packed.filter(~loose).unionByName(moved.groupBy("g").applyInPandas(_repacking(first, capacity), _PLACED)), "repacked")
        first, round_no = first + again, round_no + 1

    def certify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gap = pdf["sequence_id"].nunique() - lower_bound(pdf["length"].to_numpy(), capacity)
        return pdf[["uid", "sequence_id", "offset", "partition"]].assign(partition_gap=gap)

    return packed.groupBy("partition").applyInPandas(certify, "uid bigint, sequence_id bigint, offset bigint, partition bigint, partition_gap bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs all documents into as few sequences as best-fit with exchange finds.

    docs: doc_id, text. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, partition, partition_gap (see assign_sequences) and, with_ids,
    the ids. Null texts have only the end token; very long ones are cut into
    pieces; repeated rows are packed each.
    """
    spark = docs.sparkSession
    since = tables_so_far(spark)
    pieces = materialize(tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = materialize(assign_sequences(pieces.select("uid", "length"), capacity), "placed")
    drop_tables(spark, since, pieces, placed)
    return pieces.join(placed, "uid").drop("uid")
