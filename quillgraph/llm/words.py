"""Words of whole texts, split and numbered in Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and rows handled at once; a longer text makes a chunk of its own.
CHUNK_BYTES, CHUNK_ROWS = 4_000_000, 8_192


def chunks(batches: Iterator[pa.RecordBatch], *columns: str, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes in the columns (by default text) and at most `rows` rows."""
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            b = whole.slice(i, rows)
            sizes = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns or ("text",))
            part = (np.cumsum(sizes) - sizes) // size
            cuts = np.flatnonzero(np.diff(part)) + 1
            for j, k in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                yield b.slice(j, k - j)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text (null: none).

    Returns (codes, vocabulary, starts): text i's words are codes[starts[i]:starts[i+1]],
    each an index into the vocabulary of distinct words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    coded = flat.dictionary_encode()
    codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py() if len(vocabulary) else -1
    if empty >= 0:
        keep = codes != empty
        kept = np.concatenate([[0], np.cumsum(keep)])
        starts, codes = kept[starts], codes[keep]
        codes -= codes > empty
        vocabulary = pa.concat_arrays([vocabulary.slice(0, empty), vocabulary.slice(empty + 1)])
    return codes, vocabulary, starts


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """word_codes with the codes as 64-bit numbers and the vocabulary as a list."""
    codes, vocabulary, starts = word_codes(texts)
    return codes.astype(np.int64), vocabulary.to_pylist(), starts


def spread(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def row_of(starts: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
