"""Words of whole Arrow text columns as 64-bit numbers, for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 4 << 20
GIVE_BACK = 32 << 20


def give_back() -> None:
    """Return memory that is free inside this worker process to the machine, where the platform can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text comes alone.

    Workers live on from task to task, and what one stage has used must not stand
    in the way of the next: memory goes back after ``GIVE_BACK`` bytes of text and
    at the end.
    """
    seen = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(begin, end - begin)
            seen += int(total[end - 1] - base)
            begin = end
        if seen >= GIVE_BACK:
            seen = 0
            give_back()
    give_back()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(offsets, words): words between ASCII white space; null text has none.

    Words of text i are ``words[offsets[i]:offsets[i + 1]]``; ``lower`` turns A-Z to a-z.
    """
    texts = pc.fill_null(texts, "")
    listed = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = listed.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    edges = listed.offsets.to_numpy().astype(np.int64) - listed.offsets[0].as_py()
    running = np.concatenate([[0], np.cumsum(filled, dtype=np.int64)])
    return running[edges], flat.filter(pa.array(filled)).dictionary_encode()


def hash_dictionary(words: pa.DictionaryArray) -> np.ndarray:
    """64-bit hash of every word."""
    known = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return known[words.indices.to_numpy()] if len(known) else np.empty(0, np.uint64)


def shingle_hashes(offsets: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, shingles): hashes of ``size`` words in a row within each text.

    A text of fewer words gives its whole sequence as one, a text of none gives none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(offsets[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    left = np.repeat(offsets[1:], counts) - starts  # words from the start to the end of the text
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    out = np.zeros(ends[-1], np.uint64)
    for j in range(size):
        word = padded[starts + j]
        if j:
            word = np.where(left > j, word, np.uint64(j))
        out = mix(out ^ word, j)
    return ends, out
