"""Words, lines and hashes of whole Arrow batches of text, in numpy.

A batch of texts is one run of UTF-8 bytes with the offset of each text. Everything here works on
such runs, so the cost of a text is a few vector operations a byte, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds, data = column.buffers()[1:]
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    run = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return run, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of about most bytes of text in the named column, one row at least."""
    offsets = texts(batch.column(name))[1]
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0].., starts[1].. of runs of the given lengths, one after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def eights(run: np.ndarray, order: str = "<") -> np.ndarray:
    """A view of the eight bytes from each place on as one number, zeros past the end."""
    padded = np.concatenate([run, np.zeros(8, np.uint8)])
    return np.ndarray((len(run),), f"{order}u8", padded, strides=(1,))


def run_words(run: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each run by eights, the last filled with zeros, and how many eights each run has."""
    n = (lengths + 7) >> 3
    inside = ragged(np.zeros(len(n), np.int64), n) << 3
    out = eights(run)[np.repeat(starts, n) + inside].astype(np.uint64)
    left = np.repeat(lengths, n) - inside
    short = np.flatnonzero(left < 8)
    out[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
    return out, n


def words_hashes(words: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of what run_words() gave. Each eight is scrambled with its place before they are added."""
    if not len(n):
        return np.zeros(0, np.uint64)
    place = ragged(np.ones(len(n), np.int64), n).astype(np.uint64)
    sums = np.add.reduceat(mixed(words ^ mixed(place * STEP)), np.cumsum(n) - n)
    return mixed(sums ^ (lengths.astype(np.uint64) << np.uint64(40)))


def run_hashes(run: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs given; equal runs have equal hashes. No run may be empty."""
    words, n = run_words(run, starts, lengths)
    return words_hashes(words, n, lengths)


def word_spans(run: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word and the number of words before each text (one more than texts)."""
    if not len(run):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[run]
    begins, ends = inside.copy(), np.zeros(len(run) + 1, bool)
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]  # a text's first byte doesn't continue the text before
    begins[edge] = inside[edge]
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of size words that stay in one text, and how many start before each text.

    A text of fewer words, if it has any, gives one hash of all its words.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    starts = ragged(first[:-1], count)
    left = np.repeat(first[1:], count) - starts
    out = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        out = (out + np.where(left > k, padded[starts + k], np.uint64(0))) * STEP
        out ^= out >> np.uint64(31)
    return mixed(out), np.concatenate([[0], np.cumsum(count)])
