"""Helpers of the operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa


def row_slices(column: pa.Array, max_bytes: int, max_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """(start, number) of the rows of a text or binary column in slices of about ``max_bytes``; a single longer value makes a slice alone."""
    lengths = np.diff(_offsets(column)) if len(column) else np.zeros(0, np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (held + n > max_bytes or i - start >= max_rows):
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths) - start


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in slices of about ``max_bytes``; null texts are empty. A single longer text makes a slice alone."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for start, n in row_slices(texts, max_bytes, max_rows):
            yield ids[start : start + n], [t or "" for t in texts.slice(start, n).to_pylist()]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers live on from stage to stage."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[starts[i] : starts[i] + lengths[i]]`` for i in ``index``, joined, and their lengths."""
    n = lengths[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[index] - (ends - n), n)], n


def bounds(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums of ``lengths``."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class RaggedStore:
    """Lists of numbers under 0, 1, ..., in arrays that double when full; ``nbytes`` is what they hold."""

    def __init__(self, dtype: type) -> None:
        self.flat, self.edges, self.n = np.zeros(1024, dtype=dtype), np.zeros(256, dtype=np.int64), 0

    @property
    def nbytes(self) -> int:
        return int(self.edges[self.n]) * self.flat.itemsize + 8 * self.n

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.edges[self.n])
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(max(used, len(flat)) + len(flat), dtype=self.flat.dtype)])
        if self.n + len(lengths) >= len(self.edges):
            self.edges = np.concatenate([self.edges[: self.n + 1], np.zeros(max(self.n, len(lengths)) + len(lengths), dtype=np.int64)])
        self.flat[used : used + len(flat)] = flat
        self.edges[self.n + 1 : self.n + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.n += len(lengths)

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``index``, joined, and their lengths."""
        starts = self.edges[index]
        n = self.edges[index + 1] - starts
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(starts - (ends - n), n)], n


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = 64
_AT_PLACE = mixed(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class HashedWords(NamedTuple):
    raw: bytes  # the texts, each with a line feed after it
    start: np.ndarray  # of each word in raw
    end: np.ndarray
    hashes: np.ndarray  # 64-bit, of the word's bytes
    cut: np.ndarray  # number of words before each text, and of all


def _sign_after_letter(flat: np.ndarray) -> np.ndarray:
    """Places of ASCII signs that follow a letter of a-z, A-Z or U+00C0 to U+024F."""
    sign = (flat > 32) & (flat < 127) & ~_WORD_BYTE[flat]
    at = np.flatnonzero(sign[1:] & (_LETTER_BYTE[flat[:-1]] | (flat[:-1] >= 128))) + 1
    last, lead = flat[at - 1], flat[np.maximum(at - 2, 0)]
    pair = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((lead == 0xC9) & (last > 0x8F))
    return at[(last < 128) | pair]


_LETTER_BYTE = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_WORD_BYTE = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])


def hashed_words(texts: list[str], fold: bool, apart: bool = False) -> HashedWords:
    """The words of texts between ASCII blanks. fold: A-Z count as a-z in the hashes; apart: signs after a letter begin a word."""
    parts = [t.encode() for t in texts]
    at = bounds(np.array([len(r) + 1 for r in parts], dtype=np.int64))
    raw = b"\n".join([*parts, b""])
    flat = np.frombuffer(raw, dtype=np.uint8)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if apart and len(start) and len(more := _sign_after_letter(flat)):
        start, end = np.sort(np.r_[start, more], kind="stable"), np.sort(np.r_[end, more], kind="stable")
    if not len(start):
        return HashedWords(raw, start, end, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    low = flat[~blank].astype(np.int32)
    if fold:
        low += 32 * ((low >= 65) & (low <= 90))
    size = end - start
    first = bounds(size)[:-1]
    place = np.arange(len(low), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    low += np.minimum(place, _PLACES - 1) << 8
    values = _AT_PLACE[low]
    if (far := np.flatnonzero(place >= _PLACES - 1)).size:
        values[far] = mixed((place[far].astype(np.uint64) << np.uint64(8)) + (low[far] & 255).astype(np.uint64) + np.uint64(0xD1342543DE82EF95))
    with np.errstate(over="ignore"):
        hashes = mixed(np.add.reduceat(values, first) + size.astype(np.uint64))
    return HashedWords(raw, start, end, hashes, np.searchsorted(start, at))
