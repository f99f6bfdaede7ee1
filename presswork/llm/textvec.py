"""Vectorised text primitives over Arrow string buffers.

Whole chunks of documents are tokenised and hashed with numpy straight on the UTF-8 bytes, so that no Python
object is made for a word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2_000_000
#: Bytes of text of which words are hashed at once; a longer word is a piece of its own.
PIECE_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a word between blanks.
SOLID = ~_SPACE
#: Digits, ASCII letters and all non-ASCII: words of the licence scan (after lower-casing A-Z).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_BASE, _UNBASE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, U64)
        have[0], done, step = 1, 1, base % (1 << 64)
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * U64(step)
            done, step = done + more, step * step % (1 << 64)
        _powers[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value starts (one more offset than values)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may own bytes
        nulls = np.asarray(column.is_null())
        if (np.diff(at)[nulls] > 0).any():
            return buffers(column.fill_null(""))
    return data, at - at[0]


class Chunk:
    """Some rows of a batch with the bytes of their texts; data[at[i]:at[i + 1]] is row i's text."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray):
        self.batch, self.data, self.at, self.n = batch, data, at, len(at) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def strings(self) -> list[str]:
        raw, at = self.data.tobytes(), self.at
        return [raw[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(self.n)]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts batches so that each piece has at most limit bytes of text, or one row."""
    for batch in batches:
        data, at = buffers(batch.column(batch.schema.get_field_index(text)))
        row, n = 0, batch.num_rows
        while row < n:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            end = min(end, n)
            yield Chunk(batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row])
            row = end


class Words:
    """Word w of a chunk covers data[start[w]:end[w]]; row i has words row[i] to row[i + 1]; doc[w] is its row."""

    def __init__(self, chunk: Chunk, table: np.ndarray = SOLID):
        data, at = chunk.data, chunk.at
        solid = table[data]
        cut = at[:-1][np.diff(at) > 0]  # a word ends with its text
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = solid[:-1]
            before[cut] = False
        self.start = np.flatnonzero(solid & ~before)
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = solid[1:]
            after[cut[1:] - 1] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.row = np.searchsorted(self.start, at)
        self.count = np.diff(self.row)
        self.n = len(self.start)
        self.chunk = chunk

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.n), self.count)

    @property
    def place(self) -> np.ndarray:
        """Each word's number within its text."""
        return np.arange(self.n) - np.repeat(self.row[:-1], self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.chunk.data, self.start, self.end, lower)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of data[start[i]:end[i]]; the same bytes give the same hash anywhere. Spans are in order, without overlap.

    Worked off in pieces of about PIECE_BYTES, so that a long text needs little more memory than its own bytes.
    """
    out, i, n = np.empty(len(start), U64), 0, len(start)
    while i < n:
        first = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, first + PIECE_BYTES, "right")))
        out[i:j] = _span_hashes(data[first : int(end[j - 1])], start[i:j] - first, end[i:j] - first, lower)
        i = j
    return out


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.multiply((_LOWER if lower else _BYTES)[data], _power(_BASE, n), out=total[1:])
    np.cumsum(total, out=total)
    return mix((total[end] - total[start]) * _power(_UNBASE, n + 1)[start] + (end - start).astype(U64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive items, by doubling; entry i starts at item i. Rows are not told apart."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    base = 0xD6E8FEB86659FD93
    out, size, have = None, 0, {1: hashes}
    width = 1
    while width * 2 <= n:
        h = have[width]
        have[width * 2] = h[: len(h) - width] * U64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    for width in sorted(have, reverse=True):
        while size + width <= n:
            h = have[width]
            if out is None:
                out = h
            else:
                m = len(hashes) - size - width + 1
                out = out[:m] * U64(pow(base, width, 1 << 64)) + h[size : size + m]
            size += width
    return mix(out[: len(hashes) - n + 1] + U64(n))


def inside(words: Words, n: int) -> np.ndarray:
    """Which of the n-word windows (by first word) lie within one row."""
    m = max(0, words.n - n + 1)
    last = np.repeat(words.row[1:], words.count)[:m]
    return np.arange(m) + n <= last


def batches_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)


def binary_array(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
