"""Array kernels used inside tasks: text buffers, hashes, shingles, groups of a sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about this many bytes, so that temporaries stay small.
PIECE_BYTES = 1 << 20
#: Bytes whose words are hashed at a time.
CHUNK_BYTES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x2545F4914F6CDD1D
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64; kept between calls."""
    if len(_POWERS.get("up", ())) <= n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of [start, end) from the running sums of ``rolling_sums``."""
    _, down = powers(int(len(sums)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def rolling_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of value times base^position, from which any range's hash follows."""
    up, _ = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return sums


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word shingles (A-Z lower-cased, words between blanks) and each text's bounds in them.

    A text with fewer words than ``size``, but some, has one shingle of them all.
    Words are hashed ``CHUNK_BYTES`` at a time, so that a very long text needs
    little more memory than its own bytes and a number per word.
    """
    n = len(offsets) - 1
    word = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends[:-1] &= ~word[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del word, cut, begins, ends
    bounds = np.searchsorted(start, offsets)
    hashes, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, side="right")))
        sums = rolling_sums(_LOWER[raw[start[at] : end[to - 1]]])
        hashes[at:to] = range_hash(sums, start[at:to] - start[at], end[at:to] - start[at])
        at = to
    counts = np.diff(bounds)
    total = len(hashes)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    made = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(made)])
    index = np.arange(out_at[-1]) - np.repeat(out_at[:-1], made) + np.repeat(bounds[:-1], made)
    width = np.repeat(np.minimum(counts, size), made)
    out = width.astype(np.uint64)
    for k in range(size):
        part = hashes[np.minimum(index + k, total - 1)]
        out = np.where(width > k, mix(out * _ODD + part), out)
    return out, out_at


def stream_blocks(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of a stream sorted by ``key``, cut only where the key changes."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        # Where a block may end: before each change of the key, the stream's last key being carried.
        first = held[-1].column(key)[-1].as_py() if held else values[0]
        change = np.flatnonzero(np.concatenate([[values[0] != first], values[1:] != values[:-1]]))
        done = 0
        for at in change:
            if size + at - done >= rows and (size or at > done):
                if at > done:
                    held.append(table.slice(done, at - done))
                yield pa.concat_tables(held)
                held, size, done = [], 0, at
        held.append(table.slice(done))
        size += table.num_rows - done
    if held:
        yield pa.concat_tables(held)


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys of a sorted stream, one table per group."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        ends = np.append(starts[1:], table.num_rows)
        for a, b in zip(starts, ends, strict=True):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)
