"""Numpy kernels on the flat bytes of an Arrow batch: rolling hashes, words, shingles.

A window's hash, of the bytes [s, e), is sum(T[b_j] * B**(j - s)) modulo 2**64 with random 64-bit T and odd B, so that it
follows from prefix sums for any s, e; mix() then spreads it over all bits. Such sums have known colliding strings of a thousand bytes
and more, so they serve short windows only. A word's hash is the sum of a random 64-bit number for each byte at each place, words of more
than LONG bytes are hashed by blake2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18  # a kernel holds some ten arrays of eight bytes for each
_rng = np.random.Generator(np.random.PCG64(20240501))
TABLES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = [int(x) * 8 + 5 for x in _rng.integers(2**40, 2**60, 2)]
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LONG = 64
PLACED = _rng.integers(0, 2**64, (2, LONG, 256), dtype=np.uint64)
PLACED_LOWER = PLACED[:, :, _LOWER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
U = np.uint64


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**j and B**-j modulo 2**64 for j = 0..n."""
    if which not in _powers or len(_powers[which][0]) <= n:
        m = max(n + 1, BLOCK_BYTES + 65536)
        made = []
        for b in (BASES[which], pow(BASES[which], -1, 2**64)):
            x = np.full(m, b % 2**64, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if m > 4 * BLOCK_BYTES:
            return made[0], made[1]
        _powers[which] = (made[0], made[1])
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums C with hash [s, e) = (C[e] - C[s]) * B**-s."""
    up, _ = powers(which, len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLES[which][data] * up[: len(data)], out=out[1:])
    return out


def placed(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums C with C[e] - C[s] for the first e - s bytes, LONG at most, of the word that starts at s."""
    place = np.zeros(len(data), np.int32)
    place[starts] = starts
    place = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(place)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table.ravel()[(np.minimum(place, LONG - 1) << 8) | data], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words [starts, ends), which are in order and apart; A-Z lower-cased with ``lower``."""
    c = placed(data, starts, (PLACED_LOWER if lower else PLACED)[which])
    size = ends - starts
    h = c[ends] - c[starts]
    for i in np.flatnonzero(size > LONG).tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(raw.lower() if lower else raw, digest_size=8, salt=bytes([which])).digest(), "little")
    return mix(h + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))


def slide(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over each run of ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        a, span = op(a[:-span], a[span:]), span * 2
    return op(a[: -(width - span)], a[width - span :]) if span < width else a


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def flatten(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    n = len(col)
    if not n or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``limit`` bytes together; a longer row is alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (maximal runs free of ``space`` and of row ends) and n + 1 offsets into them by row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = space[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= gap[:-1]
    after[:-1] |= gap[1:]
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, A-Z lower-cased; offsets by row; starts. Long rows go piece by piece."""
    if len(data) > 2 * BLOCK_BYTES and len(off) == 2:
        cuts = _cuts(data, space)
        parts = [_hashes(data[a:b], np.array([0, b - a]), space) for a, b in zip(cuts, cuts[1:], strict=False)]
        h = np.concatenate([p[0] for p in parts])
        return h, np.array([0, len(h)]), np.concatenate([p[2] + a for p, a in zip(parts, cuts, strict=False)])
    return _hashes(data, off, space)


def _cuts(data: np.ndarray, space: np.ndarray) -> list[int]:
    """Ends of pieces of a long row that don't part a word."""
    cuts, at = [0], 0
    while at < len(data):
        at = min(at + BLOCK_BYTES, len(data))
        while at < len(data) and not space[data[at]]:
            more = np.flatnonzero(space[data[at : at + BLOCK_BYTES]])
            at = min(at + (int(more[0]) if len(more) else BLOCK_BYTES), len(data))
        cuts.append(at)
    return cuts


def _hashes(data, off, space):
    starts, ends, woff = word_spans(data, off, space)
    return span_hashes(data, starts, ends, 0, True), woff, starts


def stem_hashes(data: np.ndarray, off: np.ndarray, sizes: tuple[int, ...], space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of each row and of the first ``sizes`` bytes of those that are longer; not by position."""
    if len(data) > 2 * BLOCK_BYTES and len(off) == 2:
        cuts = _cuts(data, space)
        parts = [_stems(data[a:b], np.array([0, b - a]), sizes, space) for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return _stems(data, off, sizes, space)


def _stems(data, off, sizes, space):
    starts, ends, woff = word_spans(data, off, space)
    row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    c = placed(data, starts, PLACED_LOWER[0])
    hashes, rows = [span_hashes(data, starts, ends, 0, True)], [row]
    for size in sizes:
        longer = np.flatnonzero(ends - starts > size)
        s = starts[longer]
        hashes.append(mix(c[s + size] - c[s] + U((0x9E3779B97F4A7C15 * (size + 1)) % 2**64)))
        rows.append(row[longer])
    return np.concatenate(hashes), np.concatenate(rows)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * U(0xD1342543DE82EF95) + words[j : j + n]
    return mix(out + U(k))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words the whole sequence as one."""
    words, woff, _ = word_hashes(data, off)
    all_grams = grams(words, k)
    for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(all_grams[a : b - k + 1])
        else:
            yield grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)
