"""Words of many texts at once: places, hashes, and their own text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import flat

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of all texts [off[i], off[i + 1]), in order. Long texts go piece by piece."""
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in flat.runs(off):
        block, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        cuts = flat._cuts(block, gap) if j == i + 1 else [0, len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            s, e, _ = flat.word_spans(block[a:b], at if j > i + 1 else np.array([0, b - a]), gap)
            hashes.append(flat.span_hashes(block[a:b], s, e))
            starts.append(s + off[i] + a)
            ends.append(e + off[i] + a)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between places of ``data``."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    pick = np.repeat(starts - off[:-1], size) + np.arange(off[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[pick].tobytes())).cast(pa.string())
