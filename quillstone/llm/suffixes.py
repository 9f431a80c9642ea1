"""Repeated-substring removal by a depth-limited most-significant-digit sort of suffixes.

A byte goes if a string of ``threshold`` bytes that covers it also starts earlier (smaller id, or same id and earlier
start). Suffixes are ordered only through their first ``threshold`` bytes, in passes over ever finer digits; within a
group of equal digits the least (id, start) is the string's first place and all others repeat it.

Pass 1 carries synchronising suffixes only: in each window of ``threshold`` bytes the half-length string with the least hash.
    Equal windows choose the same one, so every repeat meets here; a random text has one in threshold / 4 positions or so, which
    keeps the shuffle smaller than the text. The windows through such a place start at 0 to threshold / 2 bytes before it.
A pass takes a range of these starts at a time. Its digit is what all windows of the range have in common, its finer digit
    all bytes that they touch. If the digit occurs once, none of the windows repeats. All but the first of a group of equal finer
    digits are settled: all their windows start earlier. The first ones of a group of several finer digits go on to the
    next pass with shorter ranges: all starts, then sqrt of them, then each alone.

Digits are compared as 128 bits of hash. Each Python batch keeps only its first place of a finer digit under the digit's key
and sends the others on by their row, so a hot string costs its partition one row a batch.

Edge cases: null text is empty; a text shorter than the threshold stays whole; ids that are null or repeated are replaced
by the order of (id, text), see store.keyed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .flat import U
from .store import cut, keyed, mapped, small

THRESHOLD = 100


def _settle(key: list[np.ndarray], uid, at, rest_: list[np.ndarray]):
    """Of rows of equal keys in this batch all but the first get at = -1 - at and a first key of their own row."""
    one = key[0].copy()
    for k in key[1:]:
        one = one * U(0x9E3779B97F4A7C15) ^ k
    order = np.lexsort((at, uid)) if len(uid) and (np.diff(uid) < 0).any() else np.arange(len(uid))
    order = order[np.argsort(one[order], kind="stable")]
    again = np.ones(max(len(order) - 1, 0), bool)
    for k in key:
        again &= k[order[1:]] == k[order[:-1]]
    rest = order[1:][again]
    at, first = at.copy(), key[0].copy()
    at[rest] = -1 - at[rest]
    first[rest] = flat.mix(uid[rest].view(np.uint64) + (-1 - at[rest]).view(np.uint64))
    return [first, *key[1:], uid, at, *rest_]


def _batch(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    """``parts`` hold the columns ``names``, keys up to uid."""
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64 if i < names.index("uid") else np.int64) for i in range(len(names))]
    n = names.index("uid")
    cols = _settle(cols[:n], cols[n], cols[n + 1], cols[n + 2 :])
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names)


def _pieces(data, off, thr):
    """(bytes, starts, ends, least window start, end of window starts, base, row range): rows in blocks, long rows in parts."""
    for i, j in flat.runs(off):
        a, b = int(off[i]), int(off[j])
        if b - a <= 2 * flat.BLOCK_BYTES or j > i + 1:
            o = off[i : j + 1] - a
            yield data[a:b], o[:-1], o[1:], o[:-1], o[1:] - thr + 1, o[:-1], i
            continue
        n = b - a
        for c0 in range(0, n - thr + 1, flat.BLOCK_BYTES):
            c1 = min(c0 + flat.BLOCK_BYTES, n - thr + 1)
            a0, a1 = max(0, c0 - thr), min(n, c1 + 2 * thr)
            one = np.array
            yield data[a + a0 : a + a1], one([0]), one([n - a0]), one([c0 - a0]), one([c1 - a0]), one([-a0]), i


def anchors(data: np.ndarray, off: np.ndarray, uid: np.ndarray, thr: int) -> Iterator[tuple]:
    """(h, u, uid, at) of the synchronising suffixes of each row: digit, finer digit, place. Each place comes once."""
    k = thr // 2
    width = thr - k + 1
    last = (-1, -1)  # row and place that came last: windows on both sides of the end of a part may choose the same
    for part, begin, end, w0, w1, base, row in _pieces(data, off, thr):
        n, ok = len(part), w1 > w0
        if n < thr or not ok.any():
            continue
        c, (_, down) = flat.prefix(part, 0), flat.powers(0, n)
        digit = flat.mix((c[k:] - c[:-k]) * down[: n - k + 1])
        rank = (digit >> U(32)).astype(np.uint32) | np.uint32(1)
        least = flat.slide(np.minimum, rank, width)
        step = np.zeros(len(least) + 1, np.int8)
        np.add.at(step, w0[ok], 1)
        np.add.at(step, w1[ok], -1)
        least[np.cumsum(step[:-1], dtype=np.int8) <= 0] = 0
        pad = np.zeros(width - 1, np.uint32)
        at = np.flatnonzero(flat.slide(np.maximum, np.concatenate([pad, least, pad]), width) == rank)
        if row == last[0]:  # a later window chooses no place before those of earlier windows that they don't choose as well
            at = at[at - base[0] > last[1]]
        if not len(at):
            continue
        doc = np.searchsorted(begin, at, "right") - 1
        lo, hi = np.maximum(begin[doc], at - (thr - k)), np.minimum(at, end[doc] - thr)
        c2, (_, down2) = flat.prefix(part, 1), flat.powers(1, n)
        g = (c2[hi + thr] - c2[lo]) * down2[lo] + flat.mix(((at - lo) * (2 * thr) + hi - lo).astype(np.uint64))
        last = (row + int(doc[-1]), int(at[-1] - base[doc[-1]]))
        yield digit[at], flat.mix(g), uid[row + doc], at - base[doc]


def _anchor_batches(thr: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat.flatten(flat.column(b, "text"))
            uid = flat.column(b, "uid").to_numpy(zero_copy_only=False).astype(np.int64)
            yield _batch(list(anchors(data, off, uid, thr)), ["h", "u", "uid", "at"])

    return run


def _cells(first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [first, last] cut into ranges of ``size``: (which, its first, its last)."""
    many = (last - first) // size + 1
    which = np.repeat(np.arange(len(first)), many)
    a = first[which] + size * (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many))
    return which, a, np.minimum(a + size - 1, last[which])


def _range_batches(thr: int, size: int):
    """From (uid, text, open: the (h, at, cell) to look at) to the shorter ranges with a valid window."""
    names = ["h", "g", "u", "uid", "at", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat.flatten(flat.column(b, "text"))
            uids, lists = flat.column(b, "uid").to_pylist(), flat.column(b, "open")
            parts, rows = [], 0
            for i, uid in enumerate(uids):
                h, at, cell = (lists[i].values.field(x).to_numpy(zero_copy_only=False) for x in ("h", "at", "cell"))
                n = int(off[i + 1] - off[i])
                order = np.argsort(at, kind="stable")
                h, at, cell = h[order], at[order], cell[order]
                j = 0
                while j < len(at):  # places near each other share their prefix sums
                    z = int(np.searchsorted(at, at[j] + flat.BLOCK_BYTES, "right"))
                    p, hh = at[j:z], h[j:z]
                    base, stop = max(0, int(p[0]) - thr), min(n, int(p[-1]) + 2 * thr)
                    part = data[off[i] + base : off[i] + stop]
                    c, (_, down) = flat.prefix(part, 1), flat.powers(1, len(part))

                    def digit(s, e, c=c, down=down, base=base):
                        return (c[e - base] - c[s - base]) * down[s - base]

                    which, a, z_ = _cells(cell[j:z] >> 16, cell[j:z] & 0xFFFF, size)
                    q = p[which]
                    low, high = np.maximum(a, q - np.minimum(q, n - thr)), np.minimum(z_, q)  # valid starts are 0 to n - thr
                    ok = low <= high
                    which, a, z_, q, low, high = (x[ok] for x in (which, a, z_, q, low, high))
                    code = (a << 16 | z_).astype(np.uint64)
                    g = flat.mix(digit(q - a, q - z_ + thr) + flat.mix(code))
                    u = flat.mix(digit(q - high, q - low + thr) + flat.mix(code << U(32) | (low << 16 | high).astype(np.uint64)))
                    parts.append((hh[which].view(np.uint64), g, u, np.full(len(q), uid, np.int64), q, code.astype(np.int64)))
                    rows += len(q)
                    j = z
                if rows > 1_000_000:
                    yield _batch(parts, names)
                    parts, rows = [], 0
            if parts:
                yield _batch(parts, names)

    return run


def covered(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the ranges [lo, hi)."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    gap = np.flatnonzero(lo[1:] > hi[:-1])
    return list(zip(lo[np.r_[0, gap + 1]].tolist(), hi[np.r_[gap, len(hi) - 1]].tolist(), strict=True))


def _cut_batches(thr: int):
    """From (uid, text, ranges: settled window starts, both ends in) to one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat.flatten(flat.column(b, "text"))
            ranges = flat.column(b, "ranges")
            out = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for i in range(len(b)):
                text = data[off[i] : off[i + 1]]
                n, spans = len(text), []
                if ranges[i].is_valid and n >= thr:
                    lo, hi = (ranges[i].values.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "hi"))
                    spans = covered(np.maximum(lo, 0), np.minimum(hi, n - thr) + thr)
                if spans:
                    keep, at = [], 0
                    for s, e in spans:
                        keep.append(text[at:s])
                        at = e
                    text = np.concatenate([*keep, text[at:]])
                raw = text.tobytes()
                out["n_bytes"].append(n)
                out["n_removed"].append(n - len(raw))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["spans"].append([{"start": s, "end": e} for s, e in spans])
                out["kept"].append(raw)
            types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([flat.column(b, "uid"), *(pa.array(out[x], t) for x, t in types.items())], ["uid", *types])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, texts: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans and, if ``texts``, the bytes kept."""
    if not 4 <= threshold <= 256:
        raise ValueError("threshold must be 4 to 256 bytes: windows are told apart by hashes that longer ones can defeat")
    rows, plain = keyed(docs, id_col, text_col)
    body = rows.select("uid", "text")
    span = threshold - threshold // 2  # window starts before a synchronising place, besides the one at it

    def graded(rows_: DataFrame, key: list[str], name: str) -> DataFrame:
        place = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
        all_ = Window.partitionBy(*key)
        out = rows_.repartition(*key).withColumn("nth", F.rank().over(Window.partitionBy(*key, "u").orderBy("uid", "at")))
        out = out.withColumn("several", F.min("u").over(all_) != F.max("u").over(all_)).withColumn("settled", (F.col("at") < 0) | (F.col("nth") > 1))
        return cut(out.where("settled or several").select("h", "uid", place.alias("at"), "cell", "settled"), name)

    whole = F.lit(span).cast("bigint").alias("cell")  # starts 0 to span before the place
    passes = [graded(mapped(body, _anchor_batches(threshold), "h long, u long, uid long, at long").select("*", whole), ["h"], "pass1")]
    for size in (math.isqrt(span + 1), 1):
        waiting = passes[-1].where("not settled").groupBy("uid").agg(F.collect_list(F.struct("h", "at", "cell")).alias("open"))
        waiting = cut(waiting, "open")
        finer = mapped(body.join(small(waiting), "uid").select("uid", "text", "open"), _range_batches(threshold, size), "h long, g long, u long, uid long, at long, cell long")
        passes.append(graded(finer, ["h", "g"], f"pass{len(passes) + 1}"))
    marks = functools.reduce(DataFrame.unionByName, (p.where("settled").select("uid", "at", "cell") for p in passes))
    first, last = F.shiftright("cell", 16), F.col("cell").bitwiseAND(F.lit(0xFFFF))
    places = marks.groupBy("uid").agg(F.collect_list(F.struct((F.col("at") - last).alias("lo"), (F.col("at") - first).alias("hi"))).alias("ranges"))
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary"
    out = mapped(body.join(places, "uid", "left").select("uid", "text", "ranges"), _cut_batches(threshold), f"uid long, {fields}")
    if not texts:
        out = out.drop("kept")
    if not plain:
        out = out.join(rows.select("uid", "id"), "uid").drop("uid").withColumnRenamed("id", "uid")
    return out.withColumnRenamed("uid", id_col).select(id_col, *[c for c in out.columns if c not in ("uid", "id")])
