"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Running Karp-Rabin hashes of ``seed`` words of the documents
are joined with those of the benchmark items; seeds in a row on one diagonal are a match. For each document and item the longest
match with unmarked words is marked again and again, whole or as what is left of it, down to ``seed`` words; marks never overlap in
either text. Coverage is the share of the item's words under marks, whatever their order, so reordered passages count.

The benchmark is the query set: it is cut into blocks of at most BLOCK_BYTES of text by hash of its row, each shipped to every
task in turn. Documents go through once per block, whole. With one block nothing about them leaves their task but the verdict; with more
their rows are numbered and written first, and the verdicts on a row meet by its number.

Edge cases: null and empty texts match nothing; a very long text goes through whole; a seed that repeats in a document and in an item meets each of its places, which
for texts that repeat themselves are never listed but searched by length, with equal marks; other columns aren't read; an empty table of documents gives an empty result; an item of fewer than ``seed`` words can't match; ids that repeat are
judged row by row, and repeated item ids each on their own text; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import flat
from .store import cut, mapped, named

SEED = 5
COVERAGE = 0.5
BLOCK_BYTES = 4 << 20
BITS = 22
PAIRS = 1 << 18  # places of a document and items that are listed at once; beyond that matches are searched for by length
BETWEEN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and n + 1 offsets."""
    data, off = flat.flatten(pc.utf8_lower(pc.fill_null(col, "")))
    hashes, ends = [], [np.zeros(1, np.int64)]
    for i, j in flat.runs(off):
        h, at, _ = flat.word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], BETWEEN)
        hashes.append(h)
        ends.append(at[1:] + ends[-1][-1])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(ends)


class Items:
    """Seeds of a block of benchmark items."""

    def __init__(self, ids: list[int | None], texts: list[str | None], seed: int):
        self.seed, self.ids = seed, ids
        self.words, self.off = _words(pa.array(texts, pa.string()))
        g = flat.grams(self.words, seed)
        item = np.repeat(np.arange(len(ids)), np.diff(self.off))
        ok = np.flatnonzero(item[: len(g)] == item[seed - 1 : seed - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
        order = np.argsort(g[ok], kind="stable")
        self.keys, self.place = g[ok][order], ok[order]
        self.item = item
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.keys >> flat.U(64 - BITS)).astype(np.int64)] = True

    def tile(self, words: np.ndarray, at: np.ndarray, place: np.ndarray, item: int) -> int:
        """Words of the item under marks, from seeds at word ``at`` of the document and ``place`` of the items."""
        diagonal = at - place
        order = np.lexsort((at, diagonal))
        at, place, diagonal = at[order], place[order], diagonal[order]
        new = np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at))) + self.seed - 1
        heap = [(-n, x, y) for n, x, y in zip(size.tolist(), at[first].tolist(), place[first].tolist(), strict=True)]
        heapq.heapify(heap)
        marked_doc, marked_item, total = set(), set(), 0
        while heap:
            n, x, y = heapq.heappop(heap)
            n = -n
            free = [x + j not in marked_doc and y + j not in marked_item for j in range(n)]
            if all(free):
                if np.array_equal(words[x : x + n], self.words[y : y + n]):
                    marked_doc.update(range(x, x + n))
                    marked_item.update(range(y, y + n))
                    total += n
                continue
            j = 0
            while j < n:  # what is left goes back
                k = j
                while k < n and free[k]:
                    k += 1
                if k - j >= self.seed:
                    heapq.heappush(heap, (j - k, x + j, y + j))
                j = k + 1
        return total

    def longest_first(self, words: np.ndarray, item: int) -> int:
        """As tile(), in memory that grows with the texts and not with the places at which they agree: the greatest length of a common window without marks is
        found by bisection over Karp-Rabin hashes; windows of that length are marked in order, then those of the next."""
        own = self.words[self.off[item] : self.off[item + 1]]
        up, down = flat.powers(0, max(len(words), len(own)) + 1)
        texts = []
        for w in (words, own):
            g = flat.grams(w, self.seed)
            texts.append([np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * up[: len(g)])]), np.zeros(len(w), bool)])

        def windows(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
            """Places and hashes of the windows of ``size`` words without a mark."""
            sums, marked = texts[which]
            k, n = size - self.seed + 1, len(marked) - size + 1
            before = np.concatenate([[0], np.cumsum(marked)])
            at = np.flatnonzero(before[size:] == before[:n])
            return at, flat.mix((sums[at + k] - sums[at]) * down[at])

        def longest_free(marked: np.ndarray) -> int:
            edges = np.flatnonzero(np.concatenate([[True], marked, [True]]))
            return int(np.diff(edges).max()) - 1

        total, top = 0, min(len(words), len(own))
        while True:
            low, high = self.seed - 1, min(top, *(longest_free(t[1]) for t in texts))
            while low < high:  # common windows of some length hold ones of any lesser length
                size = (low + high + 1) // 2
                found = np.isin(windows(0, size)[1], windows(1, size)[1]).any()
                low, high = (size, high) if found else (low, size - 1)
            if low < self.seed:
                return total
            (x, hx), (y, hy) = windows(0, low), windows(1, low)
            order = np.argsort(hy, kind="stable")
            y, hy = y[order], hy[order]
            group = np.searchsorted(hy, hx)
            near = np.flatnonzero(hy[np.minimum(group, len(hy) - 1)] == hx)
            x, group = x[near], group[near]  # the first place of the item with that hash
            last = np.searchsorted(hy, hy[group], "right")
            alive, at = np.ones(len(y), bool), 0
            while at < len(x):
                left = np.concatenate([[0], np.cumsum(alive)])
                more = np.flatnonzero(left[last[at:]] > left[group[at:]])
                if not len(more):
                    break
                at += int(more[0])
                pick = group[at] + int(np.flatnonzero(alive[group[at] : last[at]])[0])
                a, c = int(x[at]), int(y[pick])
                if np.array_equal(words[a : a + low], own[c : c + low]):
                    texts[0][1][a : a + low] = texts[1][1][c : c + low] = True
                    total += low
                    alive &= (y <= c - low) | (y >= c + low)
                    at = int(np.searchsorted(x, a + low))
                else:
                    alive[pick] = False
            top = low - 1

    def coverage(self, words: np.ndarray) -> dict[int, float]:
        """Coverage of each item that shares a seed with the document."""
        g = flat.grams(words, self.seed)
        at = np.flatnonzero(self.bits[(g >> flat.U(64 - BITS)).astype(np.int64)])
        if not len(at):
            return {}
        lo, hi = np.searchsorted(self.keys, g[at], "left"), np.searchsorted(self.keys, g[at], "right")
        many = hi - lo
        if int(many.sum()) > PAIRS:
            lo, first = np.unique(lo[many > 0], return_index=True)
            hi = hi[many > 0][first]
            here = np.zeros(len(self.keys) + 1, np.int64)
            here[lo] += 1
            here[hi] -= 1
            items = np.unique(self.item[self.place[np.cumsum(here[:-1]) > 0]])
            return {i: self.longest_first(words, i) / int(self.off[i + 1] - self.off[i]) for i in items.tolist()}
        at = np.repeat(at, many)
        if not len(at):
            return {}
        place = self.place[np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        item = self.item[place]
        out = {}
        for i in np.unique(item).tolist():
            own = item == i
            out[i] = self.tile(words, at[own], place[own], i) / int(self.off[i + 1] - self.off[i])
        return out


def _judge(shipped, seed: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shipped.value, seed)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))
        for b in batches:
            col = flat.column(b, "text")
            _, off = flat.flatten(col)
            for i, j in flat.runs(off):
                words, at = _words(col.slice(i, j - i))
                g = flat.grams(words, seed)  # of the whole block first: most documents share no seed
                near = np.flatnonzero(items.bits[(g >> flat.U(64 - BITS)).astype(np.int64)])
                rows = set((np.searchsorted(at, near, "right") - 1).tolist())
                found = [[] for _ in range(j - i)]
                for r in rows:
                    c = items.coverage(words[at[r] : at[r + 1]])
                    found[r] = [{"item_id": items.ids[x], "coverage": y} for x, y in c.items() if y >= least]
                yield pa.RecordBatch.from_arrays([flat.column(b, "id").slice(i, j - i), pa.array(found, kind), flat.column(b, "kept_row").slice(i, j - i)], ["id", "found", "kept_row"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[int, Iterator[tuple[list, list]]]:
    """How many blocks there are, and those that hold an item."""
    rows = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1

    def blocks():
        for part in range(n):
            got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == part).orderBy("i", "t").collect()
            if got:
                yield [r.i for r in got], [r.t for r in got]

    return n, blocks()


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", seed: int = SEED, least: float = COVERAGE, carry: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, contaminated, n_items, item_id and coverage of the best covered item (least id on ties), found
    (all items covered by ``least`` or more). ``carry``: columns of docs to keep."""
    spark = docs.sparkSession
    now = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.struct(F.monotonically_increasing_id().alias("n"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("kept_row"))
    kind = "array<struct<item_id: long, coverage: double>>"
    found_type = ArrayType(StructType([StructField("item_id", LongType()), StructField("coverage", DoubleType())]))
    out, (n, blocks) = None, _blocks(benchmark, item_col, "text")
    if n > 1:  # the rows of several blocks of items meet again by their number, so it is written
        now = cut(now, "rows")
    for ids, texts in blocks:
        shipped = spark.sparkContext.broadcast((ids, texts))
        schema = StructType([StructField("id", LongType()), StructField("found", found_type), StructField("kept_row", now.schema["kept_row"].dataType)])
        part = mapped(now, _judge(shipped, seed, least), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = now.select("id", F.expr(f"cast(array() as {kind})").alias("found"), "kept_row")
    if n > 1:
        out = out.groupBy(F.col("kept_row.n").alias("row")).agg(F.first("id").alias("id"), F.flatten(F.collect_list("found")).alias("found"), F.first("kept_row").alias("kept_row"))
    best = F.array_sort(F.transform("found", lambda x: F.struct((-x["coverage"]).alias("c"), x["item_id"].alias("i"))))
    best = F.try_element_at(best, F.lit(1))
    return out.select(
        F.col("id").alias(id_col), (F.size("found") > 0).alias("contaminated"), F.size("found").cast("bigint").alias("n_items"),
        best["i"].alias("item_id"), (-best["c"]).alias("coverage"), "found", *[F.col(f"kept_row.c{i}").alias(c) for i, c in enumerate(carry)],
    )


def clean_stay(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, in one pass."""
    fields = docs.schema.fields
    packed = docs.select(F.col(id_col), F.col(text_col), F.struct(*[named(f.name).alias(f"c{i}") for i, f in enumerate(fields)]).alias("row"))
    made = judge(packed, benchmark, id_col, text_col, carry=["row"]).where("not contaminated")
    return made.select(*[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(fields)])
