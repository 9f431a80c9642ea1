"""An inverted index of three-character grams: which rows may contain a phrase.

A gram is a number, its three code points side by side; a text of fewer characters is one gram, filled up. Postings are rows (gram, n, rows), where ``rows`` are
hashes of row ids in order: one posting for each gram and shard of about SHARD bytes of text, so a gram that every text has is never one row. They are kept in buckets by
gram, sorted, so that a search reads a few row groups of few files.

A phrase of three characters or more is in a text only if all its grams are: the rarest few are intersected. Of a shorter phrase all grams that hold it count, and their
postings are united. What comes out are candidates by hash; whoever asks looks at their texts. Rows that were replaced since only add candidates.

Edge cases: texts must be lower-cased alike on both sides; null texts have no gram; a null id counts as an id of its own; every text contains the empty phrase, for which there is no index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import bounded

SHARD = 2 << 20
BUCKETS = 32
RAREST = 4
FILL = (1 << 21) - 1  # no code point
POSTINGS = "gram long, n long, rows array<long>"


def codes(text: str) -> np.ndarray:
    """Distinct grams of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        c = np.append(c, [FILL] * (3 - len(c)))
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(grams: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        gram, row = np.concatenate(grams), np.concatenate(rows)
        order = np.lexsort((row, gram))
        gram, row = gram[order], row[order]
        once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])
        gram, row = gram[once], row[once]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        off = np.append(first, len(gram))
        return pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(row))], ["gram", "n", "rows"])

    grams, rows, size = [], [], 0
    for b in batches:
        own = b.column(0).to_pylist()
        for texts in b.columns[1:]:
            for row, text in zip(own, texts.to_pylist(), strict=True):
                if text is not None:
                    grams.append(codes(text))
                    rows.append(np.full(len(grams[-1]), row, np.int64))
                    size += len(text)
                    if size >= SHARD:
                        yield made(grams, rows)
                        grams, rows, size = [], [], 0
    if grams:
        yield made(grams, rows)


def postings(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """POSTINGS of ``rows``, with the bucket that each is kept in."""
    own = rows.select(F.xxhash64(id_col).alias("row"), *[F.lower(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)])
    return bounded(own).mapInArrow(_postings, POSTINGS).withColumn("bucket", F.pmod("gram", F.lit(BUCKETS)).cast("int"))


def write(made: DataFrame, path: str) -> None:
    made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def candidates(index: DataFrame, phrase: str) -> DataFrame:
    """(row): hashes of the ids of rows that may contain ``phrase``, which is not empty and lower-cased as the rows are."""
    c = [ord(x) for x in phrase]
    if len(c) < 3:
        g, low = F.col("gram"), (1 << 21) - 1
        part = lambda i: F.shiftright(g, 42 - 21 * i).bitwiseAND(low)
        holds = F.lit(False)
        for at in range(4 - len(c)):
            own = F.lit(True)
            for i, x in enumerate(c):
                own = own & (part(at + i) == x)
            holds = holds | own
        return index.where(holds).select(F.explode("rows").alias("row")).distinct()
    grams = [int(x) for x in codes(phrase)]
    near = index.where(F.col("gram").isin(grams) & F.col("bucket").isin(sorted({x % BUCKETS for x in grams})))
    sizes = sorted((r.n, r.gram) for r in near.groupBy("gram").agg(F.sum("n").alias("n")).collect())  # a row for each gram of the phrase at most
    if len(sizes) < len(grams):
        return index.limit(0).select(F.explode("rows").alias("row"))
    used = [g for n, g in sizes[:RAREST] if n <= 20 * sizes[0][0]]
    met = index.where(F.col("gram").isin(used) & F.col("bucket").isin(sorted({x % BUCKETS for x in used}))).select("gram", F.explode("rows").alias("row"))
    return met.groupBy("row").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(used)).select("row")
