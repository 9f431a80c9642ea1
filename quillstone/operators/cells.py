"""Nearest vectors by inner product, through cells: approximate, or exact by bounds.

Centres are fitted to a bounded sample (SAMPLE vectors at most, the first by a hash of their id; k-means, ROUNDS rounds), on the driver. Every vector of the base goes to its nearest
centre, and each cell learns its radius, the largest distance of a vector from the centre. An inner product with any vector of the cell is then at most q . centre + |q| * radius.

Queries go to cells by a shuffle, one row for each cell that they look at. Approximate: the ``probes`` cells of highest bound. Exact: those first, which gives each query the
score of its k-th best; then every other cell whose bound reaches that score. A cell is cut into shares of ROWS vectors by a hash, and its queries into shares of QUERIES, so a large
cell or a common vector is no large group. What is broadcast are the centres: CELLS rows at most.

Edge cases: scores are rounded to 5 digits and ties go by id; null vectors, and vectors of another length than the first of the sample, are no result and no query; a query never
finds itself by id; repeated ids of queries are asked once; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import top_per
from .scratch import bounded, cut, small

SAMPLE, CELLS, ROUNDS = 8_192, 256, 8
PROBES = 16
ROWS, QUERIES = 16_384, 4_096
DIGITS = 5


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), float).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def fit(rows: DataFrame, cells: int | None = None) -> np.ndarray:
    """Centres for ``rows`` (id, vector): the square root of the sample's size, CELLS at most, unless given."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("vector").to_pylist()
    got = [v for v in got if len(v) == len(got[0])]
    if not got:
        return np.zeros((0, 0))
    x = np.array(got, float)
    n = min(cells or min(CELLS, max(1, int(len(x) ** 0.5))), len(x))
    centres = x[np.random.default_rng(5).choice(len(x), n, replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=n)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The least of the nearest centres of each row."""
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), 1)


def _assigned(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shipped.value
        for b in batches:
            x = _matrix(b.column(1))
            own = nearest(x, centres) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - centres[own]) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own), pa.array(away)], ["id", "vector", "cell", "away"])

    return run


def _visits(shipped, probes: int, later: bool):
    """(id, vector, cell) of the cells that a query looks at: first, or ``later`` with the score that it has to beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres, radius = shipped.value
        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            bound = x @ centres.T + np.sqrt((x**2).sum(1))[:, None] * radius
            order = np.argsort(-bound, 1, kind="stable")
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order[:, :probes], True, 1)
            wanted = first
            if later:  # rounding may lift a score by half a digit
                floor = np.asarray(b.column(2).fill_null(-np.inf), float)
                wanted = ~first & (bound >= floor[:, None] - 10.0**-DIGITS)
            row, cell = np.nonzero(wanted)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cells[cell])], ["id", "vector", "cell"])

    return run


def _best(k: int):
    def run(asked: pa.Table, base: pa.Table) -> pa.Table:
        q, ids = _matrix(asked.column("vector")), np.asarray(asked.column("id"))
        x, own = _matrix(base.column("vector")), np.asarray(base.column("id"))
        out: list[tuple] = []
        for at in range(0, len(ids) if len(own) else 0, 256):
            score = np.round(q[at : at + 256] @ x.T, DIGITS)
            for i, s in zip(ids[at : at + 256].tolist(), score, strict=True):
                keep = np.flatnonzero(own != i)
                if len(keep) > k:
                    least = np.partition(s[keep], len(keep) - k)[len(keep) - k]
                    keep = keep[s[keep] >= least]
                keep = keep[np.lexsort((own[keep], -s[keep]))[:k]]
                out += [(i, int(own[j]), float(s[j])) for j in keep]
        a, b, c = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return run


class Cells:
    """The vectors of ``rows`` by cell: whole-number ids."""

    def __init__(self, rows: DataFrame, id_col: str = "id", vector: str = "vector", cells: int | None = None):
        base = self._plain(rows, id_col, vector)
        self.centres = fit(base, cells)
        self.spark = rows.sparkSession
        if not len(self.centres):
            return
        shipped = self.spark.sparkContext.broadcast(self.centres)
        ok = base.where(F.size("vector") == self.centres.shape[1])
        self.rows = cut(bounded(ok).mapInArrow(_assigned(shipped), "id long, vector array<double>, cell long, away double"), "cells")
        self.cells = cut(self.rows.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")), "radii")
        got = self.cells.orderBy("cell").collect()  # CELLS rows at most
        number = np.array([r.cell for r in got], np.int64)
        self.shipped = self.spark.sparkContext.broadcast((number, self.centres[number], np.array([r.radius for r in got], float) + 1e-9))

    @staticmethod
    def _plain(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
        return rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    def _found(self, visits: DataFrame, k: int) -> DataFrame:
        """The best k of each query in each share of the cells that it looks at."""
        visits = cut(visits, "visits")
        asked = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
        plan = small(cut(self.cells.join(asked, "cell").select("cell", "parts", F.ceil(F.col("n") / ROWS).cast("int").alias("shares")), "shares"))
        each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        left = visits.join(plan, "cell").withColumn("part", own("parts")).select("cell", "part", each("shares", "share"), "id", "vector")
        right = self.rows.join(plan, "cell").withColumn("share", own("shares")).select(F.col("cell").alias("c"), "share", each("parts", "part"), F.col("id").alias("own"), F.col("vector").alias("v"))
        right = right.select("c", "share", "part", F.col("own").alias("id"), F.col("v").alias("vector"))
        return left.groupBy("cell", "part", "share").cogroup(right.groupBy("c", "part", "share")).applyInArrow(_best(k), "query_id long, id long, score double")

    def search(self, queries: DataFrame, k: int, id_col: str = "id", vector: str = "vector", exact: bool = True, probes: int = PROBES) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` best of each query."""
        shape = "id long, vector array<double>, cell long"
        asked = self._plain(queries, id_col, vector).dropDuplicates(["id"])
        if not len(self.centres):
            return top_per(self.spark.createDataFrame([], "query_id long, id long, score double"), ["query_id"], ["id"], k)
        asked = cut(asked.where(F.size("vector") == self.centres.shape[1]), "asked")
        first = self._found(bounded(asked).mapInArrow(_visits(self.shipped, probes, False), shape), k)
        best = [F.desc("score"), "id"]
        if not exact:
            return top_per(first, ["query_id"], best, k)
        first = cut(top_per(first, ["query_id"], best, k), "first")
        floor = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        rest = asked.join(floor, "id", "left").select("id", "vector", "floor")
        later = self._found(bounded(rest).mapInArrow(_visits(self.shipped, probes, True), shape), k)
        return top_per(first.drop("rank").unionByName(later), ["query_id"], best, k)
