"""Toxicity as an ordered severity: a cumulative-link model on sparse word features.

P(grade > j) = sigmoid(w . x - theta_j) for thresholds theta_0 < theta_1 < ...; all thresholds share the weights w. x holds 1 + log(count)
of the words (lower-cased runs of letters, digits and non-ASCII characters) and of their first 4, 5 and 6 bytes, all hashed
to 2**BITS places, as far as the labelled sample tells toxic rows from others by them. The expected severity is the sum of P(grade > j); a document is toxic if
P(grade > 0) is at least a cut chosen on held-out rows of the sample (their best F1).

Fitting: labels say toxic or not. Grades 1 to 3 of toxic rows are thirds of the rate of words that mark them. The
sample is at most ``max_labelled`` labelled rows, the first by a hash of their id; its word counts go to the driver, which is the
documented bound. Scoring reads every document whole.

Edge cases: null and empty texts have no feature and get the base rate; very long texts are scored whole; null or absent labels aren't used; with no
toxic row (or none that isn't) in the sample every score is the base rate; repeated rows are scored each; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .store import mapped
from .tiling import BETWEEN

BITS = 20
STEMS = (4, 5, 6)
GRADES = 4
MAX_LABELLED = 8_000


@dataclass
class Ordinal:
    """Weights by word place and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def features(col: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, place, 1 + log(count)) of each block of rows and how many rows it has; with ``wanted`` only of places where it is true."""
    data, off = flat.flatten(pc.utf8_lower(pc.fill_null(col, "")))
    for i, j in flat.runs(off):
        h, row = flat.stem_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], STEMS, BETWEEN)
        place = (h >> flat.U(64 - BITS)).astype(np.int64)
        if wanted is not None:
            keep = wanted[place]
            place, row = place[keep], row[keep]
        both, count = np.unique(row << BITS | place, return_counts=True)
        yield both >> BITS, both & ((1 << BITS) - 1), 1 + np.log(count), j - i


def _told_apart(row: np.ndarray, place: np.ndarray, toxic: np.ndarray, errors: float = 3.5) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each place between toxic and other rows by presence, and which of them mark toxic rows: by ``errors`` standard errors."""
    t, n = toxic.sum(), len(toxic) - toxic.sum()
    a = np.bincount(place[toxic[row]], minlength=1 << BITS)
    b = np.bincount(place[~toxic[row]], minlength=1 << BITS)
    odds = np.log((a + 0.5) / (t - a + 0.5)) - np.log((b + 0.5) / (n - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (t - a + 0.5) + 1 / (n - b + 0.5))
    return odds, odds > errors * error


def grade(row: np.ndarray, place: np.ndarray, x: np.ndarray, toxic: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0 for other rows; toxic rows by thirds of the share of marking words among their words."""
    _, marks = _told_apart(row, place, toxic)
    rate = np.bincount(row, np.exp(x - 1) * marks[place], minlength=len(toxic)) / np.maximum(words, 1)
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        cuts = np.quantile(rate[toxic], [1 / 3, 2 / 3])
        out[toxic] = 1 + np.searchsorted(cuts, rate[toxic], "left")
    return out


def likelihood(p: np.ndarray, r: np.ndarray, local: np.ndarray, v: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean log-likelihood of the grades ``y`` less the ridge, and its slopes. ``p``: weights, first threshold, logarithms of the steps to the next
    ones; (r, local, v): row, weight and value of each feature."""
    n, k = len(y), len(p) - (GRADES - 1)
    w, rest = p[:k], p[k:]
    gaps = np.exp(rest[1:])
    th = rest[0] + np.concatenate([[0], np.cumsum(gaps)])
    score = np.bincount(r, w[local] * v, minlength=n)
    above = 1 / (1 + np.exp(np.clip(th[None] - score[:, None], -50, 50)))
    # log likelihood of grade k: log(P(> k - 1) - P(> k)); its slopes by the two logits next to it
    up = np.concatenate([np.ones((n, 1)), above], 1)
    at = np.arange(n)
    hi, lo = up[at, y], np.append(up[:, 1:], np.zeros((n, 1)), 1)[at, y]
    p_y = np.maximum(hi - lo, 1e-9)
    slope_hi, slope_lo = hi * (1 - hi) / p_y, lo * (1 - lo) / p_y
    g_score = slope_hi - slope_lo
    g_th = np.zeros((n, GRADES - 1))
    has = y > 0
    g_th[at[has], y[has] - 1] -= slope_hi[has]
    has = y < GRADES - 1
    g_th[at[has], y[has]] += slope_lo[has]
    g_th = g_th.sum(0)
    grad = np.concatenate([np.bincount(local, g_score[r] * v, minlength=k), [g_th.sum()], [g_th[j + 1 :].sum() * gaps[j] for j in range(GRADES - 2)]]) / n
    grad[:k] -= ridge * w
    return float(np.log(p_y).mean() - ridge / 2 * w @ w), grad


def fit(row: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, toxic: np.ndarray, rounds: int = 600, ridge: float = 1e-4) -> Ordinal:
    """Maximum likelihood with a ridge by accelerated gradient steps; thresholds as a first one and positive steps."""
    n = len(y)
    weights = np.zeros(1 << BITS)
    share = [(np.sum(y > j) + 0.5) / (n + 1) for j in range(GRADES - 1)]
    theta = np.log((1 - np.array(share)) / np.array(share))
    theta = np.maximum.accumulate(theta + np.arange(GRADES - 1) * 1e-3)
    if not toxic.any() or toxic.all():
        return Ordinal(weights, theta)
    _, apart = _told_apart(row, place, toxic)
    keep = apart[place]
    cols, local = np.unique(place[keep], return_inverse=True)
    r, v = row[keep], x[keep]
    p = np.concatenate([np.zeros(len(cols)), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    step, slow = np.zeros_like(p), np.full_like(p, 1e-8)
    for t in range(1, rounds + 1):
        _, grad = likelihood(p, r, local, v, y, ridge)
        step = 0.9 * step + 0.1 * grad
        slow = 0.99 * slow + 0.01 * grad**2
        p = p + 0.1 * (step / (1 - 0.9**t)) / (np.sqrt(slow / (1 - 0.99**t)) + 1e-6)
    weights[cols] = p[: len(cols)]
    rest = p[len(cols) :]
    return Ordinal(weights, rest[0] + np.concatenate([[0], np.cumsum(np.exp(rest[1:]))]))


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of the at most ``bound`` labelled documents that come first by a hash of their id."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id")  # at most ``bound`` rows of two numbers


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        y = flat.column(b, "y")
        at = 0
        for row, place, x, n in features(flat.column(b, "text")):
            ends = np.searchsorted(row, np.arange(n + 1))
            for i in range(n):
                s = slice(ends[i], ends[i + 1])
                yield pa.RecordBatch.from_arrays([pa.array([y[at + i].as_py()], pa.int32()), pa.array([place[s].astype(np.int32).tobytes()]), pa.array([np.rint(np.exp(x[s] - 1)).astype(np.int32).tobytes()])], ["y", "place", "count"])
            at += n


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    rows = mapped(sample(docs, labels, "toxic", max_labelled, id_col, text_col).select("id", "text", "y"), _counts, "y int, place binary, count binary").orderBy("place", "y").collect()
    toxic = np.array([r.y > 0 for r in rows], bool)
    if not len(rows):
        return Ordinal(np.zeros(1 << BITS), np.log(9) + np.arange(GRADES - 1.0))
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r.place) // 4 for r in rows])
    place = np.concatenate([np.frombuffer(r.place, np.int32) for r in rows])
    count = np.concatenate([np.frombuffer(r["count"], np.int32) for r in rows])
    words = np.bincount(row, count, minlength=len(rows))
    del rows
    near = _told_apart(row, place, toxic, 2.5)[1][place]  # the rest can't mark anything
    row, place, x = row[near], place[near], 1 + np.log(count[near])
    del count, near
    return fit_with_cut(row, place, x, toxic, words)


def fit_with_cut(row: np.ndarray, place: np.ndarray, x: np.ndarray, toxic: np.ndarray, words: np.ndarray) -> Ordinal:
    """The model of all rows, with the cut that had the best F1 on every third row for a model of the others."""
    out = fit(row, place, x, grade(row, place, x, toxic, words), toxic)
    held = np.arange(len(toxic)) % 3 == 0
    new = np.cumsum(~held) - 1
    own = ~held[row]
    r, p, v, t = new[row[own]], place[own], x[own], toxic[~held]
    if len(t) and t.any() and not t.all() and toxic[held].any():
        half = fit(r, p, v, grade(r, p, v, t, words[~held]), t)
        s = half.above(np.bincount(row, half.weights[place] * x, minlength=len(toxic))[held])[:, 0]
        y = toxic[held]
        cuts = np.unique(np.clip(np.round(s, 3), 0.1, 0.5))
        f1 = [2 * np.sum((s >= c) & y) / max(np.sum(s >= c) + y.sum(), 1) for c in cuts]
        best = np.flatnonzero(np.array(f1) == max(f1))
        out.cut = float(cuts[best[-1]])
    return out


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        wanted = model.weights != 0
        for b in batches:
            at = 0
            for row, place, x, n in features(flat.column(b, "text"), wanted):
                above = model.above(np.bincount(row, model.weights[place] * x, minlength=n))
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([flat.column(b, "id").slice(at, n), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above.tolist(), kind), pa.array(above[:, 0] >= model.cut)], ["id", "expected_severity", "p_toxic", "p_above", "toxic"])
                at += n

    return run


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, expected_severity, p_toxic, p_above (for each threshold), toxic."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the data
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return mapped(rows, _score(shipped), "id long, expected_severity double, p_toxic double, p_above array<double>, toxic boolean").withColumnRenamed("id", id_col)
