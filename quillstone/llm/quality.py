"""Document quality by hierarchical empirical Bayes.

A document classifier (logistic regression on figures of the text) gives each document a probability. Sites have two levels,
host and path in host. Grouped sums over all documents give every level its mean; sparse sites are shrunk to the level above,
path to host and host to the global mean, with prior strengths estimated from the spread between sites (method of moments).
The posterior of a document adds the log-odds by which its path departs from the global mean to its own log-odds; the means that it
meets are those of the other documents of its site, so its own evidence counts once.

Fitting takes at most ``max_labelled`` labelled rows, the first by a hash of their id, whose figures go to the driver: the documented
bound. The grouped sums are combined before the shuffle, so a host with a third of all rows costs a row a task.

Edge cases: null and empty texts have figures like any other and are judged by them, very long ones whole; null host or path is a site of its
own; labels that are null or absent aren't used; with one class only among the labels all documents get its rate; repeated
rows are judged each; an empty table gives an empty result; other columns pass through a filter untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import flat
from .store import cut, mapped, named, small
from .tiling import BETWEEN
from .toxicity import MAX_LABELLED, sample

LINES = np.array([c == 10 for c in range(256)])
_ASCII = [chr(c) if c < 128 else "" for c in range(256)]
CLASSES = np.stack([np.array([bool(f(c)) for c in _ASCII]) for f in (str.isupper, str.islower, str.isdigit, str.isspace, lambda c: c and c in ".,;:'\"-", lambda c: c and c in "!?", lambda c: c and c in "|<>{}[]=\\/", lambda c: c and c in "#$%&*@^~+_")])
EDGES = [0.002, 0.01, 0.03, 0.1, 0.3]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -12, 12)


def figures(col: pa.Array) -> Iterator[np.ndarray]:
    """Figures of the texts of each block of rows."""
    data, off = flat.flatten(col)
    for i, j in flat.runs(off):
        own, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        size = np.maximum(np.diff(at), 1)
        shares = []
        for c in CLASSES:
            sums = np.concatenate([[0], np.cumsum(c[own])])
            shares.append(np.diff(sums[at]) / size)
        words, w, _ = flat.word_hashes(own, at, BETWEEN)
        lines, ln, _ = flat.word_hashes(own, at, LINES)
        n_words, n_lines = np.diff(w), np.diff(ln)
        u_words = np.array([len(np.unique(words[a:b])) for a, b in zip(w[:-1], w[1:], strict=True)])
        u_lines = np.array([len(np.unique(lines[a:b])) for a, b in zip(ln[:-1], ln[1:], strict=True)])
        plain = [*shares, u_words / np.maximum(n_words, 1), u_lines / np.maximum(n_lines, 1), np.log1p(n_words), size / np.maximum(n_words, 1) / 10, n_words / np.maximum(n_lines, 1) / 100]
        steps = [s > e for s in (shares[0], shares[5], shares[6], shares[7]) for e in EDGES]
        steps += [u_lines / np.maximum(n_lines, 1) < e for e in (0.3, 0.6, 0.9)] + [u_words / np.maximum(n_words, 1) < e for e in (0.1, 0.2, 0.4)] + [n_words < e for e in (3, 8, 20)]
        yield np.stack([np.asarray(p, float) for p in (*plain, *steps)], 1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Classifier:
    """Logistic regression by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag(keep)
        d = np.linalg.solve(h, z.T @ (y - p) - keep * w)
        w += d
        if np.abs(d).max() < 1e-6:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = list(figures(flat.column(b, "text")))
        if x:
            yield pa.RecordBatch.from_arrays([flat.column(b, "y"), pa.array([r.tobytes() for r in np.concatenate(x)], pa.binary())], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    rows = mapped(sample(docs, labels, "quality", max_labelled, id_col, text_col).select("id", "text", "y"), _labelled, "y int, x binary").orderBy("x", "y").collect()
    width = next(figures(pa.array([""]))).shape[1]
    y = np.array([r.y > 0 for r in rows], float)
    x = np.stack([np.frombuffer(r.x, float) for r in rows]) if rows else np.zeros((0, width))
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Classifier(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(rate / (1 - rate))))
    return fit(x, y)


def _logits(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            x = [model.logit(f) for f in figures(flat.column(b, "text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(x) if x else np.zeros(0))], [*b.schema.names, "logit"])

    return run


def with_logit(rows: DataFrame, model: Classifier) -> DataFrame:
    """``rows`` (with a column text) and their classifier log-odds."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers
    return mapped(rows, _logits(shipped), StructType([*rows.schema.fields, StructField("logit", DoubleType())]))


def _strength(means: DataFrame, parent: str) -> float:
    """Prior strength from the spread of site means around ``parent``, weighted by their size: m (1 - m) / between-site variance - 1."""
    noise = F.col(parent) * (1 - F.col(parent))
    got = means.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(parent), 2)).alias("v"), F.sum("n").alias("n"), F.sum(F.col("n") * noise).alias("m"), F.sum(noise).alias("within")).first()
    if not got.n:
        return 1.0
    spread = max((got.v - got.within) / got.n, 1e-9)
    return float(min(max(got.m / got.n / spread - 1, 1.0), 1e6))


@dataclass
class Sites:
    """Sums of the sites: (site_host, site_path, host_n, host_s, n, s), the global mean, and the prior strengths of hosts and paths."""

    rows: DataFrame
    mean: float
    host_strength: float
    path_strength: float

    def means(self, own=None) -> tuple:
        """Columns of host_mean and path_mean, shrunk; without a document of probability ``own`` where one is given."""
        less, p = (0, F.lit(0.0)) if own is None else (1, own)
        host = (F.col("host_s") - p + self.host_strength * self.mean) / (F.col("host_n") - less + self.host_strength)
        return host, (F.col("s") - p + self.path_strength * host) / (F.col("n") - less + self.path_strength)


def site_sums(scored: DataFrame) -> Sites:
    """Of all sites in ``scored`` (host, path, logit)."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = float(((total[1] or 0.0) + 0.5) / ((total[0] or 0) + 1))
    k = _strength(hosts.withColumn("m", F.lit(mean)), "m")
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_mean"))
    both = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")
    rows = both.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "host_n", "host_s", "n", "s")
    return Sites(rows, mean, k, _strength(both, "host_mean"))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(site_host, site_path, host_mean, path_mean), shrunk, of all sites, and the global mean."""
    sites = site_sums(scored)
    host, path = sites.means()
    return sites.rows.select("site_host", "site_path", host.alias("host_mean"), path.alias("path_mean")), sites.mean


def _posterior(scored: DataFrame, sites: Sites) -> DataFrame:
    """``scored`` with host_mean and path_mean of the other documents of its site, and the posterior: a document's own evidence counts once."""
    rows = small(cut(sites.rows, "posteriors"))
    met = scored.join(rows, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))).drop("site_host", "site_path")
    host, path = sites.means(1 / (1 + F.exp(-F.col("logit"))))
    met = met.withColumns({"host_mean": host, "path_mean": path}).drop("host_n", "host_s", "n", "s")
    clip = F.least(F.greatest("path_mean", F.lit(1e-6)), F.lit(1 - 1e-6))
    return met.withColumn("posterior", 1 / (1 + F.exp(-(F.col("logit") + F.log(clip / (1 - clip)) - float(np.log(sites.mean / (1 - sites.mean)))))))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of ``docs``: id, host, path, p_document, host_mean, path_mean, posterior, kept."""
    model = train(docs, labels, max_labelled, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    scored = cut(with_logit(rows, model).drop("text"), "scored")
    out = _posterior(scored, site_sums(scored))
    return out.select(F.col("id").alias(id_col), "host", "path", (1 / (1 + F.exp(-F.col("logit")))).alias("p_document"), "host_mean", "path_mean", "posterior", (F.col("posterior") >= 0.5).alias("kept"))


def good_stay(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the rows that judge() rejects."""
    model = train(docs, labels, max_labelled, id_col, text_col)
    fields = docs.schema.fields
    rows = docs.select(F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.struct(*[named(f.name).alias(f"c{i}") for i, f in enumerate(fields) if f.name != text_col], F.lit(0).alias("one")).alias("row"))
    scored = cut(with_logit(rows, model), "scored")  # the rows go with their log-odds, so that texts are looked at once
    out = _posterior(scored, site_sums(scored.select("host", "path", "logit"))).where("posterior >= 0.5")
    return out.select(*[F.col("text" if f.name == text_col else f"row.c{i}").alias(f.name) for i, f in enumerate(fields)])
