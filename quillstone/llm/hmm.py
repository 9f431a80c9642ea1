"""A hidden Markov language model: latent states by Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion.

Tokens are the lower-cased words of a text, then one end. A word belongs to one of CLASSES classes by a hash of its text, the end to a class of its own, and words
that no training text has to another. A state emits a class, the class a word by its share of the class: p(text) = sum over paths of the states'
steps and classes, times the words' shares. So what goes to every task is the table of states by classes, of fixed size whatever the vocabulary.

(1) Texts are read once, in shards of about SHARD bytes made in each task: local word ids, and the shard's words with their training counts. Counts are summed by
word, and come back to each shard's words; by shard they meet the texts, which keep, a number for each token, the classes, and the sums that
depend on counts only (``base`` score, shares). (2) Each round of Baum-Welch goes over all training texts with the model of the round before; expected counts of a task are added up
over partitions, block of classes by block, in two steps. Rounds start from a model fitted to at most ``sample`` training texts of at most SAMPLE_TOKENS tokens
(the first by a hash of their id): this documented bound is for the start only. (3) The forward recursion runs over every text from end to end, no text is cut.

States are smoothed towards the classes' overall shares. A state's chance of an unseen word is that of words seen once in it. The words' chances and that of an unseen
word add up to one, as in the base: log10((c + 1) / (N + V + 1)) summed over tokens.

Edge cases: null and empty texts are one end; a null id counts as training; rows that repeat are learned from and scored each; very long texts are whole sequences;
without training texts all words are unseen; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .store import cut, mapped
from .words import LOWER, spans, strings

SHARD = 16 << 20
CLASSES = 1 << 14  # class 0 is the end, CLASSES that of unseen words
STATES, ROUNDS, START_ROUNDS = 8, 4, 25
SAMPLE, SAMPLE_TOKENS = 2_000, 2_000
BATCH = 1 << 19  # tokens of texts that go through the recursions together
GATHERED = 1 << 23  # tokens of texts that are put in order of length first
BLOCK = 256  # classes of a block of counts
PRIOR = 50.0
ONCE = 1 << 15  # added to the class of a word that training texts have once; both fit two bytes
END = " "  # no word
READ = "shard long, uid long, held boolean, ids binary, word string, n long"
CODED = "uid long, held boolean, n_tokens long, n_known long, base double, shares double, classes binary"


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # a row for each class, so that a token's row is one piece of memory

    @property
    def states(self) -> int:
        return len(self.start)


def _planes(ids: np.ndarray) -> bytes:
    """Numbers as their low two bytes, then their high ones, which are mostly zero."""
    return (ids & 0xFFFF).astype(np.uint16).tobytes() + (ids >> 16).astype(np.uint16).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    both = np.frombuffer(raw, np.uint16).astype(np.int64)
    return both[: len(both) // 2] | both[len(both) // 2 :] << 16


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts and of words, shard by shard."""
    shard = TaskContext.get().partitionId() << 24
    names = [x.split()[0] for x in READ.split(", ")]

    def made(held: list[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        data, off = flat.flatten(flat.column(table, "text"))
        data = LOWER[data]
        starts, ends, hashes = spans(data, off, flat.SPACE)
        unique, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(starts, off)
        held_out = np.asarray(table.column("held"))
        row = np.repeat(np.arange(len(off) - 1), np.diff(at))
        order = np.argsort(-np.bincount(ids, minlength=len(unique)), kind="stable")  # frequent words get small numbers, which compress
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, first = place[ids], first[order]
        counts = np.bincount(ids[~held_out[row]], minlength=len(unique)).astype(np.int64)
        packed = [_planes(np.append(ids[a:b], len(unique))) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n = table.num_rows
        none = lambda k, kind: pa.nulls(k, kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), flat.column(table, "uid"), flat.column(table, "held"), pa.array(packed, pa.binary()), none(n, pa.string()), none(n, pa.int64())], names)
        size = 1 << 16
        for i in range(0, len(unique) + 1, size):
            own = first[i : i + size]
            words, n = strings(data, starts[own], ends[own]).to_pylist(), counts[i : i + size]
            if i + size > len(unique):
                words, n = [*words, END], np.append(n, (~held_out).sum())
            local = np.arange(i, i + len(words))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), shard)), pa.array(local), none(len(words), pa.bool_()), none(len(words), pa.binary()), pa.array(words, pa.string()), pa.array(n)], names)

    waiting, size = [], 0
    for b in batches:
        waiting.append(b)
        size += b.nbytes
        if size >= SHARD:
            yield from made(waiting, shard)
            waiting, size, shard = [], 0, shard + 1
    if waiting:
        yield from made(waiting, shard)


def _coded(n_all: int, n_words: int, sums: np.ndarray):
    """Texts of a shard and its words' counts to what the recursions need."""
    names = [x.split()[0] for x in CODED.split(", ")]

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        local, both = (np.asarray(words.column(x)) for x in ("local", "both"))
        count, group = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        count[local], group[local] = both // CLASSES, both % CLASSES
        base = np.log10((count + 1) / (n_all + n_words + 1))
        share = np.where(count > 0, np.log10((count + 1) / np.maximum(sums[group], 1)), 0.0)
        code = (np.where(count > 0, group, CLASSES) + np.where(count == 1, ONCE, 0)).astype(np.uint16)
        out = []
        for raw in texts.column("ids").to_pylist():
            ids = _numbers(raw)
            out.append((len(ids), int((count[ids] > 0).sum()), float(base[ids].sum()), float(share[ids].sum()), code[ids].tobytes()))
        rest = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([texts.column("uid"), texts.column("held"), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names)

    return run


class Texts:
    """Classes of some texts, longest first, by place: all first tokens, then all second ones, and so on."""

    def __init__(self, raw: list[bytes]):
        size = np.array([len(x) // 2 for x in raw], np.int64)
        self.order = np.argsort(-size, kind="stable")
        codes = np.concatenate([np.frombuffer(raw[i], np.uint16) for i in self.order])
        size = size[self.order]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(len(codes)) - np.repeat(first, size)  # a token's place in its text
        codes = codes[np.argsort(at, kind="stable")]
        self.codes, self.once = (codes & (ONCE - 1)).astype(np.int64), codes >= ONCE
        self.open = np.bincount(at)  # texts that have a token at each place
        self.off = np.concatenate([[0], np.cumsum(self.open)])

    def forward(self, model: Model, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of each text's classes, in the order given to the class, and the scale of each token. ``keep``: gets the scaled forward rows of all tokens."""
        scales, now, one = np.empty(len(self.codes)), np.empty((0, model.states)), np.ones(model.states)
        for t, (a, b) in enumerate(zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True)):
            here = np.take(model.emit, self.codes[a:b], 0)
            here *= now[: b - a] @ model.step if t else model.start
            s = here @ one
            here *= (1 / s)[:, None]
            scales[a:b], now = s, here
            if keep is not None:
                keep[a:b] = here
        text = np.arange(len(self.codes)) - np.repeat(self.off[:-1], self.open)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(text, np.log10(scales), len(self.order))
        return out, scales

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, steps, classes by state, and words seen once by state."""
        k = model.states
        rows = np.empty((len(self.codes), k))
        _, scales = self.forward(model, rows)
        scales, turned = 1 / scales, np.ascontiguousarray(model.step.T)
        steps, back = np.zeros((k, k)), np.ones((0, k))
        for a, b in zip(self.off[-2::-1].tolist(), self.off[:0:-1].tolist(), strict=True):
            now = np.take(model.emit, self.codes[a:b], 0)
            now *= scales[a:b, None]
            n = len(back)
            if n:
                steps += rows[a : a + n].T @ back
                after = back @ turned
                now[:n] *= after
                rows[a : a + n] *= after
            back = now
        emits = np.stack([np.bincount(self.codes, rows[:, s], CLASSES + 1) for s in range(k)], 1)
        return rows[: self.open[0]].sum(0), steps * model.step, emits, rows[self.once].sum(0)


def improved(start: np.ndarray, steps: np.ndarray, emits: np.ndarray, once: np.ndarray, prior: np.ndarray) -> Model:
    """The model of expected counts. ``prior``: the classes' overall shares."""
    steps = steps + 1.0
    seen = emits[:CLASSES].sum(0)
    unseen = (once + 0.5) / (seen + 1)
    unseen = np.where(unseen < 1, unseen, 0.5)
    known = (emits[:CLASSES] + PRIOR * prior[:, None]) / (seen + PRIOR) * (1 - unseen)
    return Model((start + 1) / (start + 1).sum(), steps / steps.sum(1, keepdims=True), np.concatenate([known, unseen[None]]))


def _in_batches(rows: Iterator[tuple], size_of) -> Iterator[list]:
    """Rows of some BATCH tokens, of alike length, so that few steps of a recursion have few texts."""
    held, n = [], 0

    def parts(held: list) -> Iterator[list]:
        held.sort(key=size_of, reverse=True)
        part, n = [], 0
        for r in held:
            part.append(r)
            n += size_of(r)
            if n >= BATCH:
                yield part
                part, n = [], 0
        if part:
            yield part

    for r in rows:
        held.append(r)
        n += size_of(r)
        if n >= GATHERED:
            yield from parts(held)
            held, n = [], 0
    yield from parts(held)


def _pack(start, steps, emits, once) -> Iterator[tuple[int, bytes]]:
    """Blocks of counts, the small ones first."""
    yield -1, np.concatenate([start, steps.ravel(), once]).tobytes()
    for i in range(0, CLASSES + 1, BLOCK):
        yield i // BLOCK, emits[i : i + BLOCK].tobytes()


def _expected(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shipped.value, None
        for held in _in_batches((x for b in batches for x in flat.column(b, "classes").to_pylist()), lambda x: len(x) // 2):
            got = Texts(held).expected(model)
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            block, value = zip(*_pack(*total), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(value, pa.binary())], ["block", "value"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = np.frombuffer(value)
            total[block] = total[block] + own if block in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "value"])


def baum_welch(training: DataFrame, model: Model, prior: np.ndarray) -> Model:
    """A round over all texts of ``training`` (classes binary)."""
    shape = "block long, value binary"
    shipped = training.sparkSession.sparkContext.broadcast(model)  # STATES * CLASSES numbers
    counts = mapped(training.select("classes"), _expected(shipped), shape).withColumn("share", F.spark_partition_id() % 32)
    half = counts.repartition("block", "share").select("block", "value").mapInArrow(_summed, shape)
    rows = half.repartition("block").mapInArrow(_summed, shape).collect()
    got = {r.block: np.frombuffer(r.value) for r in rows}
    if not got:
        return model
    k = model.states
    head = got.pop(-1)
    emits = np.concatenate([got[i].reshape(-1, k) for i in sorted(got)])
    return improved(head[:k], head[k : k + k * k].reshape(k, k), emits, head[k + k * k :], prior)


def begin(raw: list[bytes], prior: np.ndarray, states: int, rounds: int = START_ROUNDS) -> Model:
    """A model fitted to a few texts, from states that differ by chance and tend to stay."""
    rng = np.random.Generator(np.random.PCG64(7))
    emits = np.concatenate([prior[:, None] * np.exp(rng.normal(0, 1, (CLASSES, states))), np.zeros((1, states))]) * 1000
    model = improved(np.ones(states), np.ones((states, states)) + 20 * states * np.eye(states), emits, np.ones(states), prior)
    texts = [Texts(b) for b in _in_batches(iter(raw), lambda x: len(x) // 2)]
    for _ in range(rounds if raw else 0):
        got = [t.expected(model) for t in texts]
        model = improved(*(sum(x) for x in zip(*got, strict=True)), prior)
    return model


def _scored(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "held", "n_tokens", "n_known", "base", "shares", "classes"]
        rows = (r for b in batches for r in zip(*(flat.column(b, x).to_pylist() for x in names), strict=True))
        for held in _in_batches(rows, lambda r: r[2]):
            uid, out, n, known, base, shares, raw = zip(*held, strict=True)
            score = Texts(list(raw)).forward(shipped.value)[0] + np.array(shares)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(out, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score)], ["uid", "held", "n_tokens", "n_known", "base", "score"])

    return run


def class_of(word: Column) -> Column:
    return F.when(word == END, F.lit(0)).otherwise(F.pmod(F.xxhash64(word), F.lit(CLASSES - 1)) + 1).cast("long")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, np.ndarray]:
    """CODED rows of all texts, the number of training tokens, and the classes' overall shares."""
    uid = F.col(id_col).cast("bigint")
    held = F.coalesce(F.crc32(uid.cast("string")) % 7 == 2, F.lit(False))
    read = cut(mapped(docs.select(uid.alias("uid"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), _texts, READ), "read")
    words = read.where("word is not null").select("shard", "uid", "word", "n")
    counts = cut(words.groupBy("word").agg(F.sum("n").alias("c")).withColumn("g", class_of(F.col("word"))), "counts")
    known = counts.where("c > 0")
    by_class = known.groupBy("g").agg(F.sum(F.col("c") + 1).alias("s"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # CLASSES rows at most
    n_all, n_words = sum(r.n for r in by_class), sum(r.v for r in by_class)
    sums = np.zeros(CLASSES)
    for r in by_class:
        sums[r.g] = r.s
    met = words.select("shard", "uid", "word").join(counts, "word").select(F.col("shard").alias("of"), F.col("uid").alias("local"), (F.col("c") * CLASSES + F.col("g")).alias("both"))
    texts = read.where("word is null").select("shard", "uid", "held", "ids")
    coded = cut(texts.groupBy("shard").cogroup(met.groupBy("of")).applyInArrow(_coded(n_all, n_words, sums), CODED), "coded")
    return coded, n_all, sums / max(sums.sum(), 1)


def train(coded: DataFrame, prior: np.ndarray, states: int = STATES, rounds: int = ROUNDS, sample: int = SAMPLE) -> Model:
    training = coded.where("not held")
    short = training.where(F.col("n_tokens") <= SAMPLE_TOKENS).select("classes", F.xxhash64("uid").alias("h"))
    first = short.select("h").orderBy("h").limit(sample).collect()  # hashes only, as each task sends so many
    some = short.where(F.col("h") <= first[-1].h).orderBy("h", "classes").limit(sample).collect() if first else []
    model = begin([bytes(r.classes) for r in some], prior, states)
    for _ in range(rounds):
        model = baum_welch(training, model, prior)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    coded, n_all, prior = encoded(docs, id_col, text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(train(coded, prior, states, rounds))
    out = mapped(coded, _scored(shipped), "uid long, held boolean, n_tokens long, n_known long, base double, score double")
    return out.select(F.col("uid").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
