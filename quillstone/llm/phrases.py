"""Collocations: phrases of two to MOST words whose every cut is far more frequent than chance, mined by suffix arrays.

Words are what stands between blanks in a piece, pieces what stands between marks or line ends. Shards of at most SHARD bytes of one language are made in
each task; a longer text is cut between words, and each part sees the MOST - 1 words after it, without counting phrases that start there. Of a shard's word ids
numpy builds a suffix array by prefix doubling (ranks of 1, 2, 4, then MOST words), the common prefixes of neighbours, and from the intervals of these the number of
times that each phrase occurs. The counts of all shards are merged by language and phrase.

A phrase is at most as frequent as its parts, so there are three passes: words; pairs of words that are frequent; longer phrases of which all pairs are frequent. What is
frequent goes to the tasks as a bitmap of a fixed number of bits at most (MOST_BITS). It lets a few rare ones through, which the merged counts then remove: it changes what
is shuffled, never the result.

A candidate is frequent and has two words at least. Scores are exact in decimals of 38 digits. A candidate inside a longer one of equal count is dropped; it is enough to
look at those longer by one word, since counts don't grow on the way. The best of each language are chosen among the best of each of SPREAD shares.

Edge cases: null texts are empty; a null language is ``und``, together with one named so; empty texts and pieces give nothing, very long ones are mined whole; repeated rows
count each; ties go by phrase in the order of its UTF-8 bytes; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import flat
from .store import cut, mapped, small
from .words import LOWER, spans, strings

MOST = 5
SHARD = 8 << 20
LEAST_BITS, MOST_BITS = 20, 27
SPREAD = 64
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
GAP = BREAK.copy()
GAP[[9, 32]] = True
COUNTS = "lang string, words int, phrase string, n long"


class Bits:
    """A set of hashes with false members, as a bitmap."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> flat.U(64 - self.bits)).astype(np.int64)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0


def _salt(lang: str) -> np.uint64:
    """A number for each language, so that equal words of two are told apart."""
    return flat.U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return flat.mix(first * flat.U(0xD1342543DE82EF95) + second + flat.U(2))


class Shard:
    """Words of some texts of one language: hashes, ids by hash from 1, the places where a piece ends, and which may start a phrase."""

    def __init__(self, lang: str):
        self.lang, self.size = lang, 0
        self.data: list[np.ndarray] = []
        self.own: list[int] = []  # bytes of each text in which phrases may start

    def put(self, data: np.ndarray, own: int) -> None:
        self.data.append(data)
        self.own.append(own)
        self.size += len(data)

    def read(self) -> None:
        """Find the words of all texts."""
        line = np.array([10], np.uint8)
        self.text = whole = np.concatenate([x for d in self.data for x in (d, line)])
        off = np.concatenate([[0], np.cumsum([len(d) + 1 for d in self.data])])
        self.data = []
        self.starts, self.ends, hashes = spans(whole, off, GAP)
        self.unique, ids = np.unique(hashes, return_inverse=True)
        self.ids = ids.astype(np.int64) + 1
        marks = np.concatenate([[0], np.cumsum(BREAK[whole])])
        self.stop = np.ones(len(self.ids), bool)  # no phrase goes on beyond this word
        self.stop[:-1] = marks[self.starts[1:]] > marks[self.ends[:-1]]
        row = np.searchsorted(off, self.starts, "right") - 1
        self.counts = self.starts < off[row] + np.array(self.own)[row]

    def follow(self, keep: np.ndarray, joined: np.ndarray | None = None) -> None:
        """Only words where ``keep`` is true, and only phrases over ``joined`` (place i: of word i and the next)."""
        stop = self.stop | ~(joined if joined is not None else np.ones(len(self.stop), bool))
        stop[:-1] |= ~keep[1:]
        stop |= ~keep
        self.stop = stop

    def phrases(self, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first word's place, number) of the distinct phrases of ``least`` to ``most`` words, by a suffix array."""
        n = len(self.ids)
        after = np.full(n, n, np.int64)  # words from here to the end of the piece
        last = np.flatnonzero(self.stop)
        after = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1 if n else after
        at = np.flatnonzero((after >= least) & self.counts)
        if not len(at):
            return
        wanted = np.zeros(n, bool)  # words of some phrase
        for d in range(most):
            wanted[at[after[at] > d] + d] = True
        place = np.flatnonzero(wanted)
        to = np.full(n + 1, len(place), np.int64)
        to[place] = np.arange(len(place))
        length = np.minimum(after[place], most)
        rank = np.append(np.unique(self.ids[place], return_inverse=True)[1] + 1, 0)
        first, span = rank, 1
        while span < most:
            step = min(span, most - span)  # ranks of ``span`` words, then of the ``step`` after them
            tail = rank if step == span else first
            if step not in (1, span):
                raise ValueError("phrases of 2, 3, 4, 5 or 8 words")
            goes = length > span
            more = np.zeros(len(place), np.int64)
            more[goes] = tail[to[place[goes] + span]]
            rank = np.append(np.unique(rank[:-1] * (len(place) + 1) + more, return_inverse=True)[1] + 1, 0)
            span += step
        own = to[at]
        order = own[np.argsort(rank[own], kind="stable")]
        common = np.zeros(len(order), np.int64)  # of each suffix and the one before it
        same = np.ones(len(order) - 1, bool)
        for d in range(most):
            left, right = order[:-1], order[1:]
            same &= (length[left] > d) & (length[right] > d)
            w = np.flatnonzero(same)
            same[w] = self.ids[place[left[w]] + d] == self.ids[place[right[w]] + d]
            common[1:][same] = d + 1
        for words in range(least, most + 1):
            has = length[order] >= words
            # suffixes with so many words stand together with those that begin alike; shorter ones end an interval
            starts = np.flatnonzero(has & (common < words))
            if len(starts):
                yield words, place[order[starts]], np.add.reduceat(has.astype(np.int64), starts)

    def texts(self, at: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that start at ``at``, joined by blanks."""
        parts = [strings(self.text, self.starts[at + d], self.ends[at + d]) for d in range(words)]
        return pc.binary_join_element_wise(*parts, " ") if words > 1 else parts[0]


def _next(data: np.ndarray, at: int, gap: bool) -> int:
    """The first place from ``at`` on that is in a gap, or that is not."""
    while at < len(data):
        found = np.flatnonzero(GAP[data[at : at + 4096]] == gap)
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(data)


def _parts(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A text in parts of about SHARD bytes, cut after a word, each with the words after it that phrases may reach."""
    at = 0
    while at < len(data):
        reach = end = _next(data, at + SHARD, True)
        for _ in range(MOST - 1):
            reach = _next(data, _next(data, reach, False), True)
        yield data[at:reach], end - at
        at = end


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of whole texts, each ready to be mined."""
    open_: dict[str, Shard] = {}
    for b in batches:
        data, off = flat.flatten(flat.column(b, "text"))
        data = LOWER[data]
        for i, lang in enumerate(flat.column(b, "lang").to_pylist()):
            text = data[off[i] : off[i + 1]]
            for part, own in [(text, len(text))] if 0 < len(text) <= SHARD else _parts(text):
                shard = open_.setdefault(lang, Shard(lang))
                shard.put(part, own)
                if sum(s.size for s in open_.values()) > SHARD:
                    largest = max(open_, key=lambda x: open_[x].size)
                    done = open_.pop(largest)
                    done.read()
                    yield done
    for done in open_.values():
        done.read()
        yield done


def _counted(least: int, most: int, shipped: list):
    """Counts of the phrases of ``least`` to ``most`` words; ``shipped``: bitmaps of the frequent words, and of the frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            if not len(shard.ids):
                continue
            salt, keep = _salt(shard.lang), np.ones(len(shard.ids), bool)
            if shipped:
                keep = shipped[0].value.has(flat.mix(shard.unique ^ salt))[shard.ids - 1]
            joined = None
            if len(shipped) > 1:
                joined = np.zeros(len(keep), bool)
                h = shard.unique[shard.ids - 1]
                maybe = np.flatnonzero(keep[:-1] & keep[1:] & ~shard.stop[:-1])
                joined[maybe] = shipped[1].value.has(flat.mix(_pair(h[maybe], h[maybe + 1]) ^ salt))
            shard.follow(keep, joined)
            for words, at, n in shard.phrases(least, most):
                for i in range(0, len(at), 1 << 16):
                    own = at[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(own), pa.string()), pa.array(np.full(len(own), words, np.int32)), shard.texts(own, words), pa.array(n[i : i + (1 << 16)])], ["lang", "words", "phrase", "n"])

    return run


def _places(bits: int):
    """The bit of each word or pair of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat.flatten(flat.column(b, "phrase"))
            words, at, _ = flat.word_hashes(data, off, GAP)
            h, two = words[at[:-1]], np.diff(at) == 2
            h[two] = _pair(h[two], words[at[:-1][two] + 1])
            langs = flat.column(b, "lang").dictionary_encode()
            salts = np.array([_salt(x) for x in langs.dictionary.to_pylist()], np.uint64)
            h = flat.mix(h ^ salts[np.asarray(langs.indices)]) if len(h) else h
            yield pa.RecordBatch.from_arrays([pa.array((h >> flat.U(64 - bits)).astype(np.int64))], ["place"])

    return run


def _bitmap(frequent: DataFrame) -> Bits:
    """Of at least 16 bits a phrase, and at most 2**MOST_BITS: what comes to the driver is bounded by that."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(frequent.count() * 16).bit_length()))
    places = mapped(frequent.select("lang", "phrase"), _places(bits), "place long")
    long = places.groupBy(F.shiftright("place", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("w")).toArrow()
    packed = np.zeros(1 << (bits - 6), np.int64)
    packed[np.asarray(long.column("i"))] = np.asarray(long.column("w"))
    return Bits(bits, packed.view(np.uint8))


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def frequent_phrases(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases of up to MOST words that occur ``least`` times or more, and (lang, total): all word occurrences."""
    rows, context = _rows(docs, text_col, lang_col), docs.sparkSession.sparkContext
    merged = lambda lo, hi, shipped: mapped(rows, _counted(lo, hi, shipped), COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    words = cut(merged(1, 1, []), "words")
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = words.where(F.col("n") >= least)
    shipped = [context.broadcast(_bitmap(words))]
    pairs = cut(merged(2, 2, shipped).where(F.col("n") >= least), "pairs")
    shipped.append(context.broadcast(_bitmap(pairs)))
    longer = cut(merged(3, MOST, shipped).where(F.col("n") >= least), "longer")
    return words.unionByName(pairs).unionByName(longer), totals


def score_cuts(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, n, score) of the phrases of two words or more, by their lowest-scoring cut."""
    tokens = F.split("phrase", " ")
    cuts = frequent.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(tokens, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(tokens, F.col("k") + 1, F.col("words")), " ").alias("right"))
    part = frequent.select("lang", "phrase", F.col("n"))
    met = cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"]).join(small(totals), "lang")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    met = met.withColumn("top", F.lit(1000).cast("decimal(38,0)") * big("a") * big("total")).withColumn("below", big("l") * big("r"))
    met = met.withColumn("score", F.expr("cast(top div below as bigint)"))
    worst = met.groupBy("lang", "words", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return worst.select("lang", "words", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))


def covered(frequent: DataFrame) -> DataFrame:
    """(lang, phrase) of the phrases that stand in a phrase longer by a word and as frequent."""
    longer = frequent.where("words > 2").withColumn("t", F.split("phrase", " "))
    inside = longer.select("lang", "n", F.explode(F.array(F.array_join(F.slice("t", 1, F.col("words") - 1), " "), F.array_join(F.slice("t", 2, F.col("words") - 1), " "))).alias("phrase"))
    return inside.join(frequent, ["lang", "phrase", "n"], "left_semi").select("lang", "phrase").distinct()


def collocations(docs: DataFrame, least: int = 100, top: int = 2_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` of each language by score, count and phrase: lang, rank, phrase, a, l, r, n, score."""
    frequent, totals = frequent_phrases(docs, least, text_col, lang_col)
    scored = score_cuts(frequent, totals).join(covered(frequent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.col("phrase").cast("binary")]
    shared = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    best = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
