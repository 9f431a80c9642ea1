"""Exact join of documents on the Jaccard similarity of their word shingles, in size-banded tiles.

Links x ~ y hold when den * |x & y| >= num * |x | y| on the sets of distinct k-word shingles. Equal sets are one class
first; from there on only class representatives meet.

Keys: shingles have one total order, in which those common in a bounded sample of SAMPLE classes come last and the rest
stand by hash. Each set gives its first n - ceil(n * num / den) + 1 shingles as keys; linked sets share one, whatever the order
is. So the sample changes how many documents meet under a key, never which links are found.

Tiles: the documents under a key, parted into bands by size. Bands grow by den/num, so a linked pair is in one band or in two
neighbouring ones. (1) Each document is paired with the least document of its band and of the band below only, so a tile
gives at most two pairs a row. Pairs are judged by the hashed parity bitmaps of the sets: the bits in which they differ are at most
the shingles in which the sets differ, which bounds the overlap from above; what is left is intersected exactly as sorted
arrays. (2) After the components of these links are known, a band with the one above it is done if it holds one component only. Of those with several,
the ones of equal membership are one; each is cut into blocks, and each two blocks are compared in a task of their own by
bitmaps, for pairs from different components; what the bit counts allow is intersected exactly. That is done twice: first only a
forest of such pairs is taken, one for each component that it would join, and then, with the components this gives, all of them.
So no link between different components is lost, and copies or a large cluster never cost pairs.

Edge cases: null and empty texts have no shingle and link with nothing; a text of fewer than k words is one shingle; a very long text
goes through whole, piece by piece;
repeated rows are equal sets, hence one class; ids that are null or repeated are replaced by the order of (id, text), and the component is
the least id among its rows (null only if all are); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .components import components
from .flat import U
from .store import BROADCAST_ROWS, cut, drop, keyed, mapped, packed, small, unpacked

SAMPLE = 8_192  # classes, at most about so many, whose shingles are counted for the order
COMMON = 2  # sampled classes that make a shingle common
MARKS = 24  # bits of the hash by which common shingles are marked
BLOCK = 2048  # rows of a block of a tile; a row goes to as many tasks as its tile has blocks, and two blocks take about a second
HOT_GROUPS = 50_000  # groups of equal sets, the largest, of which copies are left out of the tiles one by one where all copies are too many to ship
SENT = 200_000  # pairs or sets a task remembers


@cache
def bands(num: int, den: int) -> list[int]:
    """First sizes of the bands."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den // num + 1)
    return out


def _mark(grams: np.ndarray) -> np.ndarray:
    return (flat.mix(grams ^ U(0xA0761D6478BD642F)) >> U(64 - MARKS)).astype(np.int64)


def tile_keys(grams: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of one sorted set, of which linked sets share one; ``common``: the packed marks of those that come last."""
    n = len(grams)
    if n * den // num == n == -(-n * num // den) == -(-2 * n * num // (num + den)):
        return np.zeros(0, np.uint64)  # only equal sets link here, and those are one class
    p, at = n - -(-n * num // den) + 1, _mark(grams)
    late = (common[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    keys = grams[~late][:p]
    return keys if len(keys) == p else np.concatenate([keys, grams[late][: p - len(keys)]])


def bitmap(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Parity of the shingles that fall on each bit; over eight bits for each difference that a link allows, and for small sets more, as the
    counts of few bits say little."""
    size = max(1024, 1 << (8 * (2 * len(grams)) * (den - num) // (den + num)).bit_length())
    odd = np.bincount((flat.mix(grams + U(77)) & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller power of two: parities of what falls together."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    i = overlap(a, b)
    return den * i >= num * (len(a) + len(b) - i)


def _sets(k: int, emit) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat.flatten(flat.column(b, "text"))
            uid = flat.column(b, "uid")
            for i, j in flat.runs(off):
                yield emit(uid.slice(i, j - i), flat.shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k))

    return run


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sized(num: int, den: int):
    starts = np.array(bands(num, den))

    def emit(uid: pa.Array, sets: Iterator[np.ndarray]) -> pa.RecordBatch:
        n, digest, bits = [], [], []
        for s in sets:
            n.append(len(s))
            digest.append(_digest(s))
            bits.append(bitmap(s, num, den).tobytes())
        size = np.array(n, np.int64)
        band = pa.array(np.searchsorted(starts, size, "right") - 1, pa.int32())
        return pa.RecordBatch.from_arrays([uid, pa.array(size), band, pa.array(digest, pa.binary()), pa.array(bits, pa.binary())], ["uid", "n", "band", "digest", "bits"])

    return emit


def _marks(uid: pa.Array, sets: Iterator[np.ndarray]) -> pa.RecordBatch:
    made = [s.view(np.int64) for s in sets]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(made) if made else np.zeros(0, np.int64))], ["gram"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = flat.column(b, "gram").to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_mark(grams)), pa.int32())], ["at"])


def _keys(common, hot, num: int, den: int):
    def emit(uid: pa.Array, sets: Iterator[np.ndarray]) -> pa.RecordBatch:
        ids, parts = uid.to_numpy(zero_copy_only=False), []
        for i, s in zip(ids.tolist(), sets, strict=True):
            if hot.value and hot.value.get(_digest(s), i) != i:
                continue  # a copy of a large group: its first keeps the class in the tiles
            keys = tile_keys(s, common.value, num, den)
            if len(keys):
                parts.append((keys, np.full(len(keys), i, np.int64)))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1])], ["key", "uid"])

    return emit


def _grams(uid: pa.Array, sets: Iterator[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([uid, pa.array([s.tobytes() for s in sets], pa.binary())], ["uid", "grams"])


def _buffers(col: pa.Array) -> list[np.ndarray]:
    data, off = flat.flatten(col)
    whole = data if data.ctypes.data % 8 == 0 else data.copy()
    return [whole[a:b].view(np.uint64) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _bounded(num: int, den: int):
    """(u, v, n_u, bits_u, n_v, bits_v) to the (u, v) whose bit counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (flat.column(b, "n_u").to_numpy(zero_copy_only=False) + flat.column(b, "n_v").to_numpy(zero_copy_only=False)) * (den - num) // (den + num)
            keep = []
            for i, (x, y) in enumerate(zip(_buffers(flat.column(b, "bits_u")), _buffers(flat.column(b, "bits_v")), strict=True)):
                words = min(len(x), len(y))
                if int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum()) <= most[i]:
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([flat.column(b, "u").take(at), flat.column(b, "v").take(at)], ["u", "v"])

    return run


def _judge(num: int, den: int):
    """(u, v, grams_u, grams_v) to the (u, v) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = zip(_buffers(flat.column(b, "grams_u")), _buffers(flat.column(b, "grams_v")), strict=True)
            at = pa.array([i for i, (x, y) in enumerate(sets) if linked(x, y, num, den)], pa.int64())
            yield pa.RecordBatch.from_arrays([flat.column(b, "u").take(at), flat.column(b, "v").take(at)], ["u", "v"])

    return run


def _tiles(num: int, den: int, forest: bool):
    """Rows sorted by (key, low, i, j), pairs of blocks of tiles, to the pairs from different components whose bit counts allow a link; with
    ``forest`` only as many of them as would join the components of a pair of blocks, were they links."""

    def tile(uid, n, comp, upper, side, maps, both):
        words = min(map(len, maps))
        bits = np.stack([fold(x, words) for x in maps])
        place = np.arange(len(n))
        comp = comp.copy()
        for a in np.flatnonzero(side == 0).tolist():
            rest = np.flatnonzero((side == 1 if both else place > a) & (comp != comp[a]) & (upper + upper[a] < 2))
            if len(rest):
                near = rest[np.bitwise_count(bits[rest] ^ bits[a]).sum(1) <= (n[rest] + n[a]) * (den - num) // (den + num)]
                if forest and len(near):
                    near = near[np.unique(comp[near], return_index=True)[1]]
                    comp[np.isin(comp, comp[near])] = comp[a]
                yield np.minimum(uid[near], uid[a]), np.maximum(uid[near], uid[a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "low", "i", "j", "uid", "n", "component", "upper", "side"]
        sent: set[tuple[int, int]] = set()  # pairs of this task so far, forgotten when many: a pair may come twice, but none is lost
        held = None  # the rows of the last group, which may go on: two blocks at most
        for b in batches:
            now = [flat.column(b, x).to_numpy(zero_copy_only=False) for x in names] + [np.array(_buffers(flat.column(b, "bits")) + [None], object)[:-1]]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in now[:4]], axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            held = [x[last:] for x in now]
            yield from work(now, [0, *cuts.tolist()] if len(cuts) else [], sent)
        if held is not None and len(held[0]):
            yield from work(held, [0, len(held[0])], sent)

    def work(cols, cuts, sent):
        found: list[tuple[int, int]] = []
        for a, z in zip(cuts, cuts[1:], strict=False):
            _, _, i, j, uid, n, comp, upper, side, maps = (c[a:z] for c in cols)
            if z - a > 1 and (comp != comp[0]).any():
                for u, v in tile(uid, n, comp, upper, side, maps.tolist(), i[0] != j[0]):
                    new = [x for x in zip(u.tolist(), v.tolist(), strict=True) if x not in sent]
                    sent.update(new)
                    found += new
        if len(sent) > SENT:
            sent.clear()
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _common(body: DataFrame, reps: DataFrame, k: int) -> np.ndarray:
    """Packed marks of the shingles that at least COMMON of about SAMPLE classes hold. Their number is bounded by MARKS bits."""
    step = -(-reps.count() // SAMPLE) or 1
    some = reps.where(F.pmod(F.xxhash64("uid", F.lit(step)), F.lit(step)) == 0)
    grams = mapped(body.join(F.broadcast(some), "uid").select("uid", "text"), _sets(k, _marks), "gram long")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= COMMON).select("gram")
    marks = np.zeros(1 << MARKS, bool)
    marks[mapped(often, _positions, "at int").distinct().toArrow().column("at").to_numpy()] = True
    return np.packbits(marks, bitorder="little")


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: id, n_shingles, class_id (least id with an equal set), component_id (least id reachable by links)."""
    rows, plain = keyed(docs, id_col, text_col)
    body = rows.select("uid", "text")
    sized = cut(mapped(body, _sets(k, _sized(num, den)), "uid long, n long, band int, digest binary, bits binary"), "sized")
    least = sized.where("n > 0").groupBy("digest", "n").agg(F.min("uid").alias("rep"))
    classes = cut(sized.select("uid", "n", "band", "digest").join(least, ["digest", "n"], "left").select("uid", "n", "band", F.coalesce("rep", "uid").alias("rep")), "classes")
    reps = classes.where("n > 0 and uid = rep").select("uid", "n", "band")

    # documents under a key, by band; of copies only the representative, or, where the copies are too many to ship, of those of the largest groups; what
    # other copies give falls out when the keys meet the representatives
    copies = cut(classes.where("n > 0 and uid <> rep").select("uid"), "copies")
    firsts, large = body, {}
    if copies.count() <= BROADCAST_ROWS:
        firsts = body.join(F.broadcast(copies), "uid", "left_anti")
    else:
        groups = sized.where("n > 0").groupBy("digest").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
        large = {bytes(r.digest): r.rep for r in groups.orderBy(F.desc("size"), "digest").limit(HOT_GROUPS).collect()}
    context = docs.sparkSession.sparkContext
    common, hot = context.broadcast(_common(body, reps.select("uid"), k)), context.broadcast(large)
    met = Window.partitionBy("key").orderBy("uid")
    tiles = mapped(firsts.select("uid", "text"), _sets(k, _keys(common, hot, num, den)), "key long, uid long").repartition("key")
    tiles = tiles.withColumn("before", F.lag("uid").over(met)).withColumn("next", F.lead("uid").over(met)).where("before is not null or next is not null")
    raw = cut(tiles.select("key", "uid"), "tiles")
    tiles = raw.join(reps, "uid").repartition("key")  # copies that weren't left out go here
    beside = Window.partitionBy("key").orderBy("band")
    own, below, above = (beside.rangeBetween(x, x) for x in (0, -1, 1))
    first = F.struct("uid", "n")
    tiles = tiles.select(
        "key", "uid", "n", "band", F.min(first).over(own).alias("lead"), F.min(first).over(below).alias("under"),
        F.count(F.lit(1)).over(own).alias("here"), F.count(F.lit(1)).over(below).alias("fewer"), F.count(F.lit(1)).over(above).alias("more"),
    )
    lower = (F.col("uid") != F.col("lead.uid")) & ((F.col("here") > 2) | (F.col("more") > 0))  # the least one has met all others
    tiles = tiles.select("key", "uid", "n", "band", "lead", "under", lower.alias("as_lower"), (F.col("fewer") > 1).alias("as_upper"))
    tiles = cut(tiles.where("uid <> lead.uid or under is not null or as_lower or as_upper"), "members")
    drop(raw)
    pairs = tiles.where("uid <> lead.uid").select("uid", "n", "lead").unionByName(tiles.where("under is not null").select("uid", "n", F.col("under").alias("lead")))
    pairs = pairs.where(F.least("n", "lead.n") * den >= F.greatest("n", "lead.n") * num)  # the overlap is at most the smaller set
    pairs = cut(pairs.select(F.least("uid", "lead.uid").alias("u"), F.greatest("uid", "lead.uid").alias("v")).distinct(), "pairs")
    side = F.explode(F.array(F.struct(F.col("band").alias("low"), F.lit(0).alias("upper"), F.col("as_lower").alias("is")), F.struct((F.col("band") - 1).alias("low"), F.lit(1).alias("upper"), F.col("as_upper").alias("is"))))
    rest = cut(tiles.where("as_lower or as_upper").select("key", "uid", side.alias("s")).where("s.is").select("key", "uid", "s.low", "s.upper"), "rest")
    drop(tiles)

    def of(x: str) -> DataFrame:
        return sized.select(F.col("uid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits")])

    def exact(pairs_: DataFrame, name: str) -> DataFrame:
        """The pairs that link: only their sets are made again from the texts, written and moved."""
        ends = cut(pairs_.select(F.col("u").alias("uid")).unionByName(pairs_.select(F.col("v").alias("uid"))).distinct(), "ends")
        full = cut(mapped(body.join(small(ends), "uid").select("uid", "text"), _sets(k, _grams), "uid long, grams binary"), "grams")

        def side(x: str) -> DataFrame:
            return full.select(F.col("uid").alias(x), F.col("grams").alias(f"grams_{x}"))

        out = cut(mapped(pairs_.join(side("u"), "u").join(side("v"), "v"), _judge(num, den), "u long, v long"), name)
        drop(ends)
        drop(full)
        return out

    close = cut(mapped(pairs.join(of("u"), "u").join(of("v"), "v"), _bounded(num, den), "u long, v long"), "close")
    drop(pairs)
    links = exact(close, "links")
    drop(close)
    comps = cut(components(links), "comps")

    # bands that still hold several components, first by a forest of their likely pairs, then by all that is left
    for forest in (True, False):
        label = rest.join(comps.withColumnRenamed("node", "uid"), "uid", "left").select("key", "low", "upper", "uid", F.coalesce("component", "uid").alias("component"))
        label = cut(label, "labels")
        member, again = (F.sum(F.xxhash64("uid", "upper", F.lit(x)).cast("decimal(38,0)")) for x in (0, 1))
        open_ = label.groupBy("key", "low").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.min("upper").alias("upper"), F.count(F.lit(1)).alias("size"), member.alias("sum"), again.alias("sum2"))
        open_ = open_.where("a <> z and upper = 0").groupBy("size", "sum", "sum2").agg(F.min(F.struct("key", "low")).alias("at"))
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        here = label.join(open_.select("at.key", "at.low", blocks.alias("blocks")), ["key", "low"]).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
        placed = here.select("key", "low", "uid", "component", "upper", "own", other).select(
            "key", "low", "uid", "component", "upper", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side")
        )
        met = placed.join(sized.select("uid", "n", "bits"), "uid").repartition("key", "low", "i", "j").sortWithinPartitions("key", "low", "i", "j")
        near = cut(mapped(met, _tiles(num, den, forest), "u long, v long").distinct(), "near")
        more = exact(near, "more")
        drop(label)
        drop(near)
        if more.limit(1).count():
            links = links.unionByName(more)
            comps = cut(components(links), "comps")
    for done in (rest, sized, copies):
        drop(done)

    found = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("uid", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    if not plain:
        names = rows.select("uid", "id")
        found = found.join(names, "uid")
        for c in ("class_id", "component_id"):
            low = found.groupBy(c).agg(F.min("id").alias("low"))
            found = found.join(low, c).drop(c).withColumnRenamed("low", c)
        found = found.drop("uid").withColumnRenamed("id", "uid")
    return found.select(F.col("uid").alias(id_col), "n_shingles", "class_id", "component_id")


def nearest_stay(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the document of least id of each component; documents without a shingle stay. Rows that share an id stay or go together."""
    groups = join_classes(docs, id_col, text_col, k, num, den)
    stays = F.col(id_col).eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)
    gone = groups.groupBy(F.col(id_col).alias("gone_id")).agg(F.max(stays).alias("any_stays")).where("not any_stays").select("gone_id")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), packed(docs).alias("row"))
    return unpacked(rows.join(small(cut(gone, "gone")), F.col("id").eqNullSafe(F.col("gone_id")), "left_anti"), docs.columns)
