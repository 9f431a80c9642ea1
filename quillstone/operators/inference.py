"""Relationships inferred by joins: first-match lookups, shared packages, similar names, shared dependencies."""

from __future__ import annotations

import math
import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import name_similarity
from .scratch import compact, cut, small

LONG = 48  # characters of names up to which segments are cheap
SHORT, VARIANTS = 20, 10_000  # characters of names up to which shortened forms are few, and how many a name may have
NAMES = 2048  # names whose forms one task of their join gets, about
BLOCK, SHARE = 2048, 4 << 20  # members of a group that meet those of another block in one task, pairs of a task
TILE = 128  # rows of a block that each row of the other block meets in a run
EDGE = ["id", "source_id", "target_id", "relationship_type", "strength"]


def first_by_name(entities: DataFrame) -> DataFrame:
    """(name, id) of the first entity of each name."""
    return entities.groupBy("name").agg(F.min_by("id", "ord").alias("id"))


def first_in_file(entities: DataFrame) -> DataFrame:
    """(path, name, id) of the first entity of each name in a file."""
    return entities.groupBy("path", "name").agg(F.min_by("id", "ord").alias("id"))


def _edges(rows: DataFrame, id_, kind: str, strength: float) -> DataFrame:
    return rows.select(id_.alias("id"), "source_id", "target_id", F.lit(kind).alias("relationship_type"), F.lit(strength).alias("strength"))


def imports(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, symbol) facts to import edges onto the first entity of that name."""
    met = facts.join(first_by_name(entities).withColumnRenamed("id", "target_id"), facts["symbol"] == F.col("name"))
    return _edges(met, F.concat_ws("_", F.lit("import"), "source_id", "target_id"), "imports", 1.0).dropDuplicates(["id"])


def by_name_pair(facts: DataFrame, entities: DataFrame, kind: str, strength: float, prefix: str, with_line: bool, turned: bool = False, named: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(path, a, b, line) facts: a is the first of its name in the file, b the first anywhere. ``turned``: the edge goes from b to a. ``named``: first_in_file() and first_by_name() of the
    entities, where several kinds of edges share them."""
    here, there = named or (first_in_file(entities), first_by_name(entities))
    here = here.select("path", F.col("name").alias("a"), F.col("id").alias("a_id"))
    there = there.select(F.col("name").alias("b"), F.col("id").alias("b_id"))
    facts = facts.select("path", "a", "b", *(["line"] if with_line else [])).distinct()  # edges that repeat do so in a file mostly
    met = facts.join(here, ["path", "a"]).join(there, "b")
    met = met.withColumns({"source_id": F.col("b_id" if turned else "a_id"), "target_id": F.col("a_id" if turned else "b_id")})
    name = [F.lit(prefix), "source_id", "target_id", *([F.col("line").cast("string")] if with_line else [])]
    return _edges(met, F.concat_ws("_", *name), kind, strength).dropDuplicates(["id"])


def meet(left: DataFrame, right: DataFrame, key: str, at: str, to: str) -> DataFrame:
    """All rows of ``left`` with all of ``right`` of the same ``key``. The rows of a key are dealt into blocks by ``at`` and ``to``, so a task gets few of both sides, whatever the key has."""
    n = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    sizes = cut(n(left, "nl").join(n(right, "nr"), key), "sizes")
    parts = _shares(sizes.agg(F.sum(F.col("nl").cast("double") * F.col("nr"))).first()[0])
    blocks = small(sizes)
    own = lambda df, by, x, y: df.join(blocks, key).select(*df.columns, F.pmod(F.xxhash64(by), F.ceil(F.col(x) / BLOCK)).alias(f"{x}_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(y) / BLOCK) - 1)).alias(f"{y}_block")).repartition(parts, key, "nl_block", "nr_block")
    return compact(own(left, at, "nl", "nr").join(own(right, to, "nr", "nl"), [key, "nl_block", "nr_block"])).drop("nl_block", "nr_block")


def pairs_within(rows: DataFrame, key: str) -> DataFrame:
    """Each two ``rows`` of one ``key`` that differ in ``ord``, once: (key, source, target), structs of the rows, the source with the lower ``ord``. Rows are dealt into blocks as in
    meet(), and of two blocks only one order meets. The rows of a block meet those of another tile by tile, so that pairs which are near in a file have rows in common and it compresses."""
    rows = rows.where(F.col(key).isNotNull()).select(key, F.struct(*[c for c in rows.columns if c != key]).alias("row"))
    sizes = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    parts = _shares(sizes.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0])
    last = F.ceil(F.col("n") / BLOCK) - 1
    tile = F.pmod(F.xxhash64(F.lit(TILE), "row.ord"), F.ceil(F.col("n") / (last + 1) / TILE))
    dealt = rows.join(small(sizes), key).select(key, "row", F.pmod(F.xxhash64("row.ord"), last + 1).alias("own"), last.alias("last"), tile.alias("tile"))
    a = dealt.select(key, F.col("row").alias("a"), F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j")).repartition(parts, key, "i", "j")
    b = dealt.groupBy(key, F.col("own").alias("j"), "tile").agg(F.sort_array(F.collect_list("row")).alias("b"))
    b = b.select(key, "b", "j", F.explode(F.sequence(F.lit(0).cast("long"), "j")).alias("i")).repartition(parts, key, "i", "j")
    met = b.hint("merge").join(a, [key, "i", "j"]).select(key, "i", "j", "a", F.explode("b").alias("b")).where("a.ord <> b.ord and (i < j or a.ord < b.ord)")
    first = F.col("a.ord") < F.col("b.ord")
    return compact(met).select(key, F.when(first, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target"))


def _shares(pairs: float | None) -> int:
    """Partitions for so many pairs."""
    return max(1, min(10_000, math.ceil((pairs or 0) / SHARE) * 2))


def basic_imports(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, symbol) facts to edges onto all entities of that name but the source itself. Both sides are made distinct before they meet, so that the edges, which are many more, are
    shuffled only where an id has several names."""
    known = cut(entities.where("name is not null and id is not null").select(F.col("name").alias("symbol"), F.col("id").alias("target_id")).distinct(), "names")
    several = known.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("target_id")
    asked = cut(facts.select("source_id", "symbol").distinct(), "facts")
    onto = lambda targets: _edges(meet(asked, targets, "symbol", "source_id", "target_id").where("source_id <> target_id"), F.md5(F.concat_ws("|", "source_id", "target_id")), "imports", 0.8)
    out = onto(known.join(several, "target_id", "left_anti").select("symbol", "target_id"))
    if several.limit(1).count():
        out = out.unionByName(onto(known.join(several, "target_id", "left_semi").select("symbol", "target_id")).distinct())
    return out


def same_package(files: DataFrame) -> DataFrame:
    """Pairs of (ord, id, path) whose paths share at least two leading parts; strength is shared parts / longer path. The pairs are
    the result, so it grows with the square of a package; the first two parts are the join key."""
    parts = files.withColumn("parts", F.filter(F.split("path", "/"), lambda x: (x != "") & (x != "."))).where(F.size("parts") > 1)
    n, next_ = F.size("parts"), ["p2", "p3", "p4"]
    beyond = F.when(n > 5, F.transform(F.sequence(F.lit(6), n), lambda k: F.array_join(F.slice("parts", 1, k), "/"))).otherwise(F.array().cast("array<string>"))
    rows = parts.select(F.slice("parts", 1, 2).alias("package"), "ord", "id", n.alias("n"), *[F.get("parts", F.lit(k)).alias(p) for k, p in enumerate(next_, 2)], beyond.alias("beyond"))
    met = pairs_within(rows, "package")
    # nothing that a pair is asked for walks over arrays, but of paths that have five parts in common; what is missing equals nothing
    common = F.lit(5) + F.size(F.array_intersect("source.beyond", "target.beyond"))
    for k, p in reversed(list(enumerate(next_, 2))):
        common = F.when(F.coalesce(F.col(f"source.{p}") == F.col(f"target.{p}"), F.lit(False)), common).otherwise(k)
    met = met.select(F.col("source.id").alias("source_id"), F.col("target.id").alias("target_id"), (common / F.greatest("source.n", "target.n")).alias("strength"))
    return met.select(F.concat_ws("_", F.lit("same_package"), "source_id", "target_id").alias("id"), "source_id", "target_id", F.lit("same_package").alias("relationship_type"), "strength")


def _segments(n, k):
    """(i, start, size) of ``k`` segments of a text of length ``n``, the longer ones last; starts count from 0."""
    base = F.floor(n / k).cast("int")
    short = k - (n - base * k)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(i.alias("i"), (i * base + F.greatest(i - short, F.lit(0))).alias("start"), (base + F.when(i >= short, 1).otherwise(0)).alias("size")))


def _edits(m: int, threshold: float) -> int:
    """The most edits by which two names of at most ``m`` > 0 characters, one of them with as many, are still more alike than ``threshold``."""
    e = math.floor(m * (1 - threshold) + 1e-9)
    return e if 1.0 - e / m > threshold else e - 1


def _letters(names: pa.Array, order: np.ndarray, longest: int) -> np.ndarray:
    """A column of characters for each name, in ``order``, the rest of it filled with what does not count."""
    if pc.all(pc.string_is_ascii(names)).as_py():
        at = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, names.offset * 4)[order]
        text = np.frombuffer(names.buffers()[2] or b"\0", np.uint8)
        return text.take(at + np.arange(longest, dtype=np.int32)[:, None], mode="clip")
    return np.array(names.to_pylist(), f"U{longest}").view(np.uint32).reshape(len(names), longest)[order].T.copy()


def _few_edits(a: pa.Array, b: pa.Array, threshold: float) -> np.ndarray:
    """Which pairs of names of at most LONG characters are more alike than ``threshold``: the tables of edits of all pairs at once, cell by cell, as far from the diagonal as edits may lie."""
    na, nb = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int16) for x in (a, b))
    longest = np.maximum(na, nb)
    most = np.floor(np.arange(longest.max() + 1) * (1 - threshold) + 1e-9).astype(np.int16)[longest]
    order = np.argsort(nb, kind="stable")
    rows, to = na[order], np.searchsorted(nb[order], np.arange(nb.max() + 2))
    top, band, far = int(na.max()), int(most.max()), 100
    left, right = _letters(a, order, max(top, 1)), _letters(b, order, max(int(nb.max()), 1))
    table = np.full((top + 1, len(na)), far, np.uint8)
    table[: band + 1] = np.arange(min(band, top) + 1, dtype=np.uint8)[:, None]
    edits = np.full(len(na), far, np.int16)
    one = np.uint8(1)
    for j in range(int(nb.max()) + 1):
        if j:
            lo, hi = max(1, j - band), min(top, j + band)
            if lo > hi:
                break
            cells = table[lo - 1 : hi] + (left[lo - 1 : hi] != right[j - 1])
            table[lo : hi + 1] += one
            np.minimum(cells, table[lo : hi + 1], out=table[lo : hi + 1])
            if lo == 1:
                table[0] = j
            for i in range(lo if lo == 1 else lo + 1, hi + 1):
                np.minimum(table[i], table[i - 1] + one, out=table[i])
        if to[j] < to[j + 1]:
            edits[order[to[j] : to[j + 1]]] = table[rows[to[j] : to[j + 1]], np.arange(to[j], to[j + 1])]
    return (np.abs(na - nb) <= most) & (edits <= most) & (1.0 - edits / np.maximum(longest, 1) > threshold)


def _near(met: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of at most LONG characters that few enough edits lie between, looked at before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield x.filter(pa.array(_few_edits(x.column(0).cast(pa.string()), x.column(1).cast(pa.string()), threshold)))

    return met.select("a", "b").mapInArrow(run, "a string, b string")


def _near_long(met: DataFrame, threshold: float) -> DataFrame:
    """_near() for names of any length."""
    longest = F.greatest(F.length("a"), F.length("b"))
    most = F.floor(longest * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    return met.where((F.levenshtein("a", "b") <= most) & (F.lit(1.0) - F.levenshtein("a", "b") / longest > threshold))


def _short(threshold: float, skip: int = 0) -> int:
    """Characters of names that have few shortened forms, the first ``skip`` left alone."""
    few = [m for m in range(1, SHORT + 1) if math.comb(max(0, m - skip), max(0, _edits(m, threshold))) <= VARIANTS]
    return max([m for m in few if set(range(1, m + 1)) <= set(few)], default=0) if threshold >= 0.5 else 0


def _by_variants(own: DataFrame, threshold: float, skip: int, parts: int | None = None) -> DataFrame:
    """(a, b) candidates among names (low, n) of which the longer has _short() characters at most; all begin with the same ``skip`` characters. They meet in
    ``parts`` tasks, if given: forms are short and their pairs many, so that tasks by bytes would be few.

    Between names of which the longer has m characters, e edits leave a text of m - e characters that both hold as a subsequence. So each name is shortened to that length in all ways, by at
    most e characters, and those that have a form in common meet. What all names begin with is left alone.
    """
    top = _short(threshold, skip)
    some = own.where((F.col("n") > 0) & (F.col("n") <= top))
    step = some.select("low", "n", F.expr(f"substring(low, {skip + 1})").alias("v"), (F.col("n") - skip).alias("at"))
    left = {m: max(0, m - skip - max(0, _edits(m, threshold))) for m in range(max(1, skip), top + 1)}
    sides: dict[str, DataFrame] = {}
    for gone in range(max([m - skip - x for m, x in left.items()], default=-1) + 1):
        if gone:
            deeper = [n for n in left if n - skip - left[n] >= gone]
            step = step.where(F.col("n").isin(deeper) & (F.col("at") > 0)).select("low", "n", "v", F.explode(F.sequence(F.lit(1), "at")).alias("p"))
            step = step.select("low", "n", F.expr("concat(substring(v, 1, p - 1), substring(v, p + 1))").alias("v"), (F.col("p") - 1).alias("at"))
        lengths = F.lit(None).cast("array<int>")
        for n in left:
            if ms := [m for m in left if m >= n and n - skip - left[m] == gone]:
                lengths = F.when(F.col("n") == n, F.array(*map(F.lit, ms))).otherwise(lengths)
        a = step.select("v", F.explode(lengths).alias("m"), "n", F.col("low").alias("a"))
        b = step.where(F.col("n").isin([m for m in left if m - skip - left[m] == gone])).select("v", F.col("n").alias("m"), F.col("low").alias("b"))
        for side, df in (("a", a), ("b", b)):
            sides[side] = df if side not in sides else sides[side].unionByName(df)
    if not sides:
        return own.select(F.col("low").alias("a"), F.col("low").alias("b")).limit(0)
    a, b = (x.repartition(parts, "v", "m") if parts else x for x in sides.values())
    return a.join(b, ["v", "m"]).where("n < m or a < b").select("a", "b")


def _by_segments(own: DataFrame, threshold: float, skip: int = 0) -> DataFrame:
    """(a, b) candidates among names (low, n) of which the longer has LONG characters at most and more than _short().

    A longer name of length m allows e = floor((1 - threshold) m) edits. Cut the shorter one into e + 1 segments: one of them stands in the longer name
    unchanged, shifted by so few places that there are at most e + 1 starts to try. So names meet by equality on (type, length, e, segment number,
    segment text), and only those that share a segment are compared.
    """
    edits = lambda m: F.floor(m * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    longest = F.least(F.lit(LONG), F.greatest(F.floor(F.col("n") / F.lit(threshold) + F.lit(1e-9)).cast("int"), F.col("n")))
    above = _short(threshold, skip)
    short = own.where(F.col("n") <= LONG).withColumn("longest", longest).where(F.col("longest") > above)
    short = short.withColumn("e", F.explode(F.array_distinct(F.transform(F.sequence(F.greatest(F.col("n"), F.lit(above + 1)), F.col("longest")), edits))))
    short = short.select(F.col("n").alias("na"), "e", F.col("low").alias("a"), F.explode(_segments(F.col("n"), F.col("e") + 1)).alias("s"))
    a = short.select("na", "e", "a", F.col("s.i").alias("i"), F.expr("substring(a, s.start + 1, s.size)").alias("part"))
    least = F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    long = own.where((F.col("n") <= LONG) & (F.col("n") > above)).withColumn("e", edits(F.col("n"))).withColumn("na", F.explode(F.sequence(least, F.col("n"))))
    long = long.select("*", F.explode(_segments(F.col("na"), F.col("e") + 1)).alias("s")).withColumn("more", F.col("n") - F.col("na"))
    first = F.greatest(F.lit(0), F.col("s.start") - F.floor((F.col("e") - F.col("more")) / 2)).cast("int")
    last = F.least(F.col("n") - F.col("s.size"), F.col("s.start") + F.floor((F.col("e") + F.col("more")) / 2)).cast("int")
    long = long.where((F.col("e") >= F.col("more")) & (first <= last)).select("*", F.explode(F.sequence(first, last)).alias("at"))
    b = long.select("na", "e", F.col("s.i").alias("i"), F.expr("substring(low, at + 1, s.size)").alias("part"), F.col("n").alias("nb"), F.col("low").alias("b")).distinct()
    return a.join(b, ["na", "e", "i", "part"]).where("na < nb or (na = nb and a < b)").select("a", "b")


def _by_rare_pairs(own: DataFrame, threshold: float) -> DataFrame:
    """(a, b) candidates among names of which the longer has more than LONG characters, by rows that grow with the length of a name.

    An edit changes two of a name's pairs of neighbouring characters at most, so two names e edits apart share all but 2 e of the longer one's. With pairs in one order for all names, rare
    ones first, each name's first 2 e + 1 (and one for the rounding of e at the next length) hold one that they share; it stands e places apart at most.
    """
    some = own.where(F.col("n") > F.floor(F.lit(LONG * threshold))).withColumn("e", F.floor(F.col("n") / F.lit(threshold) * F.lit(1 - threshold) + F.lit(1e-9)).cast("int"))
    chars = some.select("low", "n", "e", F.split("low", "").alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.concat(F.element_at("c", i), F.element_at("c", i + 1)))
    each = chars.select("low", "n", "e", F.posexplode(pairs).alias("at", "pair"))
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy("low", "pair").orderBy("at")))
    counts = each.groupBy("pair", "nth").agg(F.count(F.lit(1)).alias("seen"))
    rare = each.join(counts, ["pair", "nth"]).withColumn("rank", F.row_number().over(Window.partitionBy("low").orderBy("seen", "pair", "nth")))
    rare = rare.where(F.col("rank") <= 2 * F.floor(F.col("n") * F.lit(1 - threshold) + F.lit(1e-9)) + 3).select("low", "n", "e", "at", "pair", "nth")
    other = rare.select("pair", "nth", F.col("low").alias("b"), F.col("n").alias("nb"), F.col("at").alias("bt"))
    met = rare.withColumnRenamed("low", "a").join(other, ["pair", "nth"]).where((F.col("nb") > LONG) & ((F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("a") < F.col("b")))))
    return met.where((F.col("n") >= F.col("nb") * F.lit(threshold)) & (F.abs(F.col("at") - F.col("bt")) <= F.col("e"))).select("a", "b").distinct()


def similar_classes(entities: DataFrame, threshold: float = 0.7, kinds: list[str] = ("function", "class")) -> tuple[DataFrame, DataFrame]:
    """Names that are alike, without pairs of entities: (type, low, members) for each name in lower case, and (type, a, b, strength, pairs) for each two different ones
    with edit similarity above ``threshold``: ``pairs`` is how many pairs of entities they stand for. The members of a name are alike by definition."""
    own = entities.where(F.col("type").isin(list(kinds))).select("type", F.lower(F.coalesce("name", F.lit(""))).alias("low"))
    classes = cut(own.groupBy("type", "low").agg(F.count(F.lit(1)).alias("members")).withColumn("n", F.length("low")), "names")
    own = cut(classes.where("n > 0").select("low", "n").distinct(), "names")  # a name of several types is compared once
    ends = own.agg(F.min("low"), F.max("low"), F.max("n"), F.count(F.lit(1))).first()
    skip, longest = len(os.path.commonprefix([ends[0] or "", ends[1] or ""])), ends[2] or 0
    met = _by_variants(own, threshold, skip, math.ceil((ends[3] + 1) / NAMES))
    if longest > _short(threshold, skip):
        met = met.unionByName(_by_segments(own, threshold, skip))
    near = _near(met, threshold)
    if longest > LONG:
        near = near.unionByName(_near_long(_by_rare_pairs(own, threshold), threshold))
    met = cut(near.distinct(), "near").withColumn("strength", name_similarity(F.col("a"), F.col("b")))
    count = lambda x: classes.select("type", F.col("low").alias(x), F.col("members").alias(f"{x}_members"))
    met = met.join(count("a"), "a").join(count("b"), ["type", "b"])
    return classes.select("type", "low", "members"), met.select("type", "a", "b", "strength", (F.col("a_members") * F.col("b_members")).alias("pairs"))


def similar_names(entities: DataFrame, threshold: float = 0.7, kinds: list[str] = ("function", "class")) -> DataFrame:
    """Pairs of (ord, id, name, type) of one type with edit similarity above ``threshold``: those of similar_classes(), with their entities. Names that are empty are alike."""
    own = entities.where(F.col("type").isin(list(kinds))).select("type", "ord", "id", F.lower(F.coalesce("name", F.lit(""))).alias("low"))
    _, near = similar_classes(entities, threshold, kinds)
    side = lambda x, key: own.select("type", F.col("low").alias(key), F.col("ord").alias(f"{x}o"), F.col("id").alias(f"{x}i"))
    unlike = near.select("type", "a", "b", "strength").join(side("a", "a"), ["type", "a"]).join(side("b", "b"), ["type", "b"]).where("ao <> bo").select("ao", "ai", "bo", "bi", "strength")
    alike = pairs_within(own.select(F.struct("type", "low").alias("class"), "ord", "id"), "class")
    alike = alike.select(F.col("source.ord").alias("ao"), F.col("source.id").alias("ai"), F.col("target.ord").alias("bo"), F.col("target.id").alias("bi"), F.lit(1.0).alias("strength"))
    met = unlike.unionByName(alike)
    first = F.col("ao") < F.col("bo")
    met = met.select(F.when(first, F.col("ai")).otherwise(F.col("bi")).alias("source_id"), F.when(first, F.col("bi")).otherwise(F.col("ai")).alias("target_id"), "strength")
    return met.select(F.concat_ws("_", F.lit("similar"), "source_id", "target_id").alias("id"), "source_id", "target_id", F.lit("similar").alias("relationship_type"), "strength")


def shared_dependencies(uses: DataFrame) -> DataFrame:
    """(ord, id, token), one row per occurrence, to an edge for each pair of users of a token; a file that repeats a token pairs with itself."""
    many = uses.groupBy("token", "id").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("times"))
    many = cut(many.where("token is not null and id is not null"), "uses")
    many = many.select("*", F.concat_ws("_", F.lit("shared_dep"), "id").alias("head"), F.concat_ws("_", "id", "token").alias("tail"))  # the two parts of an edge's id, made once a user
    met = pairs_within(many.select("token", "ord", "id", "head", "tail"), "token")
    met = met.select("token", F.col("source.id").alias("source_id"), F.col("target.id").alias("target_id"), F.concat_ws("_", "source.head", "target.tail").alias("id"))
    met = met.unionByName(many.where("times > 1").select("token", F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.concat_ws("_", "head", "tail").alias("id")))
    return met.select("id", "source_id", "target_id", F.lit("shared_dependency").alias("relationship_type"), F.lit(0.6).alias("strength"), F.col("token").alias("shared_import"))
