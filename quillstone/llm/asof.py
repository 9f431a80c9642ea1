"""As-of join with a tolerance: for each point the latest order of its key at or before it, at most ``tolerance`` earlier.

Points and orders meet by cogroup in shards of key and time. Time is cut into slots as wide as the tolerance, so a point's order is in its own
slot or in the one before: orders go to their own slot and, as a halo, to the next. Orders of one key and time are one run: their number, and the
winner by larger priority, then smaller id, nulls last. Runs are made in each task before anything is shuffled, and again in the shard.

Hot keys: a slot of a key with more than ``limit`` rows is cut into pieces of time, as many as keep to the limit. The halo of such a piece is the one
run that precedes it. Points of a piece that still has too many (equal times) are dealt out by a hash of their id, and the piece's few runs go to each share.
The list of such slots and pieces is what is broadcast; it holds at most some rows for each of PIECES pieces, since the limit grows with the input
once there would be more. Many small shards travel as one group, so that a call of Python handles thousands of rows; what several of them need counts once.

In a group numpy sorts the orders; searchsorted finds the right boundary of each point among the runs; the lengths of runs are the ties.

Edge cases: a point with a null key or time, and one without an order in reach, is unmatched: n_tied 0, the rest null. Rows of one point id (null
too) are copies and count once; where they differ, their least key and least time count, nulls only if there is nothing else. Orders with null
key or time match nothing; repeated orders are orders each. A null id of an order is reported as null. Empty tables give an empty result, or unmatched points.
Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import cut, named

DAY = 86_400_000_000
LIMIT = 4_096  # rows of a slot or piece, until the input has more than PIECES times as many
PIECES = 400_000
COMBINE = 1 << 18  # orders that a task turns into runs at once
RUN = "key long, t long, priority long, id long, value long, n long"
_FIELDS = ("key", "t", "priority", "id", "value", "n")


def micros(ts: str, df: DataFrame) -> Column:
    """Microseconds since 1970 of a column: of the instant, or for times without a zone of what the clock shows."""
    name = "`" + ts.replace("`", "``") + "`"
    if df.schema[ts].dataType.typeName() == "timestamp":
        return F.expr(f"unix_micros({name})")
    return F.expr(f"cast(cast(cast({name} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6)) * 1000000 as bigint)")


def floored(t: Column, width: int) -> Column:
    """``t`` less what it is beyond a multiple of ``width``."""
    return t - F.pmod(t, F.lit(width))


def coarse(t: Column, id_: Column, width: int = DAY) -> Column:
    """Times known to ``width`` only where the checksum of the id is odd."""
    return F.when(F.crc32(id_.cast("string")) % 2 == 1, floored(t, width)).otherwise(t)


class Runs:
    """Orders by key and time: winner and number of each run, in that order."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        self.columns, self.nulls = {}, {}
        for f in _FIELDS:
            col = table.column(f)
            self.nulls[f] = np.asarray(col.is_null())
            self.columns[f] = np.asarray(col.fill_null(0)).astype(np.int64)
        c, no = self.columns, self.nulls
        if "delivery" in table.column_names:  # a part of a run reaches a group once for each shard in it that needs it
            once = np.unique(np.asarray(table.column("delivery")), return_index=True)[1]
            c, no = {f: v[once] for f, v in c.items()}, {f: v[once] for f, v in no.items()}
        order = np.lexsort((c["value"], no["value"], c["id"], no["id"], ~c["priority"], no["priority"], c["t"], c["key"]))
        key, t = c["key"][order], c["t"][order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (t[1:] != t[:-1])])) if len(order) else np.zeros(0, np.int64)
        n = np.add.reduceat(c["n"][order], first) if len(first) else np.zeros(0, np.int64)
        self.columns = {f: v[order][first] for f, v in c.items()} | {"n": n}
        self.nulls = {f: v[order][first] for f, v in no.items()}

    def array(self, field: str, at: np.ndarray | None = None, missing: np.ndarray | None = None) -> pa.Array:
        """A field of all runs, or of those ``at``, null where ``missing``."""
        value, no = self.columns[field], self.nulls[field]
        if at is not None:
            at = np.where(missing, 0, at)
            value, no = (value[at], no[at]) if len(value) else (np.zeros(len(at), np.int64), np.ones(len(at), bool))
            no = no | missing
        return pa.array(value, pa.int64(), mask=no)

    def last(self, key: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The run of ``key`` that is latest at or before ``t``; -1 for none."""
        own, times = self.columns["key"], self.columns["t"]
        keys, moments = np.unique(own), np.unique(times)
        wide = len(moments) + 1
        places = np.searchsorted(keys, own) * wide + np.searchsorted(moments, times) + 1
        at = np.searchsorted(places, np.searchsorted(keys, key) * wide + np.searchsorted(moments, t, "right"), "right") - 1
        ok = at >= 0
        ok[ok] = own[at[ok]] == key[ok]
        return np.where(ok, at, -1)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(held):
        runs = Runs(pa.Table.from_batches(held))
        return pa.RecordBatch.from_arrays([runs.array(f) for f in _FIELDS], list(_FIELDS))

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= COMBINE:
            yield made(held)
            held, n = [], 0
    if held:
        yield made(held)


def _met(tolerance: int):
    def run(points: pa.Table, orders: pa.Table) -> pa.Table:
        runs = Runs(orders)
        key, t = np.asarray(points.column("key")), np.asarray(points.column("t"))
        at = runs.last(key, t)
        before = runs.columns["t"][np.maximum(at, 0)] if len(runs.columns["t"]) else np.zeros(len(t), np.int64)
        none = (at < 0) | (before < t - tolerance)
        n = runs.columns["n"][np.where(none, 0, at)] if len(runs.columns["n"]) else np.zeros(len(t), np.int64)
        return pa.table({
            "pid": points.column("pid"), "key": points.column("key"), "t": points.column("t"), "id": runs.array("id", at, none),
            "lag": pa.array(np.where(none, 0, t - before), pa.int64(), mask=none), "value": runs.array("value", at, none), "n_tied": pa.array(np.where(none, 0, n), pa.int64()),
        })

    return run


def hot_slots(points: DataFrame, runs: DataFrame, tolerance: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(key, slot, m, pieces: array of (j, shares)) of the slots with more than ``limit`` rows, and (key, carry, slot, j, shares): the pieces by the
    time of the run that precedes them. Both have a bounded number of rows."""
    slots = lambda df, also: df.select("key", "t", F.explode(F.array(*[F.expr(f"(t - pmod(t, {tolerance}L)) div {tolerance}L + {x}") for x in also])).alias("slot"))
    loads = slots(points, [0]).unionByName(slots(runs, [0, 1])).groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(cut(loads.where(F.col("n") > limit).select("key", "slot", F.ceil(F.col("n") / limit).cast("long").alias("m")), "hot"))
    own = lambda df, also: slots(df, also).join(hot, ["key", "slot"]).withColumn("j", piece(tolerance))
    cells = own(runs, [0, 1]).groupBy("key", "slot", "j").agg(F.max("t").alias("latest"))
    sizes = own(points, [0]).groupBy("key", "slot", "j").agg(F.count(F.lit(1)).alias("n"))
    all_ = hot.select("key", "slot", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"))
    all_ = all_.join(sizes, ["key", "slot", "j"], "left").select("key", "slot", "j", "m", F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / limit)).cast("long").alias("shares"))
    both = all_.withColumn("latest", F.lit(None).cast("long")).unionByName(cells.select("key", "slot", "j", F.lit(None).cast("long").alias("m"), F.lit(None).cast("long").alias("shares"), "latest"))
    before = Window.partitionBy("key", "slot").orderBy("j").rangeBetween(Window.unboundedPreceding, -1)
    pieces = cut(both.withColumn("carry", F.max("latest").over(before)).where("m is not null").drop("latest"), "pieces")
    listed = pieces.groupBy("key", "slot").agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("j", "shares"))).alias("pieces"))
    return listed, pieces.where("carry is not null").select("key", "carry", "slot", "j", "shares")


def piece(tolerance: int) -> Column:
    """Of a time in a slot cut into m; times before the slot have negative ones."""
    beyond = f"(t - slot * {tolerance}L) * m"
    return F.expr(f"({beyond} - pmod({beyond}, {tolerance}L)) div {tolerance}L")


def tolerant_join(points: DataFrame, orders: DataFrame, tolerance: int, limit: int | None = None) -> DataFrame:
    """``points`` (pid, key, t) and ``orders`` (key, t, priority, id, value), all long, times in any unit: one row per pid with key, t, the order's id
    and value, lag (t less the order's time) and n_tied (all orders of the key at that time)."""
    points = cut(points.groupBy("pid").agg(F.min("key").alias("key"), F.min("t").alias("t")), "points")
    longs = orders.where("key is not null and t is not null").select(*[F.col(f).cast("long").alias(f) for f in _FIELDS[:-1]], F.lit(1).cast("long").alias("n"))
    runs = cut(longs.mapInArrow(_combine, RUN).withColumn("delivery", F.monotonically_increasing_id()), "runs")
    whole = points.where("key is not null and t is not null")
    total = points.count() + 2 * runs.count()
    limit = limit or max(LIMIT, -(-total // PIECES))
    hot, carries = hot_slots(whole, runs, tolerance, limit)
    hot = F.broadcast(hot)
    groups = max(1, math.ceil(total / (2 * limit)))
    share_of = F.pmod(F.xxhash64("key", "slot", "j", "share"), F.lit(groups)).alias("g")
    at = F.expr(f"(t - pmod(t, {tolerance}L)) div {tolerance}L")
    found = F.when(F.col("m").isNull(), F.lit(0)).otherwise(piece(tolerance)).cast("long")
    shares = F.coalesce(F.expr("pieces[cast(j as int)].shares"), F.lit(1))
    left = whole.withColumn("slot", at).join(hot, ["key", "slot"], "left").withColumn("j", found)
    left = left.withColumn("share", F.pmod(F.xxhash64("pid", "t"), shares)).select(share_of, "pid", "key", "t")
    near = runs.select("*", F.explode(F.array(at, at + 1)).alias("slot")).join(hot, ["key", "slot"], "left").where((F.col("m").isNull()) | (F.col("slot") == at))
    near = near.withColumn("j", found).withColumn("shares", shares).select(*_FIELDS, "delivery", "slot", "j", "shares")
    carried = runs.join(F.broadcast(carries.withColumnRenamed("carry", "t")), ["key", "t"]).select(*_FIELDS, "delivery", "slot", "j", "shares")
    right = near.unionByName(carried).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")).select(share_of, *_FIELDS, "delivery")
    met = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_met(tolerance), "pid long, key long, t long, id long, lag long, value long, n_tied long")
    none = F.lit(None).cast("long")
    return met.unionByName(points.where("key is null or t is null").select("pid", "key", "t", none.alias("id"), none.alias("lag"), none.alias("value"), F.lit(0).cast("long").alias("n_tied")))


def shop_orders(sales: DataFrame) -> DataFrame:
    """(key, t, priority, id, value) of ``sales``: a row is an order of value in cents; where the checksum of its id is no multiple of 3 there is a twin
    at the same time, with id -1 - id and priority 6 - priority. A value that is no number of cents is null."""
    cents = F.floor(F.col("total") * 100 + 0.5)
    one = sales.select(
        F.col("client_id").cast("long").alias("key"), coarse(micros("sold_at", sales), F.col("sale_id")).alias("t"), F.col("priority").cast("long").alias("priority"),
        F.col("sale_id").cast("long").alias("id"), F.when(F.abs("total") < 9e16, cents).cast("long").alias("value"), (F.crc32(F.col("sale_id").cast("string")) % 3 != 0).alias("twin"),
    )
    own = F.struct("priority", "id")
    other = F.struct((6 - F.col("priority")).alias("priority"), (-1 - F.col("id")).alias("id"))
    return one.select("key", "t", "value", F.explode(F.when(F.col("twin"), F.array(own, other)).otherwise(F.array(own))).alias("x")).select("key", "t", "x.priority", "x.id", "value")


def shop_clicks(clicks: DataFrame) -> DataFrame:
    """(pid, key, t) of ``clicks``."""
    return clicks.select(F.col("click_id").cast("long").alias("pid"), F.col("client_id").cast("long").alias("key"), coarse(micros("ts", clicks), F.col("click_id")).alias("t"))


def match_clicks(clicks: DataFrame, sales: DataFrame, hours: int = 72) -> DataFrame:
    """One row per click_id: client_id, ts_us, sale_id, lag_us, total_cents, n_tied."""
    met = tolerant_join(shop_clicks(clicks), shop_orders(sales), hours * 3_600_000_000)
    return met.select(*[named(a).alias(b) for a, b in (("pid", "click_id"), ("key", "client_id"), ("t", "ts_us"), ("id", "sale_id"), ("lag", "lag_us"), ("value", "total_cents"), ("n_tied", "n_tied"))])
