"""Graph operators over entities (id, ...) and edges (source_id, target_id, relationship_type, strength).

Iterations keep a frontier or labels as DataFrames; each round is written to the shared folder, which ends its lineage. Nothing but
counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, drop, shared, small  # noqa: F401

# Levels of entity types.
C4 = {"context": ["project"], "containers": ["application", "service", "module"], "components": ["package", "namespace", "directory"], "code": ["file", "class", "function"]}
CYCLE_TYPES = ["imports", "calls", "uses"]
FRONTIER = 200_000  # ids that are broadcast


def c4_level(kind) -> F.Column:
    out = F.when(F.lit(False), F.lit(""))
    for level, kinds in C4.items():
        out = out.when(kind.isin(kinds), F.lit(level))
    return out


def valid_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = entities.select("id")
    out = edges.join(ids, edges["source_id"] == ids["id"], "left_semi")
    return out.join(ids.withColumnRenamed("id", "t"), F.col("target_id") == F.col("t"), "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) and (b, a) of each edge, once each."""
    return edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).where("a <> b").distinct()


def numbered(ids: DataFrame) -> DataFrame:
    """(id, n): a long for each distinct id, in the order of the ids, so that rounds compare and add up numbers in place of texts."""
    order = ids.where("id is not null").select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
    return cut(order.withColumn("n", F.monotonically_increasing_id()), "numbers")


def _by_number(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """(u, v): the edges between numbered ids other than loops."""
    ends = edges.where("source_id <> target_id").select(F.col("source_id").alias("s"), F.col("target_id").alias("t"))
    return ends.join(numbers.toDF("s", "u"), "s").join(numbers.toDF("t", "v"), "t").select("u", "v")


def related(edges: DataFrame, entities: DataFrame, entity_id: str, relationship_type: str | None = None) -> DataFrame:
    """Neighbours in both directions with their edges."""
    own = edges.where((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id))
    if relationship_type:
        own = own.where(F.col("relationship_type") == relationship_type)
    other = F.when(F.col("source_id") == entity_id, F.col("target_id")).otherwise(F.col("source_id"))
    return own.withColumn("other_id", other).join(entities.select(F.col("id").alias("other_id"), "name", "type"), "other_id")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree); a loop counts twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def central(edges: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """Entities of largest degree, least id on ties."""
    return degrees(edges).join(entities.select("id", "name", "type"), "id").orderBy(F.desc("degree"), "id").limit(limit)


def hubs(edges: DataFrame, entities: DataFrame, over: int = 5, limit: int | None = 5) -> DataFrame:
    """Entities with more than ``over`` outgoing edges."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("out_degree")).where(F.col("out_degree") > over).join(entities.select("id", "name", "type"), "id")
    return out.orderBy(F.desc("out_degree"), "id").limit(limit) if limit else out


def cycles(edges: DataFrame, size: int, kinds: list[str] = CYCLE_TYPES) -> DataFrame:
    """Directed closed walks of ``size`` (2 to 4) different entities, once each, least id first: e1, e2, ...

    Entities have an order by their number of edges, then id. A walk of three or four is looked for from the greatest of its entities only, over steps to lesser
    ones, so what is in between grows with the edges times the lesser degree of their ends, and a hub costs its edges and no pairs of them: of three, two
    steps are closed by an edge; of four, two steps out meet two steps back at the entity opposite.
    """
    step = edges.where(F.col("relationship_type").isin(kinds)).select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).where("s <> t").distinct()
    if size == 2:
        back = step.select(F.col("t").alias("e1"), F.col("s").alias("e2"))
        return step.select(F.col("s").alias("e1"), F.col("t").alias("e2")).where("e1 < e2").join(back, ["e1", "e2"], "left_semi")
    if size not in (3, 4):
        raise ValueError("cycles of 2, 3 or 4")
    step = cut(step, "steps")
    degree = small(cut(step.select(F.explode(F.array("s", "t")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")), "degrees"))
    ranked = step.join(degree.toDF("s", "ds"), "s").join(degree.toDF("t", "dt"), "t")
    ranked = cut(ranked.select(F.struct(F.col("ds").alias("d"), F.col("s").alias("id")).alias("s"), F.struct(F.col("dt").alias("d"), F.col("t").alias("id")).alias("t")), "ranked")
    first = ranked.where("t < s").select(F.col("s").alias("top"), F.col("t").alias("x"))
    out = first.join(ranked.select(F.col("s").alias("x"), F.col("t").alias("y")), "x").where("y < top")
    if size == 3:
        found = out.join(ranked.select(F.col("s").alias("y"), F.col("t").alias("top")), ["y", "top"], "left_semi").select(F.array("top.id", "x.id", "y.id").alias("e"))
    else:
        last = ranked.where("s < t").select(F.col("t").alias("top"), F.col("s").alias("z"))
        home = last.join(ranked.select(F.col("t").alias("z"), F.col("s").alias("y")), "z").where("y < top")
        found = out.join(home, ["top", "y"]).where("x <> z").select(F.array("top.id", "x.id", "y.id", "z.id").alias("e"))
    at = F.array_position("e", F.array_min("e"))
    turned = found.select(F.concat(F.slice("e", at, F.lit(size)), F.slice("e", F.lit(1), at - 1)).alias("e"))
    return turned.select(*[F.col("e")[i].alias(f"e{i + 1}") for i in range(size)])


def _ends(edges: DataFrame) -> DataFrame:
    """(a, b) both ways, written once, as each step of a walk reads it. Edges that repeat stay: a step takes the least neighbour, whatever their number."""
    ends = edges.where("source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return cut(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ends")


def _step(ends: DataFrame, frontier: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, parent): what is one edge beyond ``frontier`` (by, id), with its least neighbour there."""
    here = frontier.select(*by, F.col("id").alias("parent"))
    here = F.broadcast(here) if frontier.count() <= FRONTIER else here  # a small frontier goes to the edges, which stay where they are
    return ends.join(here, F.col("a") == F.col("parent")).groupBy(*by, F.col("b").alias("id")).agg(F.min("parent").alias("parent"))


def distances(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(id, distance, parent) of what is reached from the ids of ``start`` in at most ``max_depth`` steps, both directions. Stops early
    when nothing is new."""
    seen = frontier = cut(start.select("id", F.lit(0).cast("bigint").alias("distance"), F.lit(None).cast("string").alias("parent")))
    ends = _ends(edges)
    for depth in range(1, max_depth + 1):
        new = _step(ends, frontier, []).join(seen.select("id"), "id", "left_anti")
        frontier = cut(new.select("id", F.lit(depth).cast("bigint").alias("distance"), "parent"))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 5) -> DataFrame:
    """(source, target, step, id): a shortest path of each distinct pair (source, target) with one of at most ``max_depth`` edges; ids need not be entities.

    All pairs walk together, from both ends in turn, so a side goes half the way only: labels (pair, id) with the step that reached them. A pair is met
    when a label of one side is one of the other; of the places where the sides meet the least id counts, and from there the path goes back by least parents on either
    side. A pair that is met, or has a side without anything new, walks no further. The edges are written once.
    """
    asked = cut(pairs.where("source is not null and target is not null").select("source", "target").distinct().withColumn("pair", F.struct("source", "target")), "pairs")
    ends, zero = _ends(edges), F.lit(0).cast("int")
    seen = {x: cut(asked.select("pair", F.col(x).alias("id"), zero.alias("depth"), F.lit(None).cast("string").alias("parent"))) for x in ("source", "target")}
    frontier, met, at = dict(seen), None, {"source": 0, "target": 0}

    def meetings() -> DataFrame:
        both = seen["source"].select("pair", "id", F.col("depth").alias("s")).join(seen["target"].select("pair", "id", F.col("depth").alias("t")), ["pair", "id"])
        return both.groupBy("pair").agg(F.min(F.struct((F.col("s") + F.col("t")).alias("n"), "id", "s", "t")).alias("m"))

    for step in range(max_depth + 1):
        met = cut(meetings())
        if step == max_depth:
            break
        side = "source" if step % 2 == 0 else "target"
        at[side] += 1
        open_ = frontier[side].join(met.select("pair"), "pair", "left_anti")
        new = _step(ends, open_, ["pair"]).join(seen[side].select("pair", "id"), ["pair", "id"], "left_anti")
        frontier[side] = cut(new.select("pair", "id", F.lit(at[side]).alias("depth"), "parent"))
        if not frontier[side].limit(1).count():
            met = cut(meetings())
            break
        seen[side] = seen[side].unionByName(frontier[side])
    here = met.select("pair", F.col("m.s").alias("s"), F.col("m.id").alias("id"))
    places = [here.select("pair", F.col("s").alias("step"), "id")]
    for side, turn in (("source", -1), ("target", 1)):
        now = here.select("pair", F.col("s").alias("step"), "id")
        for _ in range(at[side]):
            now = now.join(seen[side].select("pair", "id", "parent"), ["pair", "id"]).where("parent is not null").select("pair", (F.col("step") + turn).alias("step"), F.col("parent").alias("id"))
            places.append(now)
    out = places[0]
    for p in places[1:]:
        out = out.unionByName(p)
    return out.select("pair.source", "pair.target", F.col("step").cast("bigint").alias("step"), "id")


def shortest_path(edges: DataFrame, entities: DataFrame, source: str, target: str, max_depth: int = 5) -> DataFrame:
    """(step, id) of a shortest path between two entities; no row if there is none or an end is no entity. It may pass ids that
    are no entities, which are left out of the rows: the steps then have gaps."""
    ends = entities.where(F.col("id") == source).select(F.col("id").alias("source")).join(entities.where(F.col("id") == target).select(F.col("id").alias("target"))).distinct()
    return shortest_paths(edges, ends, max_depth).select("step", "id").join(entities.select("id"), "id", "left_semi").select("step", "id")


def neighborhood(edges: DataFrame, entities: DataFrame, centre: str, depth: int = 2, include_centre: bool = True) -> DataFrame:
    """Entities within ``depth`` steps; the centre counts from depth 2 on if it has a neighbour, as one comes back to it."""
    found = distances(edges, entities.where(F.col("id") == centre).select("id"), depth)
    others = found.where("distance > 0")
    if include_centre and depth >= 2 and others.limit(1).count():
        others = found
    return others.select("id", "distance").join(entities.select("id", "name", "type"), "id")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node that are larger (``large``), or those that are smaller, at its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, entities: DataFrame, min_size: int = 1) -> DataFrame:
    """(id, component, size): components of the undirected graph with at least ``min_size`` entities, named by their least id. Large and small
    stars in turn on the edges only, until a round changes nothing; the tables of a round go when the next one is written."""
    numbers = numbered(entities)
    now, state = cut(_by_number(edges, numbers).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        nxt = cut(_star(_star(now, True), False))
        drop(now)
        now = nxt
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == state:
            break
        state = mark
    label = numbers.join(now.withColumnRenamed("u", "n"), "n", "left").select("id", F.coalesce("v", "n").alias("c"))
    sizes = label.groupBy("c").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    named = sizes.join(numbers.select(F.col("n").alias("c"), F.col("id").alias("component")), "c")
    return label.join(named, "c").select("id", "component", "size")


def similar_by_edges(edges: DataFrame, entities: DataFrame, entity_id: str, threshold: float = 0.7, limit: int = 10, kind: str = "similar") -> DataFrame:
    """Neighbours over ``kind`` edges of at least ``threshold``, strongest first."""
    return related(edges, entities, entity_id, kind).where(F.col("strength") >= threshold).select("other_id", "strength").orderBy(F.desc("strength"), "other_id").limit(limit)


def _least_within(ends: DataFrame, values: DataFrame, steps: int) -> DataFrame:
    """(id, x): the least x among an id and what is ``steps`` edges away at most. Values go from neighbour to neighbour, so a hub costs its edges and no pairs of them."""
    for _ in range(steps):
        far = ends.join(values.select(F.col("id").alias("b"), "x"), "b").groupBy(F.col("a").alias("id")).agg(F.min("x").alias("x"))
        values = cut(far.unionByName(values).groupBy("id").agg(F.min("x").alias("x")), "least")
    return values


def greedy_clusters(edges: DataFrame, entities: DataFrame, min_size: int = 3) -> DataFrame:
    """(cluster, id, size): entities in the order of their ids; one that is not taken yet and has at least ``min_size`` walks of one or two edges
    takes what is not taken within two steps. Clusters under ``min_size`` are left out, though what they took stays taken.

    Seeds are the entities with enough walks that no earlier seed reaches: the lexicographically first independent set of the square of the graph. In a round those
    that are the least undecided within two steps become seeds, and what they reach is decided. The rest belongs to its least seed. The square is never made.
    """
    numbers = numbered(entities)
    ends = _by_number(edges, numbers).toDF("a", "b")
    ends = cut(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))), "walks")
    degree = ends.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("d"))
    open_ = cut(ends.join(degree, "b").groupBy(F.col("a").alias("id")).agg(F.sum("d").alias("walks")).where(F.col("walks") >= min_size).select("id"), "open")
    one, seeds = cut(ends.distinct(), "ends"), None
    own = lambda df: df.select("id", F.col("id").alias("x"))
    while open_.limit(1).count():
        least = _least_within(one, own(open_), 2)
        now = cut(open_.join(least.where("id = x").select("id"), "id", "left_semi"), "seeds")
        open_ = cut(open_.join(_least_within(one, own(now), 2).select("id"), "id", "left_anti"), "open")
        seeds = now if seeds is None else seeds.unionByName(now)
    if seeds is None:
        return edges.sparkSession.createDataFrame([], "cluster string, id string, size long")
    all_ = _least_within(one, own(seeds), 2).select("x", F.col("id").alias("n"))
    sizes = all_.groupBy("x").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    named = sizes.join(numbers.select(F.col("n").alias("x"), F.col("id").alias("cluster")), "x")
    return all_.join(named, "x").join(numbers, "n").select("cluster", "id", "size")


def upsert(rows: DataFrame, key: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Last value and first place of each key."""
    seq = F.struct(*order)
    return rows.groupBy(*key).agg(F.min(seq).alias("first_at"), F.max_by(F.struct(*value), seq).alias("v")).select(*key, *[F.col(f"first_at.{c}").alias(f"first_{c}") for c in order], *[F.col(f"v.{c}") for c in value])


def top_per(rows: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)
