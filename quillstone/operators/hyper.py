"""Relationships that join all members of a group, kept as groups: rows (grp, id, ord, times), one for each member.

A package of n files or a token that n files import stands for n (n - 1) / 2 edges. Counts, degrees, components and neighbourhoods of those edges follow from the groups, in
work that grows with the members; pairs() makes the edges where somebody wants them. A member that a group has more than once (``times``) stands for a loop too.

Edge cases: null groups and ids are left out; ids that are no entities count for degrees, as edges without an end do, but join no components; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .scratch import cut, small


def by_token(uses: DataFrame) -> DataFrame:
    """(ord, id, token), one row per occurrence, to the users of each token."""
    kept = uses.where("token is not null and id is not null")
    return kept.groupBy(F.col("token").alias("grp"), "id").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("times"))


def by_package(files: DataFrame) -> DataFrame:
    """(ord, id, path) to the files of each package: the first two parts of their path."""
    parts = F.filter(F.split("path", "/"), lambda x: (x != "") & (x != "."))
    return files.where(F.size(parts) > 1).select(F.array_join(F.slice(parts, 1, 2), "/").alias("grp"), "id", "ord", F.lit(1).cast("long").alias("times"))


def sizes(members: DataFrame) -> DataFrame:
    """(grp, members, pairs): how many edges a group stands for, loops included."""
    n, loops = F.count(F.lit(1)), F.count_if(F.col("times") > 1)
    out = members.groupBy("grp").agg(n.alias("members"), loops.alias("loops"))
    return out.select("grp", "members", (F.expr("members * (members - 1) div 2") + F.col("loops")).alias("pairs"))


def degrees(members: DataFrame) -> DataFrame:
    """(id, degree) over the edges of all groups; a loop counts twice."""
    known = small(cut(sizes(members).select("grp", "members"), "sizes"))
    own = F.col("members") - 1 + F.when(F.col("times") > 1, 2).otherwise(0)
    return members.join(known, "grp").groupBy("id").agg(F.sum(own).alias("degree")).where("degree > 0")


def central(edges: DataFrame | None, members: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """Entities of largest degree over plain edges and groups, least id on ties."""
    all_ = degrees(members)
    if edges is not None:
        all_ = all_.unionByName(graph.degrees(edges)).groupBy("id").agg(F.sum("degree").alias("degree"))
    return all_.join(entities.select("id", "name", "type"), "id").orderBy(F.desc("degree"), "id").limit(limit)


def stars(members: DataFrame) -> DataFrame:
    """(source_id, target_id): each member and the least of its group; what reaches what is as with all pairs."""
    least = small(cut(members.groupBy("grp").agg(F.min("id").alias("target_id")), "least"))
    return members.join(least, "grp").select(F.col("id").alias("source_id"), "target_id").where("source_id <> target_id").distinct()


def components(edges: DataFrame | None, members: DataFrame, entities: DataFrame, min_size: int = 1) -> DataFrame:
    """(id, component, size) of the graph of plain edges and groups."""
    own = stars(members.join(entities.select("id"), "id", "left_semi"))
    if edges is not None:
        own = own.unionByName(edges.select("source_id", "target_id"))
    return graph.components(own, entities, min_size)


def distances(edges: DataFrame | None, members: DataFrame, centre: str, max_depth: int) -> DataFrame:
    """(id, distance) of what is reached from ``centre`` by plain edges and groups. A group is entered once, as all its members are reached with it."""
    spark = members.sparkSession
    seen = frontier = cut(spark.range(1).select(F.lit(centre).alias("id"), F.lit(0).cast("long").alias("distance")))
    entered = None
    for depth in range(1, max_depth + 1):
        here = frontier.select("id")
        groups = members.join(here, "id", "left_semi").select("grp").distinct()
        groups = cut(groups if entered is None else groups.join(entered, "grp", "left_anti"))
        new = members.join(small(groups), "grp", "left_semi").select("id")
        if edges is not None:
            for a, b in (("source_id", "target_id"), ("target_id", "source_id")):
                new = new.unionByName(edges.join(here, F.col(a) == F.col("id"), "left_semi").select(F.col(b).alias("id")))
        entered = groups if entered is None else entered.unionByName(groups)
        frontier = cut(new.distinct().join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).cast("long").alias("distance")))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def pairs(members: DataFrame, kind: str, strength: Column, of: Column | None = None) -> DataFrame:
    """(id, source_id, target_id, relationship_type, strength): the edges of all groups, or of those where ``of`` is true; the lower ord is the source."""
    own = members if of is None else members.where(of)
    a, b = (own.select("grp", F.col("id").alias(f"{x}_id"), F.col("ord").alias(f"{x}_ord"), F.col("times").alias(f"{x}_times")) for x in ("source", "target"))
    met = a.join(b, "grp").where("source_ord < target_ord or (source_id = target_id and source_times > 1)")
    return met.select(F.concat_ws("_", F.lit(kind), "source_id", "target_id", "grp").alias("id"), "source_id", "target_id", F.lit(kind).alias("relationship_type"), strength.alias("strength"))
