"""Queries over the property graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import embedding
from ..operators import graph
from ..sources.knowledge import create, statistics
from .base import GRAPH, graph_edges, graph_entities, table
from .catalog import query

C4_SQL = "case " + " ".join(f"when type in ({', '.join(repr(k) for k in kinds)}) then '{level}'" for level, kinds in graph.C4.items()) + " end"


@query(f"""with {GRAPH}, a as (select 'entity_type' as kind, type as name, count(*) as n from ents group by type
  union all select 'relationship_type', relationship_type, count(*) from edges group by relationship_type)
  select * from a union all select 'total', kind, cast(sum(n) as bigint) from a group by kind""")
def kb_statistics(spark, d):
    return statistics(graph_entities(spark, d), graph_edges(spark, d))


@query(f"with {GRAPH} select id, name, type, path from ents where id = 'n3'")
def get_entity(spark, d):
    return graph_entities(spark, d).where("id = 'n3'")


@query(f"with {GRAPH} select id, {C4_SQL} as c4_level from ents where {C4_SQL} is not null")
def c4_mapping(spark, d):
    return graph_entities(spark, d).select("id", graph.c4_level(F.col("type")).alias("c4_level")).where("c4_level is not null")


@query(f"with {GRAPH} select {C4_SQL} as c4_level, count(*) as n from ents where {C4_SQL} is not null group by 1")
def c4_counts(spark, d):
    return c4_mapping(spark, d).groupBy("c4_level").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {GRAPH} select * from edges where source_id in (select id from ents) and target_id in (select id from ents)")
def valid_edges(spark, d):
    return graph.valid_edges(graph_edges(spark, d), graph_entities(spark, d))


@query(f"""with {GRAPH} select r.id as edge_id, relationship_type, strength, e.id as other_id, e.name, e.type from edges r
  join ents e on e.id = case when source_id = 's1' then target_id else source_id end where source_id = 's1' or target_id = 's1'""")
def related_entities(spark, d):
    got = graph.related(graph_edges(spark, d), graph_entities(spark, d), "s1")
    return got.select(F.col("id").alias("edge_id"), "relationship_type", "strength", "other_id", "name", "type")


@query(f"with {GRAPH} select id, name, type, path from ents")
def kb_roundtrip(spark, d):
    kb = create(spark, "text", f"{graph.shared(spark)}/kb-{uuid.uuid4().hex}")
    none = {name: F.lit(None).cast(kind) for name, kind in (("content", "string"), ("language", "string"), ("size", "bigint"), ("created_at", "timestamp_ntz"), ("metadata", "map<string,string>"))}
    kb.add(graph_entities(spark, d).withColumns({"ord": F.xxhash64("id")} | none))
    kb.save()
    return create(spark, "text", kb.path).entities.select("id", "name", "type", "path")


@query(f"""with {GRAPH}, deg as (select id, count(*) as degree from (select source_id as id from edges union all select target_id from edges) group by id)
  select id, degree, name, type from deg join ents using (id)""")
def degree_centrality(spark, d):
    return graph.degrees(graph_edges(spark, d)).join(graph_entities(spark, d).drop("path"), "id")


@query(f"""with {GRAPH}, deg as (select id, count(*) as degree from (select source_id as id from edges union all select target_id from edges) group by id)
  select id, degree, name, type from deg join ents using (id) order by degree desc, id limit 10""")
def topk_degree(spark, d):
    return graph.central(graph_edges(spark, d), graph_entities(spark, d), 10)


@query(f"""with {GRAPH}, h as (select source_id as id, count(*) as out_degree from edges group by 1 having count(*) > 5)
  select id, out_degree, name, type from h join ents using (id)""")
def hub_entities(spark, d):
    return graph.hubs(graph_edges(spark, d), graph_entities(spark, d), limit=None)


@query(f"""with {GRAPH}, st as (select distinct source_id as s, target_id as t from edges where relationship_type in ('imports', 'calls', 'uses') and source_id <> target_id)
  select a.s as e1, a.t as e2 from st a join st b on a.t = b.s and a.s = b.t where a.s < a.t""")
def circular_deps_2(spark, d):
    return graph.cycles(graph_edges(spark, d), 2)


@query(f"""with {GRAPH}, st as (select distinct source_id as s, target_id as t from edges where relationship_type in ('imports', 'calls', 'uses') and source_id <> target_id)
  select a.s as e1, a.t as e2, b.t as e3 from st a join st b on a.t = b.s join st c on b.t = c.s and c.t = a.s where a.s < a.t and a.s < b.t""")
def circular_deps_3(spark, d):
    return graph.cycles(graph_edges(spark, d), 3)


@query(f"""with recursive {GRAPH}, walk(id, distance) as (select id, cast(0 as bigint) from ents where id = 'r0' union select b, distance + 1 from walk join both_ways on id = a where distance < 3)
  select id, min(distance) as distance, any_value(name) as name, any_value(type) as type from walk join ents using (id) group by id""")
def neighborhood(spark, d):
    return graph.neighborhood(graph_edges(spark, d), graph_entities(spark, d), "r0", 3)


@query(f"""with recursive {GRAPH}, walk(id, distance) as (select id, cast(0 as bigint) from ents where id = 'c1' union select b, distance + 1 from walk join both_ways on id = a where distance < 5)
  select min(distance) as path_length from walk where id = 'p1' having count(*) > 0""")
def shortest_path(spark, d):
    path = graph.shortest_path(graph_edges(spark, d), graph_entities(spark, d), "c1", "p1", 5)
    return path.agg((F.count(F.lit(1)) - 1).alias("path_length")).where("path_length >= 0")


@query(f"""with recursive {GRAPH}, least as (select id, min(c) as c0 from (select id, id as c from ents union all select a, b from both_ways) group by id),
  roots as (select min(id) as root from ents), walk(id) as (select root from roots union select b from walk join both_ways on id = a),
  one as (select (select root from roots) as component, id from walk),
  rest as (select e.id, l.c0 as component from ents e join least l using (id) where e.id not in (select id from walk)),
  all_ as (select id, component from one union all select id, component from rest)
  select id, component, count(*) over (partition by component) as size from all_""")
def connected_components(spark, d):
    return graph.components(graph_edges(spark, d), graph_entities(spark, d))


@query(f"""with {GRAPH} select case when source_id = 's1' then target_id else source_id end as other_id, strength from edges
  where (source_id = 's1' or target_id = 's1') and relationship_type = 'uses' and strength >= 0.7 order by strength desc, other_id limit 10""")
def similar_by_edges(spark, d):
    return graph.similar_by_edges(graph_edges(spark, d), graph_entities(spark, d), "s1", 0.7, 10, "uses")


@query(f"with {GRAPH} select type, count(*) as n from ents group by type having count(*) > 1")
def type_groups_having(spark, d):
    return graph_entities(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"""with {GRAPH}, x as (select type, name, id, row_number() over (partition by type order by id) as k, count(*) over (partition by type) as n from ents)
  select type, max(n) as n, string_agg(name, ', ' order by id) filter (k <= 3) || case when max(n) > 3 then ' (and ' || (max(n) - 3) || ' more)' else '' end as summary from x group by type""")
def summarize_by_type(spark, d):
    ents = graph_entities(spark, d)
    first = graph.top_per(ents, ["type"], ["id"], 3).groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ", ").alias("names"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(" (and "), (F.col("n") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    return ents.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(first, "type").select("type", "n", F.concat("names", more).alias("summary"))


# vectors
DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double)))"


def _scores(spark, d, vec_id: int):
    """Scores of all vectors against one: the query is a single row."""
    vectors = table(spark, d, "embeddings")
    q = F.broadcast(vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q")))
    return vectors.join(q).select("vec_id", "label", F.round(embedding.dot(F.col("embedding"), F.col("q")), 5).alias("score"))


@query(f"select e.vec_id, e.label, round({DOT}, 5) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q order by score desc, e.vec_id limit 10")
def vector_topk(spark, d):
    return _scores(spark, d, 0).orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"select e.vec_id, e.label, round({DOT}, 5) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.label = 3 order by score desc, e.vec_id limit 10")
def vector_topk_filtered(spark, d):
    return _scores(spark, d, 0).where("label = 3").orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"select e.vec_id, e.label, round({DOT}, 5) as score from embeddings e, (select embedding from embeddings where vec_id = 7) q where e.vec_id <> 7 order by score desc, e.vec_id limit 5")
def vector_neighbors(spark, d):
    return _scores(spark, d, 7).where("vec_id <> 7").orderBy(F.desc("score"), "vec_id").limit(5)


@query("select count(*) as n, cast(max(len(embedding)) as bigint) as dim, cast(count(distinct label) as bigint) as labels from embeddings")
def embedding_stats(spark, d):
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).cast("bigint").alias("dim"), F.count_distinct("label").alias("labels"))


@query(f"""with {GRAPH}, raw as (select id, list_transform(range(96), lambda i: cast(('0x' || substr(md5(name || '_' || i), 1, 8)) as bigint)) as v from ents),
  normed as (select id, v, sqrt(list_sum(list_transform(v, lambda x: cast(x as double) * x))) as norm from raw)
  select id, round(v[1] / norm, 6) as first, round(v[96] / norm, 6) as last, cast(384 as bigint) as dim from normed""")
def hash_embedding(spark, d):
    made = graph_entities(spark, d).select("id", embedding.hash_embedding(F.col("name")).alias("v"))
    return made.select("id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[95], 6).alias("last"), F.size("v").cast("bigint").alias("dim"))


@query("select doc_id, 'Type: file Name: ' || doc_id || '.txt Language: ' || lang || ' Path: ' || source || ' Content: ' || substr(text, 1, 500) || ' chars: ' || n_chars || ' source: ' || source as entity_text from documents")
def entity_text(spark, d):
    docs = table(spark, d, "documents")
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("chars"), F.col("n_chars").cast("string"))
    return docs.select("doc_id", embedding.entity_text(F.lit("file"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("lang"), F.col("source"), F.col("text"), meta).alias("entity_text"))
