"""Queries on relationships kept as groups, on vectors by cells, and on texts by their index."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells, hyper, search
from ..operators.scratch import cut, shared, small
from ..sources import grams
from .base import FILES, files, table
from .catalog import ORACLES, query
from .exploring import vector_knn_all  # noqa: F401  its SQL is that of vector_knn_cells too

USES = """ uses as (select page_id, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) as token from pages), m as (select token, page_id, count(*) as times from uses group by 1, 2),
  e as (select a.token, a.page_id as s, b.page_id as t from m a join m b on a.token = b.token and (a.page_id < b.page_id or (a.page_id = b.page_id and a.times > 1))) """
PHRASES = ["the", "tion and ", "ß", "qu", "heit.", "é", "no such phrase anywhere"]


def _users(spark, d) -> DataFrame:
    tokens = F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))).alias("token")
    return hyper.by_token(table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.col("page_id").cast("string").alias("id"), tokens))


@query(f"with {USES}, n as (select token, count(*) as members from m group by token), p as (select token, count(*) as pairs from e group by token) select token as grp, members, coalesce(pairs, 0) as pairs from n left join p using (token)")
def dependency_sizes(spark, d):
    return hyper.sizes(_users(spark, d))


@query(f"with {USES} select cast(id as varchar) as id, count(*) as degree from (select s as id from e union all select t from e) group by id")
def dependency_degrees(spark, d):
    return hyper.degrees(_users(spark, d))


@query(f"""with {USES}, b as (select s as a, t as b from e union select t, s from e), zero as (select min(page_id) as id from pages), one as (select distinct b as id from b, zero where a = zero.id),
  two as (select distinct b.b as id from b join one on a = one.id), all_ as (select id, 0 as n from zero union all select id, 1 from one union all select id, 2 from two)
  select cast(id as varchar) as id, cast(min(n) as bigint) as distance from all_ group by id""")
def dependency_neighborhood(spark, d):
    least = table(spark, d, "pages").agg(F.min("page_id").cast("string")).first()[0]
    return hyper.distances(None, _users(spark, d), least, 2)


@query(f"""with {FILES}, parts as (select ord, md5('file:' || path) as id, string_split(path, '/') as p from files),
  e as (select a.id as s, b.id as t from parts a join parts b on a.p[1] = b.p[1] and a.p[2] = b.p[2] and a.ord < b.ord)
  select id, count(*) as degree from (select s as id from e union all select t from e) group by id""")
def package_degrees(spark, d):
    return hyper.degrees(hyper.by_package(files(spark, d).select("ord", F.md5(F.concat(F.lit("file:"), F.col("path"))).alias("id"), "path")))


@query(ORACLES["vector_knn_all"])
def vector_knn_cells(spark, d):
    """The nearest vectors of those whose id is divisible by 100, exact, by cells."""
    rows = table(spark, d, "embeddings")
    made = cells.Cells(rows, "vec_id", "embedding", cells=64)  # more and smaller cells than by default
    return made.search(rows.where("vec_id % 100 = 0"), 5, "vec_id", "embedding", probes=4).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"with p as (select unnest({PHRASES}) as phrase) select phrase, doc_id from p join documents on contains(lower(coalesce(text, '')), phrase)")
def search_index(spark, d):
    """Each of some phrases, of one character to many, through an index of all texts that is written first."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    path = f"{shared(spark)}/grams-{uuid.uuid4().hex}"
    grams.write(grams.postings(docs, "doc_id", ["low"]), path)
    index = spark.read.schema(f"{grams.POSTINGS}, bucket int").parquet(path)

    def found(phrase: str) -> DataFrame:
        near = small(cut(grams.candidates(index, phrase), "candidates"))
        return docs.join(near, F.xxhash64("doc_id") == F.col("row"), "left_semi").where(F.contains("low", F.lit(phrase))).select(F.lit(phrase).alias("phrase"), "doc_id")

    return functools.reduce(DataFrame.unionByName, [found(p) for p in PHRASES])


@query("""with q as (select doc_id as conv_id, lower(substr(text, 11, 24)) as question from documents where doc_id % 100 = 0 and length(text) >= 34)
  select conv_id, doc_id from q join documents on contains(lower(text), question)""")
def search_passages(spark, d):
    """A passage of each document whose id is divisible by 100, in all documents."""
    docs = table(spark, d, "documents")
    asked = docs.where((F.col("doc_id") % 100 == 0) & (F.length("text") >= 34)).select(F.col("doc_id").alias("conv_id"), F.substring("text", 11, 24).alias("question"))
    return search.matches(asked, docs, "text", ["doc_id"])
