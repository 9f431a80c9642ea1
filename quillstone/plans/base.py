"""Views that queries share: the property graph and the file table over the given tables, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda df, key, name, kind, path: df.select(key.alias("id"), name.alias("name"), F.lit(kind).alias("type"), path.alias("path"))
    c = F.col
    key = lambda letter, col: F.concat(F.lit(letter), c(col).cast("string"))
    up = F.concat_ws("/", "r_name", "n_name")
    return (
        one(t("region"), key("r", "r_regionkey"), c("r_name"), "project", c("r_name"))
        .unionByName(one(place, key("n", "n_nationkey"), c("n_name"), "service", up))
        .unionByName(one(t("supplier").join(place, c("s_nationkey") == c("n_nationkey")), key("s", "s_suppkey"), c("s_name"), "package", F.concat_ws("/", up, "s_name")))
        .unionByName(one(t("customer").join(place, c("c_nationkey") == c("n_nationkey")), key("c", "c_custkey"), c("c_name"), "function", F.concat_ws("/", up, "c_name")))
        .unionByName(one(t("part"), key("p", "p_partkey"), c("p_name"), "class", F.concat_ws("/", "p_brand", "p_type", "p_name")))
    )


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    key = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    edge = lambda df, s, x, kind, w: df.select(s.alias("source_id"), x.alias("target_id"), F.lit(kind).alias("relationship_type"), F.lit(w).alias("strength"))
    line = t("lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    uses = line.where("l_returnflag = 'N'").select("l_suppkey", "l_partkey").distinct()
    calls = line.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    out = (
        edge(t("nation"), key("r", "n_regionkey"), key("n", "n_nationkey"), "contains", 1.0)
        .unionByName(edge(t("supplier"), key("n", "s_nationkey"), key("s", "s_suppkey"), "contains", 1.0))
        .unionByName(edge(t("customer"), key("n", "c_nationkey"), key("c", "c_custkey"), "contains", 1.0))
        .unionByName(edge(uses, key("s", "l_suppkey"), key("p", "l_partkey"), "uses", 0.8))
        .unionByName(edge(calls, key("p", "l_partkey"), key("s", "l_suppkey"), "calls", 0.8))
    )
    return out.withColumn("id", F.concat("source_id", F.lit("-"), "relationship_type", F.lit("->"), "target_id"))


GRAPH = """
 ents as (select 'r'||r_regionkey as id, r_name as name, 'project' as type, r_name as path from region
  union all select 'n'||n_nationkey, n_name, 'service', r_name||'/'||n_name from nation join region on n_regionkey=r_regionkey
  union all select 's'||s_suppkey, s_name, 'package', r_name||'/'||n_name||'/'||s_name from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey
  union all select 'c'||c_custkey, c_name, 'function', r_name||'/'||n_name||'/'||c_name from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
  union all select 'p'||p_partkey, p_name, 'class', p_brand||'/'||p_type||'/'||p_name from part),
 edges0 as (select 'r'||n_regionkey as source_id, 'n'||n_nationkey as target_id, 'contains' as relationship_type, cast(1.0 as double) as strength from nation
  union all select 'n'||s_nationkey, 's'||s_suppkey, 'contains', cast(1.0 as double) from supplier
  union all select 'n'||c_nationkey, 'c'||c_custkey, 'contains', cast(1.0 as double) from customer
  union all select distinct 's'||l_suppkey, 'p'||l_partkey, 'uses', cast(0.8 as double) from lineitem where l_returnflag='N'
  union all select distinct 'p'||l_partkey, 's'||l_suppkey, 'calls', cast(0.8 as double) from lineitem where l_returnflag='R'),
 edges as (select *, source_id||'-'||relationship_type||'->'||target_id as id from edges0),
 both_ways as (select distinct a, b from (select source_id as a, target_id as b from edges union all select target_id, source_id from edges) where a <> b)
"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files."""
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.pmod("doc_id", F.lit(5)).cast("string")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("ord"), path.alias("path"), "text", "lang", "source", "n_chars")


FILES = " files as (select doc_id as ord, source||'/'||lang||'/'||(doc_id % 5)||'/'||doc_id||'.txt' as path, text, lang, source, n_chars from documents) "


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: the URL without scheme, query and fragment."""
    pages = table(spark, d, "pages").select("page_id", "url")
    return pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


PAGE_FILES = " page_files as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages) "


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The last user turn of each conversation."""
    users = table(spark, d, "conversations").where("role = 'user'")
    return users.groupBy("conv_id").agg(F.max_by(F.col("text"), F.struct("turn", "text")).alias("question"))


QUESTIONS = " questions as (select conv_id, arg_max(text, (turn, text)) as question from conversations where role = 'user' group by conv_id) "
