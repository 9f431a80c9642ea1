"""Queries on file listings: scans, filters, priorities, upserts, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph
from ..operators.project import MARKERS, size_advice
from ..sources.knowledge import matching
from .base import FILES, PAGE_FILES, files, page_files, table
from .catalog import query

NAME, EXT = "regexp_extract(path, '([^/]*)$', 1)", "regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)"
# Words that make a path important, or a configuration file.
IMPORTANT = ["main", "index", "app", "server", "client", "core", "base"]
CONFIG = ["config", "settings", "env", "package.json", "requirements.txt", "setup.py"]
EXTENSIONS = [".py", ".js", ".ts", ".java", ".cpp", ".c", ".cs", ".go", ".rs"]

def _any(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query(f"with {PAGE_FILES} select page_id, path, {NAME} as name, {EXT} as extension from page_files")
def scan_pages(spark, d):
    p = F.col("path")
    return page_files(spark, d).select("page_id", "path", T.base_name(p).alias("name"), T.suffix(p).alias("extension"))


@query(f"with {FILES}, probe as (select source||'/en/0/'||n_nationkey||'.txt' as path from nation, (select distinct source from documents)) select path, path in (select path from files) as found from probe")
def path_exists(spark, d):
    probe = table(spark, d, "documents").select("source").distinct().join(F.broadcast(table(spark, d, "nation").select("n_nationkey")))
    probe = probe.select(F.concat("source", F.lit("/en/0/"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"))
    return probe.join(files(spark, d).select("path", F.lit(True).alias("hit")).distinct(), "path", "left").select("path", F.coalesce("hit", F.lit(False)).alias("found"))


@query("select page_id, url from pages where regexp_matches(url, '(?s)^https://.*\\.example\\.net/.n/.*[05]$')")
def glob_search(spark, d):
    return table(spark, d, "pages").select("page_id", "url").where(F.col("url").rlike(T.glob_to_regex("https://*.example.net/?n/*[05]")))


@query(f"with {PAGE_FILES} select page_id, path from page_files where not list_has_any(list_slice(string_split(path, '/'), 1, -2), ['de', 'fr']) and {EXT} not in ('.html', '.log')")
def exclude_filter(spark, d):
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return page_files(spark, d).where(~F.arrays_overlap(folders, F.array(F.lit("de"), F.lit("fr"))) & ~T.suffix(F.col("path")).isin(".html", ".log"))


@query("""with x as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, count(*) as n from x where regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' and line not like '#%' group by doc_id""")
def repo_list(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where((T.strip(F.col("line")) != "") & ~F.startswith("line", F.lit("#"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("select source as repo, count(*) as files, cast(sum(n_chars) as bigint) as total, count(distinct lang) as languages from documents group by source")
def batch_summary(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("repo")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("total"), F.count_distinct("lang").alias("languages"))


@query("select event_type, arg_max(event_id, (ts, event_id)) as latest from events group by event_type")
def latest_artifact(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("select user_id, min(event_id) as first_event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def entity_upsert(spark, d):
    return graph.upsert(table(spark, d, "events"), ["user_id"], ["event_id"], ["event_type", "value"])


@query("select user_id, event_type, min(event_id) as first_event_id, arg_max(value, event_id) as value from events group by user_id, event_type")
def relationship_upsert(spark, d):
    return graph.upsert(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"], ["value"])


@query("select doc_id, source from documents where contains(lower(text), 'license') or contains(lower(source), 'license')")
def search_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("name"), F.col("source").alias("path"), F.col("text").alias("content"))
    return matching(docs, "license").select("doc_id", F.col("path").alias("source"))


@query("select doc_id, source from documents where (contains(lower(source), 'src1') or contains(lower(substr(text, 1, 1000)), 'license')) and lang = 'en' order by doc_id limit 50")
def search_text_limited(spark, d):
    low = F.contains(F.lower("source"), F.lit("src1")) | F.contains(F.lower(F.substring("text", 1, 1000)), F.lit("license"))
    return table(spark, d, "documents").where(low & (F.col("lang") == "en")).select("doc_id", "source").orderBy("doc_id").limit(50)


@query("select source, lang, count(*) as n, string_agg(cast(doc_id as varchar), ',' order by doc_id) as ids from documents group by source, lang")
def entities_by_file(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


@query(f"with {PAGE_FILES} select page_id, path from page_files where {_any('lower(path)', IMPORTANT)} order by page_id limit 20")
def important_files(spark, d):
    return page_files(spark, d).where(T.any_of(F.lower("path"), IMPORTANT)).orderBy("page_id").limit(20)


_RANK = f"case when {_any('lower(path)', IMPORTANT)} then 0 when {_any('lower(path)', CONFIG)} then 1 when {EXT} = '.html' then 2 end"


@query(f"with {PAGE_FILES} select path, min({_RANK}) as rank, min(page_id) as ord from page_files where {_RANK} is not null group by path")
def prioritize_files(spark, d):
    low = F.lower("path")
    rank = F.when(T.any_of(low, IMPORTANT), 0).when(T.any_of(low, CONFIG), 1).when(T.suffix(F.col("path")) == ".html", 2)
    return page_files(spark, d).withColumn("rank", rank).where("rank is not null").groupBy("path").agg(F.min("rank").alias("rank"), F.min("page_id").alias("ord"))


@query(f"with {PAGE_FILES} select case when {EXT} = '' then 'no_extension' else {EXT} end as extension, count(*) as files, cast(sum(length(path)) as bigint) as total from page_files group by 1")
def repository_stats(spark, d):
    ext = T.suffix(F.col("path"))
    return page_files(spark, d).groupBy(F.when(ext == "", "no_extension").otherwise(ext).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("path")).alias("total"))


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 10")
def largest_files(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


_TECH = {"en": "English", "de": "German", "fr": "French"}


@query("select case lang when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' end as technology, lang as extension, count(*) as file_count from documents where lang in ('en', 'de', 'fr') group by lang")
def technology_overview(spark, d):
    docs = table(spark, d, "documents").groupBy(F.col("lang").alias("extension")).agg(F.count(F.lit(1)).alias("file_count"))
    return docs.select(T.lookup(_TECH, F.col("extension")).alias("technology"), "extension", "file_count").where("technology is not null")


@query(f"""with m as (select * from (values {', '.join(f"({i}, '{m[1]}', '{m[2]}', 'src{i}')" for i, m in enumerate(MARKERS))}) v(rule_no, category, value, marker))
  select category, arg_max(value, rule_no) as value from m where marker in (select source from documents) group by category""")
def project_structure(spark, d):
    """Markers stand for themselves as the sources src0, src1, ..."""
    rules = spark.createDataFrame([(i, m[1], m[2], f"src{i}") for i, m in enumerate(MARKERS)], "rule_no int, category string, value string, marker string")
    here = table(spark, d, "documents").select(F.col("source").alias("marker")).distinct()
    return rules.join(here, "marker", "left_semi").groupBy("category").agg(F.max_by("value", "rule_no").alias("value"))


@query("""with x as (select source, count(*) as n, mode(lang order by lang) as lang0 from documents group by source)
  select source, [case when n < 50 then 'Small project: Start with main entry points and core modules' when n < 500 then 'Medium project: Focus on directory structure and key components' else 'Large project: Begin with documentation and configuration files' end][1] as suggestion from x""")
def suggestions(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", size_advice(F.col("n")).alias("suggestion"))


@query(f"with {PAGE_FILES} select regexp_extract(path, '^([^/]*)', 1) as folder, count(*) as files, count(distinct regexp_extract(path, '^[^/]*/([^/]*)/', 1)) as subfolders from page_files group by 1")
def dir_structure(spark, d):
    p = page_files(spark, d)
    return p.groupBy(F.regexp_extract("path", "^([^/]*)", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct(F.regexp_extract("path", "^[^/]*/([^/]*)/", 1)).alias("subfolders"))


_FOCUS = [("data_layer", "*example.net*"), ("api_structure", "*example.com/en*"), ("project_overview", "*.html")]


@query(f"""with {PAGE_FILES}, f as (select * from (values ('data_layer', '.*example[.]net.*'), ('api_structure', '.*example[.]com/en.*'), ('project_overview', '.*[.]html')) v(focus, pattern))
  select focus, page_id, path from page_files join f on regexp_full_match(path, pattern)""")
def focus_files(spark, d):
    p = page_files(spark, d)
    hit = F.array_compact(F.array(*[F.when(F.col("path").rlike(T.glob_to_regex(g)), F.lit(f)) for f, g in _FOCUS]))
    return p.select(F.explode(hit).alias("focus"), "page_id", "path")


@query("select lang, count(*) as n from documents group by lang")
def languages_used(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
