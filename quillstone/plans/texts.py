"""Queries on the lines and words of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from .base import FILES, files, table
from .catalog import query

# the same lines as functions.text.lines
LINES = "case when text = '' then [] when parts[-1] = '' then parts[1:-2] else parts end"
SPLIT = "string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')"
STRIP = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"


def _count(*starts: str) -> str:
    test = " or ".join(f"starts_with({STRIP}, '{s}')" for s in starts)
    return f"cast(len(list_filter(ls, lambda x: {test})) as bigint)"


@query(f"with {FILES} select md5('file:' || path) as id, path, substr(text, 1, 1000) as content, lang as language, n_chars as size, cast(length(text) as bigint) as char_count from files")
def file_entities(spark, d):
    return files(spark, d).select(F.md5(F.concat(F.lit("file:"), F.col("path"))).alias("id"), "path", F.substring("text", 1, 1000).alias("content"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.length("text").cast("bigint").alias("char_count"))


@query(f"with s as (select doc_id, text, {SPLIT} as parts from documents) select doc_id, cast(len({LINES}) as bigint) as n_lines, cast(length(text) as bigint) as n_chars from s")
def line_char_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.lines(F.col("text"))).cast("bigint").alias("n_lines"), F.length("text").cast("bigint").alias("n_chars"))


@query(f"with s as (select doc_id, text, {SPLIT} as parts from documents), l as (select doc_id, {LINES} as ls from s) select doc_id, cast(len(list_filter(ls, lambda x: {STRIP} = '')) as bigint) as blank_lines, {_count('#')} as comment_lines, {_count('import ', 'from ')} as imports, {_count('The ', 'La ')} as starts from l")
def code_patterns(spark, d):
    lines = T.lines(F.col("text"))
    blank = F.size(F.filter(lines, lambda x: T.strip(x) == "")).cast("bigint")
    return table(spark, d, "documents").select("doc_id", blank.alias("blank_lines"), T.count_lines(lines, "#").alias("comment_lines"), T.count_lines(lines, "import ", "from ").alias("imports"), T.count_lines(lines, "The ", "La ").alias("starts"))


@query(f"with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents) select doc_id, {_count('class ')} as classes, {_count('def ')} as functions, {_count('import ', 'from ')} as imports, {_count('#')} as comments, cast((length(text) - length(replace(text, 'the', ''))) // 3 as bigint) as words from l")
def pattern_counts(spark, d):
    t, lines = F.col("text"), F.split("text", "\n")
    words = F.floor((F.length(t) - F.length(F.replace(t, F.lit("the"), F.lit("")))) / 3).cast("bigint")
    return table(spark, d, "documents").select("doc_id", T.count_lines(lines, "class ").alias("classes"), T.count_lines(lines, "def ").alias("functions"), T.count_lines(lines, "import ", "from ").alias("imports"), T.count_lines(lines, "#").alias("comments"), words.alias("words"))


@query("select doc_id, regexp_extract(text, '^(\\S+)\\s+(\\S+)', 2) as second_word, string_split(regexp_extract(text, '^\\S+\\s+(\\S+)', 1), '.')[1] as root from documents")
def find_imports(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "^(\\S+)\\s+(\\S+)", 2).alias("second_word"), F.split(F.regexp_extract("text", "^\\S+\\s+(\\S+)", 1), "\\.")[0].alias("root"))


_PYTHON = f"list_transform(list_filter(ls, lambda x: regexp_matches(x, '{T.IMPORT_LINE}')), lambda x: regexp_extract(x, '{T.IMPORT_ROOT}', 1))"
_SCRIPT = T.SCRIPT_IMPORT.replace("'", "''")
_SCRIPT = f"list_transform(list_filter(ls, lambda x: regexp_matches(x, '{_SCRIPT}')), lambda x: string_split(regexp_extract(x, '{_SCRIPT}', 1), '/')[-1])"


@query(f"with s as (select doc_id, text, {SPLIT} as parts from documents), l as (select doc_id, {LINES} as ls from s), m as (select doc_id, 'python' as language, {_PYTHON} as names from l union all select doc_id, 'javascript', {_SCRIPT} from l) select doc_id, language, generate_subscripts(names, 1) as nth, unnest(names) as name from m")
def find_all_imports(spark, d):
    """The imports of all lines, by the rules of either language."""
    both = F.explode(F.array(*[F.struct(F.lit(x).alias("language"), T.imports(F.col("text"), F.lit(x)).alias("names")) for x in ("python", "javascript")]))
    made = table(spark, d, "documents").select("doc_id", both.alias("m"))
    return made.select("doc_id", "m.language", F.posexplode("m.names").alias("nth", "name")).withColumn("nth", F.col("nth").cast("bigint") + 1)


@query("select md5('file:' || source || ':' || doc_id) as id, doc_id from documents")
def entity_id_md5(spark, d):
    return table(spark, d, "documents").select(T.entity_id("file", F.col("source"), F.col("doc_id").cast("string")).alias("id"), "doc_id")


@query("select page_id, case lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) when '.html' then 'html' when '.py' then 'python' else 'unknown' end as language from pages")
def detect_language(spark, d):
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", T.language_of(path, T.FILE_LANGUAGES).alias("language"))


@query("select count(*) filter (contains(lower(p_name), 'green')) as test_files, count(*) filter (regexp_matches(lower(p_name), 'red|blue')) as config_files from part")
def count_test_files(spark, d):
    low = F.lower("p_name")
    return table(spark, d, "part").agg(F.count_if(F.contains(low, F.lit("green"))).alias("test_files"), F.count_if(low.rlike("red|blue")).alias("config_files"))


@query("with f as (select unnest(['license', 'password', 'copyright', '@']) as framework) select framework from f where exists (select 1 from documents where contains(text, framework))")
def frameworks(spark, d):
    words = ["license", "password", "copyright", "@"]
    seen = table(spark, d, "documents").agg(*[F.max(hit).alias(f"c{i}") for i, (_, hit) in enumerate(D.names_frameworks(F.col("text"), words))])
    return seen.select(F.explode(F.array_compact(F.array(*[F.when(F.col(f"c{i}"), F.lit(w)) for i, w in enumerate(words)]))).alias("framework"))


@query()
def extract_commands(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", D.commands(F.col("text")).alias("commands"), F.size(D.examples(F.col("text"))).alias("examples"), F.size(D.toml_sections(F.col("text"))).alias("sections"))
