"""Queries on traces, prompts and settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import lookup
from ..operators import prompts
from .base import QUESTIONS, questions, table
from .catalog import query

# Documentation sites.
DOC_SITES = {"python": "https://docs.python.org/3/", "javascript": "https://developer.mozilla.org/", "react": "https://reactjs.org/docs/", "django": "https://docs.djangoproject.com/", "flask": "https://flask.palletsprojects.com/", "nodejs": "https://nodejs.org/docs/", "typescript": "https://www.typescriptlang.org/docs/"}


@query("select count(*) as requests, count(*) filter (event_type <> 'error') as successes, count(*) filter (event_type = 'error') as failures, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as tokens from events")
def trace_stats(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") != "error").alias("successes"), F.count_if(F.col("event_type") == "error").alias("failures"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("tokens"))


@query("select event_id, user_id from events order by ts desc, event_id desc limit 20")
def recent_traces(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("select event_id, lead(event_id) over w as end_id from events window w as (partition by user_id order by ts, event_id)")
def trace_pairs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lead("event_id").over(w).alias("end_id"))


@query("with p as (select event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as te from events) select event_id, date_diff('microsecond', ts, te) / 1000.0::double as duration_ms from p")
def trace_duration(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "ts", F.lead("ts").over(w).alias("te"))
    return e.select("event_id", (F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("te")) / F.lit(1000.0)).alias("duration_ms"))


@query(f"with {QUESTIONS} select conv_id, 'Mock response to: ' || substr(question, 1, 100) || '...' as content, 75 as total_tokens from questions")
def mock_llm(spark, d):
    return prompts.ask(questions(spark, d), prompts.model("mock")).select("conv_id", F.col("answer").alias("content"), F.lit(prompts.MOCK_TOKENS["total_tokens"]).alias("total_tokens"))


@query("select doc_id, 'Explain what this ' || lang || ' code does:' || chr(10) || chr(10) || '```' || lang || chr(10) || text || chr(10) || '```' as prompt from documents")
def prompt_render(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("Explain what this "), "lang", F.lit(" code does:\n\n```"), "lang", F.lit("\n"), "text", F.lit("\n```")).alias("prompt"))


@query("select distinct 'Mock result for: ' || p_name as title, 'https://example.com/search?q=' || replace(p_name, ' ', '+') as url from part")
def web_search_mock(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(F.concat(F.lit("Mock result for: "), n).alias("title"), F.concat(F.lit("https://example.com/search?q="), F.replace(n, F.lit(" "), F.lit("+"))).alias("url")).distinct()


@query("""with t as (select n_name, case n_nationkey % 3 when 0 then 'python' when 1 then 'react' else 'other' end as tech from nation)
  select n_name, case tech when 'python' then 'https://docs.python.org/3/search?q=' || replace(n_name, ' ', '+') when 'react' then 'https://reactjs.org/docs/search?q=' || replace(n_name, ' ', '+')
  else 'https://example.com/search?q=' || replace(tech || ' ' || n_name || ' documentation', ' ', '+') end as url from t""")
def doc_search(spark, d):
    key = F.col("n_nationkey") % 3
    tech = F.when(key == 0, "python").when(key == 1, "react").otherwise("other")
    plus = lambda c: F.replace(c, F.lit(" "), F.lit("+"))
    site = lookup(DOC_SITES, tech)
    url = F.when(site.isNotNull(), F.concat(site, F.lit("search?q="), plus(F.col("n_name")))).otherwise(F.concat(F.lit("https://example.com/search?q="), plus(F.concat_ws(" ", tech, F.col("n_name"), F.lit("documentation")))))
    return table(spark, d, "nation").select("n_name", url.alias("url"))


@query("select event_id, case when event_id % 3 = 0 then repeat('*', least(length(props), 8)) else props end as value from events")
def mask_secrets(spark, d):
    """Keys are event types, every third with a name that asks for masking."""
    key = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("_token"))).otherwise(F.col("event_type"))
    secret = F.lower(key).rlike("key|password|token|secret")
    return table(spark, d, "events").select("event_id", F.when(secret, F.repeat(F.lit("*"), F.least(F.length("props"), F.lit(8)))).otherwise(F.col("props")).alias("value"))


@query("""with l as (select doc_id, trim(x) as line from (select doc_id, unnest(string_split(text, chr(10))) as x from documents))
  select doc_id, trim(split_part(line, '=', 1)) as key, regexp_replace(trim(regexp_replace(line, '^[^=]*=', '')), '^["'']|["'']$', '', 'g') as value from l where contains(line, '=') and not starts_with(line, '#')""")
def env_parse(spark, d):
    """KEY=VALUE lines of the texts: no comments, quotes removed."""
    line = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    line = line.where(F.contains("line", F.lit("=")) & ~F.startswith("line", F.lit("#")))
    return line.select("doc_id", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace("line", "^[^=]*=", "")), "^[\"']|[\"']$", "").alias("value"))
