"""Queries that answer questions over a project: reports, plans, sessions, overviews, prompts. The project is made of the given tables: each
document is a file, dealt to the typical names below in turn; its repository is its source. No document is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers
from ..operators import asking as A
from ..operators import graph, project, prompts, search, sessions, vectors
from .asking import KIND, _classes, _lists
from .base import GRAPH, QUESTIONS, graph_edges, graph_entities, questions, table
from .catalog import query

NAMES = ["README.md", "tests/test_app.py", "requirements-test.txt", "pyproject.toml", "config/settings.py", "docker/Dockerfile", "docs/guide.md", "src/main.py", "ci/workflows/build.yml", "src/api/routes.py", "setup.py", "src/models.py"]
_NAMED = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_EXT = "regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)"
PROJECT = f""" project as (select doc_id as ord, cast(doc_id as varchar) as id, regexp_extract({_NAMED}[doc_id % {len(NAMES)} + 1], '([^/]*)$', 1) as name, 'file' as type,
  regexp_replace({_NAMED}[doc_id % {len(NAMES)} + 1], '([^/]*)$', doc_id || '/\\1') as path, coalesce(text, '') as content, source from documents) """


def project_files(spark, d: str) -> DataFrame:
    """(ord, id, name, type, path, content, size, source): the number of a document is a folder before the name."""
    docs = table(spark, d, "documents")
    place = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    return docs.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), T.base_name(place).alias("name"), F.lit("file").alias("type"),
        F.concat(F.regexp_replace(place, "[^/]*$", ""), F.col("doc_id").cast("string"), F.lit("/"), T.base_name(place)).alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.octet_length("text").cast("bigint").alias("size"), "source",
    )


def _any(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _commands(col: str) -> str:
    """The rules of commands in the other engine."""
    found = ", ".join(f"regexp_extract_all({col}, '{p}', 1)" for p in answers.D.COMMANDS)
    trim = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    clean = trim.format("replace(" + trim.format("x") + ", '\\n', ' ')")
    return f"list_distinct(list_filter(list_transform(list_concat({found}), lambda x: {clean}), lambda x: length(x) between 4 and 99))"


_KINDS = ", ".join(f"case when {_any('lower(path)' if k == 'usage' else 'lower(name)', w)} then '{k}' end" for k, w in answers.RELEVANT.items())
_RELEVANT = f"{PROJECT}, relevant as (select *, unnest(list_filter([{_KINDS}, 'general'], lambda x: x is not null)) as kind, name || ' (' || path || ')' as file from project)"


@query(f"with {_RELEVANT} select kind, ord, file from relevant")
def relevant_files(spark, d):
    return answers.relevant(project_files(spark, d)).select("kind", "ord", "file")


@query(f"""with {_RELEVANT}, one as (select kind, ord, file, case when kind in ('testing', 'setup') then {_commands('content')} else [] end as cs from relevant)
  select kind, count(*) as n_files, cast(sum(len(cs)) as bigint) as n_commands, bool_or(kind = 'testing' and contains(file, 'requirements-test')) as needs from one group by kind""")
def report_facts(spark, d):
    """The facts that reports are made of."""
    made = answers.reports(project_files(spark, d))
    return made.select("kind", "n_files", "n_commands", F.contains("answer", F.lit(answers.DEPENDENCIES)).alias("needs"))


_SURE = " ".join(f"when '{k}' then {v}" for k, v in answers.FOUND.items())


@query(f"""with {QUESTIONS}, {_RELEVANT}, k as (select conv_id, {KIND} as kind from questions), n as (select kind, count(*) as n_files from relevant group by kind),
  types as (select string_agg(name, ', ' order by ord) filter (r <= 3) as names, count(*) as n from (select *, row_number() over (order by ord) as r from project))
  select conv_id, k.kind, n_files, case k.kind {' '.join(f"when '{x}' then {v}" for x, v in (answers.FOUND | {'usage': 0.4}).items())} end as confidence,
    case k.kind when 'general' then '{answers.HEADS['general']}\\n- Files: ' || names || case when n > 3 then ' (and ' || (n - 3) || ' more)' else '' end
    when 'usage' then '{answers.NOTHING['usage']}' when 'configuration' then '{answers.NOTHING['configuration']}' when 'setup' then '{answers.HEADS['setup']}\\n1. `{answers.EDITABLE}`' end as answer
  from k left join n using (kind), types where k.kind not in ('testing', 'deployment')""")
def analyze_question(spark, d):
    """The answers that quote no list; those to questions about tests and deployment are answer_lists."""
    made = answers.answer(questions(spark, d), answers.reports(project_files(spark, d)))
    return made.where("kind not in ('testing', 'deployment')").select("conv_id", "kind", "n_files", "confidence", "answer")


@query()
def answer_lists(spark, d):
    """The reports themselves, for each repository; compared with worked examples in the tests."""
    return answers.reports(project_files(spark, d), ["source"])


@query()
def reason_about_question(spark, d):
    """Sub-questions, their answers, the synthesis; compared with worked examples in the tests."""
    return answers.synthesis(answers.analyses(questions(spark, d), answers.reports(project_files(spark, d))))


_SUBS = _lists(A.SUB_QUESTIONS, 5)
_KIND_OF = KIND.replace("question", "sub_question")


@query(f"""with {QUESTIONS}, {_RELEVANT}, n as (select kind, count(*) as n_files from relevant group by kind),
  s as (select conv_id, generate_subscripts({_SUBS}, 1) as step_no, unnest({_SUBS}) as sub_question from questions), k as (select *, {_KIND_OF} as kind from s)
  select conv_id, step_no, sub_question, kind, coalesce(n_files, 0) as n_files from k left join n using (kind)""")
def analyze_sub_questions(spark, d):
    made = answers.analyses(questions(spark, d), answers.reports(project_files(spark, d)))
    return made.select("conv_id", "step_no", "sub_question", "kind", "n_files")


_TYPED = "case when contains(lower(question), 'class') then 'class' when contains(lower(question), 'function') then 'function' when contains(lower(question), 'file') then 'file' end"


@query(f"""with {QUESTIONS}, {PROJECT}, hit as (select conv_id, ord, id as entity_id from questions join project on contains(lower(content), lower(question))),
  none as (select conv_id, {_TYPED} as type from questions where conv_id not in (select conv_id from hit)), first as (select type, ord, id as entity_id from project order by ord limit 10)
  select conv_id, ord, entity_id from hit union all select conv_id, ord, entity_id from none join first using (type)""")
def search_or_type(spark, d):
    """Search by the whole question first, as the query command does; questions that match nothing fall back to the type that they name."""
    own, files = questions(spark, d), project_files(spark, d)
    hits = search.matches(own, files.withColumnRenamed("id", "entity_id"), "content", ["ord", "entity_id"])
    return answers.found_or_typed(hits, files, own)


_TOP = "split_part(path, '/', 1)"


@query(f"""with {PROJECT}, f as (select {_TOP} as area, path from project where contains(path, '/')),
  dirs as (select distinct area, list_slice(string_split(path, '/'), 1, k) as p from (select area, path, unnest(range(2, len(string_split(path, '/')))) as k from f)),
  s as (select area, cast(count(*) as bigint) as n_files from f group by area), x as (select area, count(*) as n_dirs, count(*) filter (len(p) = 2) as n_direct from dirs group by area)
  select area as name, n_files, n_files + coalesce(n_dirs, 0) as n_items, coalesce(n_direct, 0) + (select count(*) from f g where g.area = s.area and len(string_split(path, '/')) = 2) as n_children from s left join x using (area)""")
def area_sums(spark, d):
    return sessions.areas(project_files(spark, d)).select("name", "n_files", "n_items", "n_children")


_FILE = "'File ' || name || ': ' || {} || ' classes, ' || {} || ' functions, ' || {} || ' imports'"
_LINES = "string_split(content, chr(10))"
_COUNT = lambda *starts: f"len(list_filter({_LINES}, lambda x: {' or '.join(f'''starts_with(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '{s}')''' for s in starts)}))"


@query(f"with {PROJECT} select {_TOP} as area, path, {_FILE.format(_COUNT('class '), _COUNT('def '), _COUNT('import ', 'from '))} as result from project where ends_with(name, '.py') and length(content) > 100 and contains(path, '/')")
def examine_files(spark, d):
    return sessions.examined(project_files(spark, d))


@query(f"""with {PROJECT}, f as (select path, string_split(path, '/') as p, {_EXT} in ({', '.join(repr(x) for x in sessions.KEY_SUFFIXES)}) as key from project),
  areas as (select distinct p[1] as area from f where len(p) > 1), direct as (select p[1] as area, p[2] as file, key from f where len(p) = 2),
  n as (select area, count(*) as files from direct group by area), i as (select area, count(*) as dirs from (select distinct p[1] as area, p[2] as dir from f where len(p) > 2) group by area),
  k as (select area, string_agg(file, ', ' order by file) as keys from (select area, file from direct where key qualify row_number() over (partition by area order by file) <= {sessions.KEY_FILES}) group by area)
  select area, 'Directory ' || area || ': ' || coalesce(files, 0) || ' files, ' || coalesce(dirs, 0) || ' directories. Key files: ' || coalesce(keys, '') as result from areas left join n using (area) left join i using (area) left join k using (area)""")
def directory_contents(spark, d):
    return sessions.contents(project_files(spark, d))


@query()
def directory_report(spark, d):
    return sessions.structure(project_files(spark, d))


@query()
def plan_then_act(spark, d):
    """Plans for all questions, carried out; compared with worked examples in the tests."""
    files = project_files(spark, d)
    return sessions.plan_results(sessions.executed(sessions.plans(questions(spark, d), files), files, files))


_GLOB = lambda g: T.glob_to_regex(g).removeprefix("(?s)^").removesuffix("$")
_FITS = ", ".join(f"case when regexp_full_match(name, '(?s:{_GLOB(g)})') then {{'focus': '{f}', 'no': {i}}} end" for f, gs in sessions.FOCUS_FILES.items() for i, g in enumerate(gs))


@query(f"with {PROJECT}, x as (select ord, name, unnest(list_filter([{_FITS}], lambda x: x is not null)) as o from project) select o.focus as focus, cast(o.no as bigint) as pattern_no, ord, 'Found ' || o.focus || ' file: ' || name as said from x")
def observe_files(spark, d):
    seen = sessions.observed_files(project_files(spark, d))
    return seen.select("focus", F.col("pattern_no").cast("bigint").alias("pattern_no"), F.regexp_extract("path", "([0-9]+)/[^/]*$", 1).cast("bigint").alias("ord"), "said")


@query()
def sense_act_cycles(spark, d):
    """Compared with worked examples in the tests."""
    files = project_files(spark, d)
    return sessions.session_cycles(questions(spark, d), sessions.sensed(files, files))


@query()
def sense_act_sessions(spark, d):
    files = project_files(spark, d)
    return sessions.session_answers(questions(spark, d), sessions.sensed(files, files))


@query("""with said as (select conv_id, turn, case when contains(text, 'classes') or contains(text, 'functions') then 'Code structure insight: ' || text when contains(text, 'files') then 'File organization insight: ' || text end as plan,
  case when contains(text, 'patterns') then 'Code organization insight: ' || text when contains(text, 'frameworks') then 'Technology stack insight: ' || text when contains(text, 'files') then 'Project structure insight: ' || text end as cycle from conversations)
  select conv_id, turn, coalesce(plan, '') as plan, coalesce(cycle, '') as cycle from said""")
def insights(spark, d):
    said = table(spark, d, "conversations")
    return said.select("conv_id", "turn", F.coalesce(A.plan_insight(F.col("text")), F.lit("")).alias("plan"), F.coalesce(A.finding_insight(F.col("text")), F.lit("")).alias("cycle"))


@query(f"""with {QUESTIONS}, f as (select conv_id, {_classes(A.FOCUS_WORDS, 'project_overview')} as focus, length(question) % 10 / 10.0::double as c, conv_id % 2 = 0 as ok, conv_id % 5 as n from questions)
  select conv_id, (c > 0.8 and ok and n > 2) or n >= 4 as stop, case when c > 0.8 then 'High confidence in ' || focus || ' exploration; ' when c < 0.3 then 'Low confidence in ' || focus || ' - needs deeper exploration; ' else '' end
  || case when ok then 'Successful action execution in ' else 'Action execution issues in ' end || focus || case when n > 0 then '; Generated ' || n || ' insights from ' || focus else '' end as learned from f""")
def learn_and_stop(spark, d):
    q, n = F.col("question"), F.col("conv_id") % 5
    focus, sure, ok = A.first_focus(q), F.length(q) % 10 / F.lit(10.0), F.col("conv_id") % 2 == 0
    return questions(spark, d).select("conv_id", A.should_stop(sure, ok, n, n).alias("stop"), F.array_join(A.lessons(focus, sure, ok, n), "; ").alias("learned"))


_MARKED = lambda kind: "case " + " ".join(f"when list_contains(tops, '{m}') then '{v}'" for m, k, v in reversed(project.MARKERS) if k == kind) + " else 'unknown' end"
_FLAGGED = ", ".join(f"list_has_any(tops, [{', '.join(repr(n) for n in names)}]) as {flag}" for flag, names in project.FLAGS)
_TECH = "case " + " ".join(f"when ext = '{e}' then '{t}'" for e, t in T.TECHNOLOGIES.items()) + " end"


@query(f"""with {PROJECT}, x as (select source, path, {_TOP} as top, {_EXT} as ext from project), t as (select source, {_TECH} as tech, ext, count(*) as n from x where {_TECH} is not null group by all),
  m as (select source, arg_max(tech, (n, ext)) as tech from t group by source), g as (select source, count(*) as files, list(distinct top) as tops from x group by source)
  select source, files, coalesce(tech, 'Unknown') as primary_language, {_MARKED('package_manager')} as package_manager, {_MARKED('build_system')} as build_system, {_FLAGGED} from g left join m using (source)""")
def repository_overview(spark, d):
    return project.overview(project_files(spark, d), ["source"]).drop("suggestions")


@query(f"with {PROJECT}, x as (select source, {_EXT} as ext from project) select source, {_TECH} as technology, ext as extension, count(*) as file_count from x where {_TECH} is not null group by all")
def technologies_by_repository(spark, d):
    return project.technologies(project_files(spark, d), ["source"])


@query()
def strategy_advice(spark, d):
    return project.overview(project_files(spark, d), ["source"]).select("source", F.explode("suggestions").alias("suggestion"))


@query()
def analyze_files(spark, d):
    """Sizes, languages and patterns of all files; patterns are compared with worked examples in the tests."""
    made = project.file_analysis(project_files(spark, d))
    return made.select("path", "size", "extension", "language", "line_count", "char_count", F.size("patterns.imports").alias("imports"), F.size("patterns.functions").alias("functions"), F.size("patterns.classes").alias("classes"), "patterns.comment_lines", "patterns.blank_lines")


_MAP = lambda m: "case lower(" + _EXT + ") " + " ".join(f"when '{k}' then '{v}'" for k, v in m.items()) + " else 'unknown' end"


@query(f"with {PROJECT} select ord, {_MAP(T.INSPECT_LANGUAGES)} as inspected, {_MAP(T.SESSION_LANGUAGES)} as session, {_MAP(T.INDEX_LANGUAGES)} as indexed from project")
def languages_of_files(spark, d):
    maps = (("inspected", T.INSPECT_LANGUAGES), ("session", T.SESSION_LANGUAGES), ("indexed", T.INDEX_LANGUAGES))
    return project_files(spark, d).select("ord", *[T.language_of(F.col("path"), m).alias(n) for n, m in maps])


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(f"with q as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents) select doc_id, {_text(prompts.EXPLAIN[0])} || lang || {_text(prompts.EXPLAIN[1])} || lang || chr(10) || text || {_text(prompts.EXPLAIN[2])} as explain, {_text(prompts.IMPROVE[0])} || lang || {_text(prompts.IMPROVE[1])} || lang || chr(10) || text || {_text(prompts.IMPROVE[2])} as improve from q")
def code_prompts(spark, d):
    docs = table(spark, d, "documents")
    text, lang = (F.coalesce(c, F.lit("")) for c in ("text", "lang"))
    return docs.select("doc_id", prompts.explain(text, lang).alias("explain"), prompts.improve(text, lang).alias("improve"))


@query(f"with {QUESTIONS} select conv_id, 'Mock response to: ' || substr(question, 1, 100) || '...' as answer, {_text(prompts.CONTEXT)} || conv_id as system from questions")
def ask_with_context(spark, d):
    asked = questions(spark, d).withColumn("context", F.col("conv_id").cast("string"))
    said = prompts.messages(F.col("question"), F.col("context"))
    return asked.select("conv_id", prompts.model("mock")(said).alias("answer"), said[0]["content"].alias("system"))


@query("""with e as (select event_id, user_id, event_type, ts, value, lead(ts) over w as te, lead(event_type) over w as nt from events window w as (partition by user_id order by ts, event_id))
  select count(*) as requests, count(*) filter (te is not null and nt <> 'error') as successes, count(*) filter (nt = 'error') as failures, cast(coalesce(sum(length(nt)) filter (te is not null and nt <> 'error'), 0) as bigint) as tokens from e""")
def traced_requests(spark, d):
    """Each event is a request that the user's next event ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("request_id"), F.col("ts").alias("start_time"), F.col("event_type").alias("prompt"), F.lead("ts").over(w).alias("end_time"), F.lead("event_type").over(w).alias("content"))
    ends = e.where("end_time is not null").select("request_id", "end_time", "content", F.length("content").cast("bigint").alias("total_tokens"), F.when(F.col("content") == "error", F.col("content")).alias("error"))
    return prompts.trace_stats(prompts.traces(e.select("request_id", "start_time", "prompt"), ends))


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double)))"


@query(f"""with s as (select q.vec_id as query_id, e.vec_id as id, round({_DOT}, 5) as score from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0),
  r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, id, score, cast(rank as bigint) as rank from r where rank <= 5""")
def vector_knn_all(spark, d):
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    rows = table(spark, d, "embeddings")
    return vectors.nearest_of_each(rows.where("vec_id % 100 = 0"), rows, 5, "vec_id", "embedding").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""with {GRAPH}, st as (select distinct source_id as s, target_id as t from edges where relationship_type in ('imports', 'calls', 'uses') and source_id <> target_id)
  select count(*) as n from st a join st b on a.t = b.s join st c on b.t = c.s join st e on c.t = e.s and e.t = a.s where a.s < a.t and a.s < b.t and a.s < c.t and a.t <> c.t""")
def circular_deps_4(spark, d):
    return graph.cycles(graph_edges(spark, d), 4).agg(F.count(F.lit(1)).alias("n"))


@query()
def greedy_clusters(spark, d):
    """Compared with a plain greedy pass in the tests."""
    return graph.greedy_clusters(graph_edges(spark, d), graph_entities(spark, d))


_TRADE = "step as (select distinct s_nationkey as s, c_nationkey as t from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey <> c_nationkey)"


def trade_edges(spark, d):
    """Nations that sell to nations, as calls."""
    sold = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    buyer = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    seller = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    met = sold.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select(F.col("s_nationkey").alias("source_id"), F.col("c_nationkey").alias("target_id"), F.lit("calls").alias("relationship_type"))


@query(f"with {_TRADE} select a.s as e1, a.t as e2, b.t as e3 from step a join step b on a.t = b.s join step c on b.t = c.s and c.t = a.s where a.s < a.t and a.s < b.t")
def trade_cycles_3(spark, d):
    return graph.cycles(trade_edges(spark, d), 3)


@query(f"with {_TRADE} select a.s as e1, count(*) as n from step a join step b on a.t = b.s join step c on b.t = c.s join step e on c.t = e.s and e.t = a.s where a.s < a.t and a.s < b.t and a.s < c.t and a.t <> c.t group by a.s")
def trade_cycles_4(spark, d):
    return graph.cycles(trade_edges(spark, d), 4).groupBy("e1").agg(F.count(F.lit(1)).alias("n"))


_IMPORTANT = ["main", "index", "app", "server", "client", "core", "base"]


@query(f"with {PROJECT} select path from project where {_any('lower(path)', _IMPORTANT)} order by path limit 20")
def important_project_files(spark, d):
    from .repository import IMPORTANT

    return project_files(spark, d).where(T.any_of(F.lower("path"), IMPORTANT)).select("path").orderBy("path").limit(20)
