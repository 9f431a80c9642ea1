"""Queries that classify questions and plan answers. The questions are the last user turns of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asking as A
from .base import QUESTIONS, questions, table
from .catalog import query

Q = "lower(question)"


def _classes(classes, default: str, col: str = Q) -> str:
    return "case " + " ".join(f"when {' or '.join(f'contains({col}, {w!r})' for w in words)} then '{name}'" for name, words in classes) + f" else '{default}' end"


def _lists(rules, most: int) -> str:
    parts = []
    for words, texts in rules:
        listed = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"
        test = " or ".join(f"contains({Q}, {w!r})" for w in words)
        parts.append(f"case when {test} then {listed} else [] end" if words else listed)
    return f"list_slice(list_concat({', '.join(parts)}), 1, {most})"


KIND = "case " + " ".join(f"when regexp_matches({Q}, '{'|'.join(p)}') then '{k}'" for k, p in A.QUESTION_PATTERNS) + " else 'general' end"


@query(f"with {QUESTIONS} select conv_id, {KIND} as kind from questions")
def classify_question(spark, d):
    return questions(spark, d).select("conv_id", A.question_kind(F.col("question")).alias("kind"))


@query(f"with {QUESTIONS} select conv_id, {_classes(A.ANSWER_WORDS, 'general')} as kind from questions")
def answer_type(spark, d):
    return questions(spark, d).select("conv_id", A.answer_kind(F.col("question")).alias("kind"))


@query(f"with {QUESTIONS} select conv_id, {_classes(A.ACTION_WORDS, 'general_analysis')} as kind from questions")
def action_type(spark, d):
    return questions(spark, d).select("conv_id", A.action_kind(F.col("question")).alias("kind"))


@query(f"with {QUESTIONS} select conv_id, {_classes(A.FOCUS_WORDS, 'project_overview')} as focus from questions")
def initial_focus(spark, d):
    return questions(spark, d).select("conv_id", A.first_focus(F.col("question")).alias("focus"))


_RING = " ".join(f"when '{a}' then '{b}'" for a, b in zip(A.FOCUS_RING, A.FOCUS_RING[1:] + A.FOCUS_RING[:1], strict=True))


@query(f"with {QUESTIONS}, f as (select conv_id, {_classes(A.FOCUS_WORDS, 'project_overview')} as focus, length(question) % 10 / 10.0::double as confidence, conv_id % 2 = 0 as success from questions) select conv_id, case when confidence > 0.7 and success then case focus {_RING} end else 'project_overview' end as focus from f")
def next_focus(spark, d):
    q = F.col("question")
    return questions(spark, d).select("conv_id", A.next_focus(A.first_focus(q), F.length(q) % 10 / F.lit(10.0), F.col("conv_id") % 2 == 0).alias("focus"))


@query(f"with {QUESTIONS} select conv_id, pos as step_no, {_lists(A.SUB_QUESTIONS, 5)}[pos] as sub_question from questions, (select unnest(range(1, 6)) as pos) where pos <= len({_lists(A.SUB_QUESTIONS, 5)})")
def decompose_question(spark, d):
    return questions(spark, d).select("conv_id", F.posexplode(A.sub_questions(F.col("question")))).select("conv_id", (F.col("pos") + 1).cast("bigint").alias("step_no"), F.col("col").alias("sub_question"))


@query(f"with {QUESTIONS} select conv_id, pos as step_no, {_lists(A.PLAN_STEPS, 8)}[pos] as step from questions, (select unnest(range(1, 9)) as pos) where pos <= len({_lists(A.PLAN_STEPS, 8)})")
def plan_steps(spark, d):
    return questions(spark, d).select("conv_id", F.posexplode(A.plan_steps(F.col("question")))).select("conv_id", (F.col("pos") + 1).cast("bigint").alias("step_no"), F.col("col").alias("step"))


_CONF = " ".join(f"when '{k}' then {v}" for k, v in A.CONFIDENCE.items())
_SUBS = _lists(A.SUB_QUESTIONS, 5)


@query(f"""with {QUESTIONS}, s as (select conv_id, unnest({_SUBS}) as question from questions), k as (select conv_id, {KIND} as kind from s)
  select conv_id, round(avg(cast(case kind {_CONF} end as double)), 6) as confidence, count(*) as steps from k group by conv_id""")
def reasoning_confidence(spark, d):
    subs = questions(spark, d).select("conv_id", F.explode(A.sub_questions(F.col("question"))).alias("q")).withColumn("kind", A.question_kind(F.col("q")))
    table_ = F.create_map(*[F.lit(x) for pair in A.CONFIDENCE.items() for x in pair])
    return subs.groupBy("conv_id").agg(F.round(F.avg(F.try_element_at(table_, F.col("kind"))), 6).alias("confidence"), F.count(F.lit(1)).alias("steps"))


_KEYS = "list_filter([" + ", ".join(f"case when contains({Q}, '{k}') then '{k}' end" for k in A.KEYWORDS) + "], lambda x: x is not null)"


@query(f"""with {QUESTIONS}, k as (select conv_id, unnest(case when len({_KEYS}) > 0 then {_KEYS} else ['main', 'app'] end) as keyword from questions),
  hit as (select distinct conv_id, doc_id from k join documents on contains(lower(text), keyword)),
  r as (select conv_id, doc_id, row_number() over (partition by conv_id order by doc_id) as rank from hit) select conv_id, doc_id, rank from r where rank <= 3""")
def keyword_search(spark, d):
    from ..operators.graph import top_per

    keys = questions(spark, d).select("conv_id", F.explode(A.keywords(F.col("question"))).alias("keyword"))
    words = [*A.KEYWORDS, "main", "app"]
    low = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    tagged = low.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(w)), F.lit(w)) for w in words]))).alias("keyword"))
    best = top_per(tagged, ["keyword"], ["doc_id"], 3).drop("rank")  # no question needs more of a keyword
    hit = keys.join(best, "keyword").select("conv_id", "doc_id").distinct()
    return top_per(hit, ["conv_id"], ["doc_id"], 3)


@query("select conv_id, turn, case when contains(text, 'the') then 'Code structure insight: ' || text when contains(text, 'an') then 'File organization insight: ' || text end as insight from conversations where contains(text, 'the') or contains(text, 'an')")
def label_findings(spark, d):
    said = table(spark, d, "conversations")
    words = [([w], label) for w, (_, label) in zip(("the", "an"), A.RESULT_LABELS, strict=True)]  # words that the turns hold
    return said.select("conv_id", "turn", A.plan_insight(F.col("text"), words).alias("insight")).where("insight is not null")


@query("select conv_id, round(least(1.0, count(*) * 0.1::double + count(*) filter (role = 'user') * 0.05::double), 6) as confidence from conversations group by conv_id")
def sense_confidence(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("o"), F.count_if(F.col("role") == "user").alias("e"))
    return n.select("conv_id", F.round(A.sense_confidence(F.col("o"), F.col("e")), 6).alias("confidence"))


@query("with x as (select event_id, unnest(case when event_id % 2 = 0 then [event_type, props] else [props] end) as item from events) select event_id, item from x")
def json_or_lines(spark, d):
    """Even events hold a JSON array of their type and properties, odd ones plain lines."""
    e = table(spark, d, "events")
    answer = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array("event_type", "props"))).otherwise(F.col("props"))
    return e.select("event_id", F.explode(A.json_or_lines(answer)).alias("item"))


@query("""with f as (select distinct source from documents), r as (select source, case when source like '%1%' then 0 when source in ('src2', 'src3') then 1 when source in ('src4', 'src5') then 2 end as rank from f)
  select source, rank from r where rank is not null order by rank, source limit 5""")
def priority_areas(spark, d):
    s = F.col("source")
    rank = F.when(F.contains(s, F.lit("1")), 0).when(s.isin("src2", "src3"), 1).when(s.isin("src4", "src5"), 2)
    return table(spark, d, "documents").select("source").distinct().withColumn("rank", rank).where("rank is not null").orderBy("rank", "source").limit(5)
