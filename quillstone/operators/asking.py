"""Questions: ordered keyword classes, sub-questions, plans and focus areas. The rules are small fixed tables; rows stay in Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_of, first_class

# Question kinds by pattern, first match wins.
QUESTION_PATTERNS = [
    ("testing", ["test.*suite", "run.*test", "pytest", "coverage", "test.*report", "testing.*setup", "test.*config", "test.*dependencies"]),
    ("setup", ["install", "setup", "getting.*started", "requirements", "dependencies", "environment", "virtual.*env"]),
    ("usage", ["how.*use", "example", "tutorial", "getting.*started", "quick.*start", "basic.*usage"]),
    ("configuration", ["config", "settings", "environment.*var", "configure"]),
    ("deployment", ["deploy", "production", "docker", "build", "release"]),
]
# Answer kinds by word.
ANSWER_WORDS = [("installation", ["install", "setup"]), ("testing", ["test", "testing"]), ("configuration", ["configure", "config"]), ("usage", ["usage", "example"]), ("troubleshooting", ["error", "issue"])]
# Action kinds of a plan's step by word.
ACTION_WORDS = [("analyze_directory", ["directory", "folder", "structure"]), ("examine_files", ["file", "examine", "review"]), ("trace_relationships", ["trace", "relationship", "connection"]), ("validate_findings", ["validate", "verify", "check"])]
# First focus by word, and the ring of focus areas.
FOCUS_WORDS = [("testing_infrastructure", ["test", "testing"]), ("configuration_setup", ["config", "setup", "install"]), ("api_structure", ["api", "endpoint", "route"]), ("data_layer", ["database", "db", "model"]), ("deployment_setup", ["deploy", "production"])]
FOCUS_RING = ["testing_infrastructure", "configuration_setup", "api_structure", "data_layer", "deployment_setup", "project_overview"]
# Sub-questions by word, then those for all questions.
SUB_QUESTIONS = [
    (["install", "setup", "configure"], ["What are the installation requirements?", "How do I set up the environment?", "What configuration is needed?"]),
    (["test", "testing"], ["What testing frameworks are used?", "How do I run the tests?", "What do the test results mean?"]),
    (["usage", "example", "how"], ["What are the main usage patterns?", "Can you provide code examples?", "What are common use cases?"]),
    (["error", "issue", "problem"], ["What are common issues?", "How do I troubleshoot problems?", "What are the error patterns?"]),
    ([], ["What are the key components involved?", "What are the best practices?"]),
]
# Plan steps by word, then those of all plans.
PLAN_STEPS = [
    (["test", "testing"], ["Examine test directories and files", "Analyze test configuration files", "Trace test execution patterns", "Identify test frameworks and utilities"]),
    (["config", "setup", "install"], ["Examine configuration files", "Analyze package/dependency files", "Review setup and installation scripts", "Check environment configuration"]),
    (["api", "endpoint", "route"], ["Identify API definition files", "Trace route handlers and controllers", "Analyze middleware and authentication", "Review API documentation"]),
    ([], ["Analyze main entry points", "Examine core modules and packages", "Review documentation and README files", "Validate findings against question"]),
]
# Keywords that a question is searched by.
KEYWORDS = ["authentication", "auth", "login", "token", "jwt", "password", "database", "db", "model", "table", "user", "endpoint", "api", "router", "middleware", "configuration", "config", "entry point", "registration", "fastapi", "sqlalchemy", "pydantic", "create", "get", "post", "put", "delete", "handle", "work"]
# Labels of what a step or an action found, by word, first match wins.
RESULT_LABELS = [(["classes", "functions"], "Code structure insight: "), (["files"], "File organization insight: ")]
FINDING_LABELS = [("patterns", "Code organization insight: "), ("frameworks", "Technology stack insight: "), ("files", "Project structure insight: ")]
CONFIDENCE = {"testing": 0.8, "setup": 0.7, "usage": 0.6, "configuration": 0.6, "deployment": 0.5, "general": 0.3}


def question_kind(question: Column) -> Column:
    low, out = F.lower(question), F.when(F.lit(False), F.lit(""))
    for kind, patterns in QUESTION_PATTERNS:
        out = out.when(low.rlike("|".join(patterns)), F.lit(kind))
    return out.otherwise(F.lit("general"))


def answer_kind(question: Column) -> Column:
    return first_class(question, ANSWER_WORDS, "general")


def action_kind(step: Column) -> Column:
    return first_class(step, ACTION_WORDS, "general_analysis")


def first_focus(question: Column) -> Column:
    return first_class(question, FOCUS_WORDS, "project_overview")


def next_focus(focus: Column, confidence: Column, success: Column) -> Column:
    """The next of the ring after a confident success, else the overview."""
    ring = F.create_map(*[F.lit(x) for pair in zip(FOCUS_RING, FOCUS_RING[1:] + FOCUS_RING[:1], strict=True) for x in pair])
    return F.when((confidence > 0.7) & success, F.coalesce(F.try_element_at(ring, focus), F.lit("project_overview"))).otherwise(F.lit("project_overview"))


def sense_confidence(observations: Column, entities: Column) -> Column:
    return F.least(F.lit(1.0), observations * F.lit(0.1) + entities * F.lit(0.05))


def should_stop(confidence: Column, success: Column, insights: Column, areas: Column) -> Column:
    return ((confidence > 0.8) & success & (insights > 2)) | (areas >= 4)


def lessons(focus: Column, confidence: Column, success: Column, insights: Column) -> Column:
    """What a cycle teaches, as an array of sentences, which are fixed values."""
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    return F.array_compact(F.array(
        F.when(confidence > 0.8, say("High confidence in ", focus, " exploration")).when(confidence < 0.3, say("Low confidence in ", focus, " - needs deeper exploration")),
        F.when(success, say("Successful action execution in ", focus)).otherwise(say("Action execution issues in ", focus)),
        F.when(insights > 0, say("Generated ", insights.cast("string"), " insights from ", focus)),
    ))


def _listed(question: Column, table: list, most: int) -> Column:
    low = F.lower(question)
    none = F.array().cast("array<string>")
    parts = [F.when(any_of(low, words), F.array(*map(F.lit, texts))).otherwise(none) if words else F.array(*map(F.lit, texts)) for words, texts in table]
    return F.slice(F.concat(*parts), 1, most)


def sub_questions(question: Column) -> Column:
    return _listed(question, SUB_QUESTIONS, 5)


def plan_steps(question: Column) -> Column:
    return _listed(question, PLAN_STEPS, 8)


def plan_insight(result: Column, labels: list = RESULT_LABELS) -> Column:
    """What a step found with the label of its first word, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for words, label in labels:
        out = out.when(any_of(result, words), F.concat(F.lit(label), result))
    return out


def finding_insight(finding: Column) -> Column:
    """What an action found with the label of its first word, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for word, label in FINDING_LABELS:
        out = out.when(F.contains(finding, F.lit(word)), F.concat(F.lit(label), finding))
    return out


def json_or_lines(answer: Column) -> Column:
    """The strings of a JSON array, else the nonblank lines."""
    return F.coalesce(F.from_json(answer, "array<string>"), F.filter(F.transform(F.split(answer, "\n"), F.trim), lambda x: x != ""))


def keywords(question: Column) -> Column:
    """Known words in the question, in the table's order, else the words that most repositories hold."""
    low = F.lower(question)
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in KEYWORDS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("main"), F.lit("app")))
