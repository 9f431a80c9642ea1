"""Answers to questions from the entities of a knowledge base: one report for each kind of question, then sub-questions and a synthesis.

What a report says depends on its kind and the entities only, so the six kinds are reported in one pass over the entities (for each
repository, if ``by`` names it) and questions meet them by their kind. A report quotes few items, the first by ``ord``; they are
ranked within their group before anything is collected. The files themselves are rows of relevant().

Edge cases: null names, paths and contents count as empty; a kind without relevant entities has the answer that says so; an empty
knowledge base still gives the six reports if ``by`` is empty; ties of ``ord`` are broken by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of
from . import documents as D
from .asking import answer_kind, question_kind, sub_questions

# Words that make an entity relevant; of its name, for usage of its path.
RELEVANT = {
    "testing": ["test", "pytest", "coverage", "requirements"],
    "setup": ["readme", "requirements", "setup", "pyproject", "install"],
    "usage": ["readme", "doc", "example", "tutorial", "guide"],
    "configuration": ["config", "settings", ".env", "pyproject", "setup"],
    "deployment": ["docker", "deploy", "ci", "workflow", "action"],
}
KINDS = [*RELEVANT, "general"]
# Items that an answer quotes. Configuration sections and deployment files have no limit.
QUOTED = {"testing": 3, "setup": 5, "usage": 2}
# The sentences of answers. Their line breaks are the two characters backslash and n, but within code.
BREAK = "\\n"
DEPENDENCIES = "1. **Install test dependencies:**\n   ```bash\n   pip install -r requirements-tests.txt\n   ```"
PYTEST = "2. **Run the complete test suite:**\n   ```bash\n   pytest\n   ```"
RUN = "2. **Run tests:**\n   ```bash\n   python -m pytest\n   ```"
COVERAGE = "3. **Generate coverage reports:**\n   ```bash\n   pytest --cov\n   pytest --cov --cov-report=html\n   ```"
HEADS = {"testing": "**Test Configuration:**", "setup": "**Installation Steps:**", "usage": "**Usage Examples:**", "configuration": "**Configuration sections found:**", "deployment": "**Deployment configuration:**", "general": "**Found relevant code:**"}
NOTHING = {"setup": "Installation instructions can be found in the repository files.", "usage": "Usage examples and documentation found in the repository.", "configuration": "Configuration files found in the repository.", "deployment": "Deployment configuration files found in the repository."}
FOUND = {"testing": 0.8, "setup": 0.7, "usage": 0.6, "configuration": 0.6, "deployment": 0.5, "general": 0.3}
NOT_FOUND = FOUND | {"setup": 0.4, "usage": 0.4}
EDITABLE = "pip install -e ."
# Groups of sub-questions in a synthesis, first match wins, and their headings.
GROUPS = [("setup", ["install", "setup", "configure"], "### 🚀 Setup and Installation"), ("usage", ["usage", "example", "how"], "### 💡 Usage and Examples"), ("trouble", ["error", "issue", "problem"], "### 🔧 Troubleshooting"), ("other", [], "### 📚 Additional Information")]
REFERENCES = "📖 **Relevant Code References:**"
DECOMPOSED, SYNTHESIZED = 0.6, 0.7


def relevant(entities: DataFrame, by: list[str] = ()) -> DataFrame:
    """A row for each kind of question that an entity (ord, id, name, type, path, content) is relevant to."""
    clean = entities.select(*by, "ord", "id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "type", "path", "content")])
    tests = [F.when(any_of(F.lower("path" if kind == "usage" else "name"), words), F.lit(kind)) for kind, words in RELEVANT.items()]
    kinds = F.array_compact(F.array(*tests, F.lit("general")))
    return clean.select("*", F.explode(kinds).alias("kind"), F.concat("name", F.lit(" ("), "path", F.lit(")")).alias("file"))


def _items() -> Column:
    """What an entity adds to the answer of its kind."""
    low, none = F.lower("name"), F.array().cast("array<string>")
    needs = D.dependencies(F.col("content"))
    tests = F.concat(
        F.when(F.contains(low, F.lit("requirements")) & F.contains(low, F.lit("test")) & (F.size(needs) > 0), F.array(F.concat(F.lit("Test dependencies: "), F.array_join(F.slice(needs, 1, 5), ", ")))).otherwise(none),
        F.when(low.isin("pyproject.toml", "setup.cfg", "pytest.ini"), D.test_configuration(F.col("content"), F.col("name"))).otherwise(none),
    )
    sections = F.transform(F.slice(D.toml_sections(F.col("content")), 1, 3), lambda x: F.concat(F.lit("["), x, F.lit("]")))
    ships = F.when(F.contains(low, F.lit("docker")), F.array(F.concat(F.lit("Docker configuration: "), "name"))).when(F.contains(F.lower("path"), F.lit("workflow")), F.array(F.concat(F.lit("CI/CD workflow: "), "name")))
    return (
        F.when(F.col("kind") == "testing", tests)
        .when((F.col("kind") == "setup") & F.contains(low, F.lit("readme")), D.install_instructions(F.col("content")))
        .when(F.col("kind") == "usage", D.examples(F.col("content")))
        .when((F.col("kind") == "configuration") & F.endswith("name", F.lit(".toml")), sections)
        .when(F.col("kind") == "deployment", ships)
        .otherwise(none)
    )


def _joined(items: Column, mark: Column | str, end: str = "") -> Column:
    """Items as lines, each after ``mark``, joined by the written line break."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x, F.lit(end))), BREAK)


def _answer(items: Column) -> Column:
    lines = lambda kind, body: F.when(F.size(items) > 0, F.concat(F.lit(HEADS[kind] + BREAK), body)).otherwise(F.lit(NOTHING[kind]))
    config = F.when(F.size(items) > 0, F.concat(F.lit(HEADS["testing"] + BREAK), _joined(items, "   - ")))
    testing = F.array_join(F.array_compact(F.array(F.when(F.col("needs"), F.lit(DEPENDENCIES)), F.when(F.col("pytest"), F.lit(PYTEST)).otherwise(F.lit(RUN)), F.when(F.col("coverage"), F.lit(COVERAGE)), config)), BREAK * 2)
    steps = F.slice(F.concat(F.when(F.col("editable"), F.array(F.lit(EDITABLE))).otherwise(F.array().cast("array<string>")), items), 1, QUOTED["setup"])
    numbered = F.array_join(F.transform(steps, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". `"), x, F.lit("`"))), BREAK)
    blocks = F.array_join(F.transform(items, lambda x: F.concat(F.lit("```python" + BREAK), x, F.lit(BREAK + "```"))), BREAK * 2)
    return (
        F.when(F.col("kind") == "testing", testing)
        .when(F.col("kind") == "setup", F.when(F.size(steps) > 0, F.concat(F.lit(HEADS["setup"] + BREAK), numbered)).otherwise(F.lit(NOTHING["setup"])))
        .when(F.col("kind") == "usage", lines("usage", blocks))
        .when(F.col("kind") == "configuration", lines("configuration", _joined(items, "- ")))
        .when(F.col("kind") == "deployment", lines("deployment", _joined(items, "- ")))
        .otherwise(F.concat(F.lit(HEADS["general"] + BREAK), F.coalesce(F.col("summary"), F.lit(""))))
    )


def type_lines(entities: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, summary): a line for each type in the order of its first entity, with its first three names and how many more there are."""
    types = entities.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    ranked = entities.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "type").orderBy("ord", "id"))).where("rank <= 3")
    names = ranked.groupBy(*by, "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("names"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(" (and "), (F.col("n") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    lines = types.join(names, [*by, "type"]).select(*by, F.struct("first", F.concat(F.lit("- "), F.initcap("type"), F.lit("s: "), "names", more).alias("line")).alias("l"))
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), BREAK).alias("summary"))


def reports(entities: DataFrame, by: list[str] = (), listed: int | None = None) -> DataFrame:
    """One row for each kind (of each group of ``by``): kind, answer, confidence, n_files, n_commands. ``listed``: so many configuration sections or deployment
    files at most, for answers that must stay short; relevant() has the files in any case."""
    by = list(by)
    rows = relevant(entities, by)
    rows = rows.withColumns({"items": _items(), "commands": F.when(F.col("kind").isin("testing", "setup"), D.commands(F.col("content"))).otherwise(F.array().cast("array<string>"))})
    says = lambda col, word: F.max(F.exists(col, lambda x: F.contains(x, F.lit(word))))
    files = lambda *words: F.max(any_of(F.col("file"), list(words)))
    facts = rows.groupBy(*by, "kind").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.size("commands")).alias("n_commands"), files("requirements-test").alias("needs"), files("pyproject.toml", "setup.py").alias("editable"),
        F.greatest(says("commands", "pytest"), says("items", "pytest")).alias("pytest"), says("items", "coverage").alias("coverage"),
    )
    quoted = rows.select(*by, "kind", "ord", "id", F.posexplode("items").alias("pos", "item"))
    limits = QUOTED if listed is None else QUOTED | {"configuration": listed, "deployment": listed}
    first = quoted.where(F.col("kind").isin(list(limits))).withColumn("rank", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("ord", "id", "pos"))).where(F.col("rank") <= max(limits.values()))
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    quoted = first.where(F.col("rank") <= F.try_element_at(most, F.col("kind"))).drop("rank").unionByName(quoted.where(~F.col("kind").isin(list(limits))))
    quoted = quoted.groupBy(*by, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "pos", "item"))), lambda x: x["item"]).alias("quoted"))
    spark = entities.sparkSession
    all_ = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    if by:
        all_ = facts.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    summary = type_lines(entities, by)
    met = all_.join(facts, [*by, "kind"], "left").join(quoted, [*by, "kind"], "left")
    met = met.join(summary, by, "left") if by else met.join(F.broadcast(summary))  # without groups it is one row
    items = F.coalesce("quoted", F.array().cast("array<string>"))
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("needs", "pytest", "coverage", "editable")}
    found = (F.size(items) > 0) | ((F.col("kind") == "setup") & flags["editable"])
    sure = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("kind"))
    return met.withColumns(flags | {"quoted": items}).select(
        *by, "kind", _answer(F.col("quoted")).alias("answer"), F.when(found, sure(FOUND)).otherwise(sure(NOT_FOUND)).alias("confidence"),
        F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"), F.coalesce("n_commands", F.lit(0)).cast("bigint").alias("n_commands"),
    )


def answer(questions: DataFrame, made: DataFrame, id_col: str = "conv_id", by: list[str] = ()) -> DataFrame:
    """``questions`` (id, question and ``by``) with the report of their kind."""
    asked = questions.withColumn("kind", question_kind(F.col("question")))
    return asked.join(made if by else F.broadcast(made), [*by, "kind"], "left")


def enhanced(base: Column, results: Column) -> Column:
    """An answer with the first three search results of over 100 characters quoted, 500 characters of each."""
    long = F.filter(F.slice(results, 1, 3), lambda x: F.length(x) > 100)
    quoted = F.transform(long, lambda x, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". ```\n"), F.substring(x, 1, 500), F.lit("\n```\n")))
    return F.when(F.size(long) > 0, F.concat(base, F.lit(f"\n\n{REFERENCES}\n"), F.array_join(quoted, ""))).otherwise(base)


def entity_context(name: Column, kind: Column, metadata: Column) -> Column:
    """The line of an entity in a prompt."""
    return F.concat(F.lit("- "), name, F.lit(" ("), kind, F.lit("): "), F.coalesce(F.try_element_at(metadata, F.lit("description")), F.lit("No description")))


def analyses(questions: DataFrame, made: DataFrame, id_col: str = "conv_id", by: list[str] = (), results: Column | None = None) -> DataFrame:
    """The sub-questions of each question with their answers: id, by, question, step_no, sub_question, kind, answer, confidence, n_files. ``results``: an
    array column of ``questions``, search results to quote."""
    asked = questions.select(id_col, *by, "question", (results if results is not None else F.array().cast("array<string>")).alias("results"), F.posexplode(sub_questions(F.col("question"))).alias("pos", "sub_question"))
    asked = asked.withColumn("kind", question_kind(F.col("sub_question")))
    met = asked.join(made if by else F.broadcast(made), [*by, "kind"], "left")
    return met.select(id_col, *by, "question", (F.col("pos") + 1).cast("bigint").alias("step_no"), "sub_question", "kind", enhanced(F.col("answer"), F.col("results")).alias("answer"), "confidence", "n_files")


def synthesis(steps: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each question: final_answer by groups of sub-questions, confidence over all steps, answer_type, steps. A question has five
    sub-questions at most."""
    group, low = F.lit(len(GROUPS) - 1), F.lower("sub_question")
    for i, (_, words, _) in reversed([*enumerate(GROUPS[:-1])]):
        group = F.when(any_of(low, words), F.lit(i)).otherwise(group)
    all_ = steps.withColumn("group", group).groupBy(id_col, "question").agg(F.array_sort(F.collect_list(F.struct("group", "step_no", "answer"))).alias("s"), F.sum("confidence").alias("c"), F.count(F.lit(1)).alias("n"))

    def part(i: int, head: str) -> Column:
        own = F.filter("s", lambda x: x["group"] == i)
        return F.when(F.size(own) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(own, lambda x: x["answer"]), "\n"), F.lit("\n\n"))).otherwise("")

    text = F.concat(F.lit("## "), "question", F.lit("\n\n"), *[part(i, head) for i, (_, _, head) in enumerate(GROUPS)])
    sure = (F.col("c") + DECOMPOSED + SYNTHESIZED) / (F.col("n") + 2)
    return all_.select(id_col, text.alias("final_answer"), sure.alias("confidence"), answer_kind(F.col("question")).alias("answer_type"), (F.col("n") + 2).alias("steps"))


def found_or_typed(matches: DataFrame, entities: DataFrame, questions: DataFrame, id_col: str = "conv_id", limit: int = 10) -> DataFrame:
    """(id, ord, entity_id): the search results of each question; for questions without one, the first entities of the type that the question names
    (class, function, file), if it does."""
    none = questions.join(matches.select(id_col).distinct(), id_col, "left_anti")
    low = F.lower("question")
    wanted = F.when(F.contains(low, F.lit("class")), F.lit("class")).when(F.contains(low, F.lit("function")), F.lit("function")).when(F.contains(low, F.lit("file")), F.lit("file"))
    first = entities.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy("ord", "id"))).where((F.col("rank") <= limit) & F.col("type").isin("class", "function", "file"))
    typed = none.withColumn("type", wanted).join(F.broadcast(first.select("type", "ord", F.col("id").alias("entity_id"))), "type")
    return matches.select(id_col, "ord", "entity_id").unionByName(typed.select(id_col, "ord", "entity_id"))
