"""Exploration of a repository for questions: plans that are carried out step by step, and sessions of sensing and acting.

A listing is a table of files (path, size, content), paths relative with slashes. What a step finds in an area, or a cycle in a focus
area, depends on the listing and the knowledge base only. So areas and the six focus areas are summed up once, and questions meet
the sums, which are as few rows as there are top-level folders or focus areas; no question reads a file.

Edge cases: null contents count as empty; folders of a hidden name (.x) are no area; a repository without folders gives plans without
areas; unordered choices go by name; an empty listing or knowledge base gives plans and sessions that find nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, base_name, count_lines, glob_to_regex, suffix
from .asking import action_kind, finding_insight, first_focus, lessons, next_focus, plan_insight, plan_steps, sense_confidence, should_stop
from .documents import names_frameworks

# Folders of priority, and of less.
HIGH, MEDIUM = ["src", "lib", "app", "main", "core", "api"], ["tests", "test", "docs", "config", "utils", "helpers"]
# Words of a question, and the folders that they ask for.
ASKED = [("test", ["test"]), ("config", ["config"]), ("api", ["api", "route", "endpoint"])]
# Words of a step, and the folders that it looks at.
TARGETS = [(["test"], ["test"]), (["config"], ["config", "settings", "conf"]), (["main", "entry"], ["src", "app", "main", "lib"])]
KEY_SUFFIXES = [".py", ".js", ".ts", ".java", ".cpp", ".rs"]
STRUCTURE_LINES, SUBFOLDERS, KEY_FILES, SUBSTANTIAL = 20, 3, 5, 100
# Folders, files and search words of each focus area.
FOCUS_FOLDERS = {"testing_infrastructure": ["test", "tests", "spec", "__tests__"], "configuration_setup": ["config", "settings", "conf", "env"], "api_structure": ["api", "routes", "endpoints", "controllers"], "data_layer": ["models", "database", "db", "schema"], "deployment_setup": ["deploy", "docker", "k8s", "infra"], "project_overview": ["src", "lib", "app", "main"]}
FOCUS_FILES = {"testing_infrastructure": ["test_*.py", "*_test.py", "pytest.ini", "tox.ini", "conftest.py"], "configuration_setup": ["config.*", "settings.*", "requirements.txt", "setup.py", "pyproject.toml"], "api_structure": ["*api*.py", "*route*.py", "*endpoint*.py", "*controller*.py"], "data_layer": ["*model*.py", "*schema*.py", "*database*.py", "*db*.py"], "deployment_setup": ["Dockerfile", "docker-compose.*", "*.yml", "*.yaml", "deploy*"], "project_overview": ["main.py", "app.py", "__init__.py", "README.*", "*.md"]}
FOCUS_TERMS = {"testing_infrastructure": "test", "configuration_setup": "config", "api_structure": "api", "data_layer": "model", "deployment_setup": "deploy", "project_overview": ""}
FOCUS_ACTIONS = {"testing_infrastructure": ["analyze_test_patterns", "identify_test_frameworks"], "configuration_setup": ["parse_config_files", "identify_dependencies"], "api_structure": ["map_api_endpoints", "analyze_request_handlers"]}
ENTITY_BYTES, TERM_ENTITIES, ACTIONS, CYCLES = 100_000, 10, 3, 5
CONFIG_SUFFIXES = [".ini", ".yaml", ".yml", ".json", ".toml"]
# The last lines of a session's answer.
ADVICE = "\nRecommendations:\n- Review the identified entities for detailed implementation\n- Consider the insights for best practices\n- Explore related areas for comprehensive understanding"


def folders(listing: DataFrame) -> DataFrame:
    """(path, parent, name) of each folder that holds a file at any depth."""
    parts = listing.select(F.filter(F.split("path", "/"), lambda x: x != "").alias("p")).select(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("p")).distinct()
    every = parts.select(F.explode(F.transform("p", lambda _, i: F.slice("p", F.lit(1), i + 1))).alias("p")).distinct()
    return every.select(F.array_join("p", "/").alias("path"), F.array_join(F.slice("p", 1, F.size("p") - 1), "/").alias("parent"), F.element_at("p", -1).alias("name"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def areas(listing: DataFrame) -> DataFrame:
    """Top-level folders that aren't hidden: name, n_files (at any depth), n_items (files and folders at any depth), n_children, subfolders (first three)."""
    top = F.substring_index("path", "/", 1)
    inner = folders(listing)
    files = listing.where(F.contains("path", F.lit("/"))).select(top.alias("name"), F.lit(1).alias("file"), (_parent(F.col("path")) == top).alias("child"), F.lit(None).cast("string").alias("sub"))
    dirs = inner.where("parent <> ''").select(top.alias("name"), F.lit(0).alias("file"), (F.col("parent") == top).alias("child"), F.when((F.col("parent") == top) & ~F.startswith(F.col("name"), F.lit(".")), F.col("name")).alias("sub"))
    both = files.unionByName(dirs)
    sums = both.groupBy("name").agg(F.sum("file").alias("n_files"), F.count(F.lit(1)).alias("n_items"), F.count_if("child").alias("n_children"))
    ranked = dirs.where("sub is not null").withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("sub"))).where(F.col("rank") <= SUBFOLDERS)
    subs = ranked.groupBy("name").agg(F.array_sort(F.collect_list("sub")).alias("subfolders"))
    return sums.join(subs, "name", "left").where(~F.startswith("name", F.lit("."))).withColumn("subfolders", F.coalesce("subfolders", F.array().cast("array<string>")))


def structure(listing: DataFrame) -> DataFrame:
    """(line_no, line, area): the first 20 lines of the report on the top level: folders with their files and first subfolders, and files, by name."""
    shown = areas(listing).select("name", F.concat(F.array(F.concat(F.lit("📁 "), "name", F.lit("/ ("), F.col("n_files").cast("string"), F.lit(" files)"))), F.transform("subfolders", lambda x: F.concat(F.lit("  📁 "), x, F.lit("/")))).alias("lines"), F.lit(True).alias("folder"))
    files = listing.where(~F.contains("path", F.lit("/")) & ~F.startswith("path", F.lit("."))).select(F.col("path").alias("name"), F.array(F.concat(F.lit("📄 "), "path")).alias("lines"), F.lit(False).alias("folder"))
    first = shown.unionByName(files).orderBy("name").limit(STRUCTURE_LINES)
    lines = first.select("name", "folder", F.posexplode("lines").alias("pos", "line")).orderBy("name", "pos").limit(STRUCTURE_LINES)
    numbered = lines.withColumn("line_no", F.row_number().over(Window.orderBy("name", "pos")).cast("bigint"))  # 20 rows
    return numbered.select("line_no", "line", F.when(F.col("folder") & (F.col("pos") == 0), F.regexp_extract("name", "^(\\S*)", 1)).alias("area"))


def _holding(names: Column, words: list[str]) -> Column:
    """The names that contain one of ``words``."""
    return F.filter(names, lambda x: any_of(F.lower(x), words))


def priority_areas(question: Column, names: Column) -> Column:
    """At most five of the folders ``names``: those the question asks for, those of priority, and if these are under three, those of less."""
    low, none = F.lower(question), F.array().cast("array<string>")
    asked = [F.when(F.contains(low, F.lit(word)), _holding(names, words)).otherwise(none) for word, words in ASKED]
    first = F.concat(*asked, F.filter(names, lambda x: F.lower(x).isin(HIGH)))
    more = F.filter(names, lambda x: F.lower(x).isin(MEDIUM))
    return F.slice(F.array_distinct(F.when(F.size(first) < 3, F.concat(first, more)).otherwise(first)), 1, 5)


def target_paths(step: Column, names: Column) -> Column:
    """The areas that a step looks at: by its words, else the first three."""
    low, none = F.lower(step), F.array().cast("array<string>")
    found = F.concat(*[F.when(any_of(low, words), _holding(names, [p])).otherwise(none) for words, patterns in TARGETS for p in patterns])
    return F.when(F.size(found) > 0, found).otherwise(F.slice(names, 1, 3))


def plans(questions: DataFrame, listing: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each step: id, goal, areas, step_no, step, action, targets."""
    names = structure(listing).where("area is not null").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "area"))), lambda x: x["area"]).alias("names"))  # 20 at most
    asked = questions.join(F.broadcast(names)).withColumn("areas", priority_areas(F.col("question"), F.col("names")))
    steps = asked.select(id_col, F.concat(F.lit("Answer: "), "question").alias("goal"), "areas", F.posexplode(plan_steps(F.col("question"))).alias("pos", "step"))
    return steps.select(id_col, "goal", "areas", (F.col("pos") + 1).cast("bigint").alias("step_no"), "step", action_kind(F.col("step")).alias("action"), target_paths(F.col("step"), F.col("areas")).alias("targets"))


def file_summary(name: Column, content: Column) -> Column:
    """What examining a file says."""
    lines = F.split(content, "\n")
    n = lambda *starts: count_lines(lines, *starts).cast("string")
    return F.concat(F.lit("File "), name, F.lit(": "), n("class "), F.lit(" classes, "), n("def "), F.lit(" functions, "), n("import ", "from "), F.lit(" imports"))


def examined(listing: DataFrame) -> DataFrame:
    """(area, path, result) of the Python files of over 100 characters below each area."""
    python = listing.where((suffix(F.col("path")) == ".py") & (F.length("content") > SUBSTANTIAL) & F.contains("path", F.lit("/")))
    return python.select(F.substring_index("path", "/", 1).alias("area"), "path", file_summary(base_name(F.col("path")), F.col("content")).alias("result"))


def contents(listing: DataFrame) -> DataFrame:
    """(area, result): files and folders directly in each area, and its first five source files by name."""
    direct = listing.where(F.size(F.split("path", "/")) == 2).select(F.substring_index("path", "/", 1).alias("area"), base_name(F.col("path")).alias("file"), suffix(F.col("path")).isin(KEY_SUFFIXES).alias("key"))
    inner = folders(listing).where((F.col("parent") != "") & ~F.contains("parent", F.lit("/"))).groupBy(F.col("parent").alias("area")).agg(F.count(F.lit(1)).alias("dirs"))
    keys = direct.where("key").withColumn("rank", F.row_number().over(Window.partitionBy("area").orderBy("file"))).where(F.col("rank") <= KEY_FILES)
    keys = keys.groupBy("area").agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("keys"))
    n = direct.groupBy("area").agg(F.count(F.lit(1)).alias("files"))
    met = areas(listing).select(F.col("name").alias("area")).join(n, "area", "left").join(inner, "area", "left").join(keys, "area", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return met.select("area", F.concat(F.lit("Directory "), "area", F.lit(": "), number("files"), F.lit(" files, "), number("dirs"), F.lit(" directories. Key files: "), F.coalesce("keys", F.lit(""))).alias("result"))


def traced(entities: DataFrame, limit: int = 50) -> DataFrame:
    """(type, result) for each type with several of the first ``limit`` entities."""
    first = entities.orderBy("ord", "id").limit(limit)
    many = first.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).where("n > 1")
    return many.select("type", "first", F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" "), "type", F.lit(" entities with potential relationships")).alias("result"))


def validated(step: Column) -> Column:
    return F.concat(F.lit("Validation completed for: "), step)


def executed(steps: DataFrame, listing: DataFrame, entities: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``steps`` of plans() with n_results, n_insights and first_result. An area that several words of a step ask for counts each time."""
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(plan_insight(F.col("result")).isNotNull()).alias("insights")]
    by_area = examined(listing).groupBy("area").agg(*sums, F.min_by("result", "path").alias("first")).withColumn("action", F.lit("examine_files"))
    by_area = by_area.unionByName(contents(listing).groupBy("area").agg(*sums, F.min("result").alias("first")).withColumn("action", F.lit("analyze_directory")))
    trace = traced(entities).agg(*sums, F.min_by("result", "first").alias("first"))  # one row
    reach = steps.select(id_col, "step_no", "action", F.posexplode("targets").alias("pos", "area")).join(F.broadcast(by_area), ["area", "action"])
    reach = reach.groupBy(id_col, "step_no").agg(F.sum("n").alias("n"), F.sum("insights").alias("insights"), F.min_by("first", "pos").alias("first"))
    met = steps.join(reach, [id_col, "step_no"], "left").join(F.broadcast(trace.select(F.col("n").alias("tn"), F.col("insights").alias("ti"), F.col("first").alias("tf"))))
    said = validated(F.col("step"))
    pick = lambda own, trace_, valid: F.when(F.col("action") == "trace_relationships", trace_).when(F.col("action") == "validate_findings", valid).otherwise(own)
    return met.select(
        *steps.columns, pick(F.coalesce("n", F.lit(0)), F.col("tn"), F.lit(1)).cast("bigint").alias("n_results"),
        pick(F.coalesce("insights", F.lit(0)), F.col("ti"), plan_insight(said).isNotNull().cast("int")).cast("bigint").alias("n_insights"), pick(F.col("first"), F.col("tf"), said).alias("first_result"),
    )


def plan_results(done: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each plan: steps, results, insights, success_rate (all steps end)."""
    return done.groupBy(id_col, "goal").agg(F.count(F.lit(1)).alias("steps"), F.sum("n_results").alias("results"), F.sum("n_insights").alias("insights"), F.lit(1.0).alias("success_rate"))


def patterns_of(name: Column, content: Column) -> Column:
    """What analysing a file for patterns says."""
    lines = F.split(content, "\n")
    n = lambda *starts: count_lines(lines, *starts)
    quotes = F.size(F.split(content, '"""')) - 1
    counts = [("classes", n("class ")), ("functions", n("def ")), ("imports", n("import ", "from ")), ("comments", n("#")), ("docstrings", F.floor(quotes / 2))]
    parts = [F.concat(F.lit(f"'{k}': "), v.cast("string")) for k, v in counts]
    return F.concat(F.lit("File "), name, F.lit(" patterns: {"), F.array_join(F.array(*parts), ", "), F.lit("}"))


def observed_folders(listing: DataFrame) -> DataFrame:
    """(focus, name, said): folders that a focus area sees; the overview sees all."""
    top = areas(listing)
    seen = [F.when(any_of(F.lower("name"), words), F.struct(F.lit(f).alias("focus"), F.concat(F.lit(f"Found {f} directory: "), "name", F.lit(" ("), F.col("n_items").cast("string"), F.lit(" items)")).alias("said"))) for f, words in FOCUS_FOLDERS.items()]
    rest = F.when(~any_of(F.lower("name"), FOCUS_FOLDERS["project_overview"]), F.struct(F.lit("project_overview").alias("focus"), F.concat(F.lit("Directory: "), "name", F.lit(" ("), F.col("n_children").cast("string"), F.lit(" items)")).alias("said")))
    return top.select("name", F.explode(F.array_compact(F.array(*seen, rest))).alias("o")).select("o.focus", "name", "o.said")


def observed_files(listing: DataFrame) -> DataFrame:
    """(focus, pattern_no, path, name, size, content, said): files that a focus area sees, once for each pattern that they fit."""
    name = base_name(F.col("path"))
    fits = [F.when(name.rlike(glob_to_regex(g)), F.struct(F.lit(f).alias("focus"), F.lit(i).alias("no"))) for f, globs in FOCUS_FILES.items() for i, g in enumerate(globs)]
    met = listing.select("path", "size", "content", name.alias("name"), F.explode(F.array_compact(F.array(*fits))).alias("o"))
    return met.select("o.focus", F.col("o.no").alias("pattern_no"), "path", "name", "size", "content", F.concat(F.lit("Found "), "o.focus", F.lit(" file: "), "name").alias("said"))


def focus_entities(entities: DataFrame) -> DataFrame:
    """(focus, ord, name, type, content): the first ten entities that the search word of a focus area finds."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "path", "content")]
    found = []
    for f, term in FOCUS_TERMS.items():
        hit = functools.reduce(lambda a, b: a | b, [F.contains(x, F.lit(term)) for x in low])
        found.append(entities.where(hit).orderBy("ord", "id").limit(TERM_ENTITIES).select(F.lit(f).alias("focus"), "ord", "name", "type", F.coalesce("content", F.lit("")).alias("content")))
    return functools.reduce(DataFrame.unionByName, found)


def next_actions(focus: Column, files: Column, dirs: Column) -> Column:
    """At most three actions after so many observations of files and folders."""
    own, none = F.array().cast("array<string>"), F.array().cast("array<string>")
    for f, names in FOCUS_ACTIONS.items():
        own = F.when(focus == f, F.array(*map(F.lit, names))).otherwise(own)
    seen = F.concat(F.when(files > 0, F.array(F.lit("analyze_file_contents"))).otherwise(none), F.when(dirs > 0, F.array(F.lit("explore_directory_structure"))).otherwise(none))
    return F.slice(F.concat(seen, own), 1, ACTIONS)


def sensed(listing: DataFrame, entities: DataFrame, repository: str = "repository") -> DataFrame:
    """One row for each focus area: observations, entities, confidence, actions, findings, insights, first_insight."""
    spark = listing.sparkSession
    own = listing.withColumn("content", F.coalesce("content", F.lit("")))
    files = observed_files(own)
    as_entity = files.where(F.col("size") < ENTITY_BYTES).select("focus", F.struct(F.lit(0).alias("late"), F.col("pattern_no").cast("bigint").alias("at"), "path").alias("place"), "name", F.lit("file").alias("type"), "content")
    known = focus_entities(entities).select("focus", F.struct(F.lit(1).alias("late"), F.col("ord").alias("at"), F.lit("").alias("path")).alias("place"), "name", "type", "content")
    met = as_entity.unionByName(known)
    low = F.lower("name")
    sums = met.groupBy("focus").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("type") == "file").alias("file_entities"), F.count_if(F.contains(low, F.lit("test"))).alias("tests"), F.count_if(any_of(low, CONFIG_SUFFIXES)).alias("configs"),
        F.min_by(F.struct("name", "content"), F.when(F.col("type") == "file", F.struct("place", "name"))).alias("first_file"), *[F.max(hit).alias(f"uses_{w}") for w, hit in names_frameworks(F.col("content"))],
    )
    said = observed_folders(own).select("focus", "said").unionByName(files.select("focus", "said"))
    said = said.groupBy("focus").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.contains(F.lower("said"), F.lit("file"))).alias("file_obs"), F.count_if(F.contains(F.lower("said"), F.lit("directory"))).alias("dir_obs"))
    all_ = spark.createDataFrame([(f,) for f in FOCUS_FOLDERS], "focus string").join(said, "focus", "left").join(sums, "focus", "left")
    counts = ["observations", "file_obs", "dir_obs", "entities", "file_entities", "tests", "configs"]
    all_ = all_.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts}).withColumn("actions", next_actions(F.col("focus"), F.col("file_obs"), F.col("dir_obs")))
    frameworks = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"uses_{w}"), F.lit(w)) for w, _ in names_frameworks(F.lit(""))])), ", ")
    finding = {
        "analyze_file_contents": (F.col("file_entities"), patterns_of(F.col("first_file.name"), F.col("first_file.content"))),
        "explore_directory_structure": (F.lit(1), F.concat(F.lit("Deep structure analysis for "), "focus", F.lit(f" in {repository}"))),
        "analyze_test_patterns": (F.lit(1), F.concat(F.lit("Found "), F.col("tests").cast("string"), F.lit(" test files with various patterns"))),
        "identify_test_frameworks": (F.lit(1), F.concat(F.lit("Detected frameworks: "), frameworks)),
        "parse_config_files": (F.lit(1), F.concat(F.lit("Found "), F.col("configs").cast("string"), F.lit(" configuration files"))),
    }
    does = {a: F.when(F.array_contains("actions", a), n).otherwise(0) for a, (n, _) in finding.items()}
    gives = {a: F.when((does[a] > 0), finding_insight(text)) for a, (_, text) in finding.items()}
    return all_.select(
        "focus", "observations", "entities", sense_confidence(F.col("observations"), F.col("entities")).alias("confidence"), "actions",
        sum(does.values(), F.lit(0)).cast("bigint").alias("findings"), sum((F.when(gives[a].isNotNull(), does[a]).otherwise(0) for a in finding), F.lit(0)).cast("bigint").alias("insights"), F.coalesce(*gives.values()).alias("first_insight"),
    )


def cycles(focus_sums: DataFrame) -> DataFrame:
    """(start, cycle, ...): the cycles of a session that begins with each focus area; at most five rows for each of six."""
    sums = F.broadcast(focus_sums)
    now = focus_sums.select(F.col("focus").alias("start"), "focus", F.array().cast("array<string>").alias("seen"))
    out = []
    for n in range(1, CYCLES + 1):
        met = now.join(sums, "focus").withColumn("seen", F.array_union("seen", F.array("focus")))
        ok = F.lit(True)
        met = met.withColumns({
            "cycle": F.lit(n).cast("bigint"), "next_focus": next_focus(F.col("focus"), F.col("confidence"), ok), "learned": lessons(F.col("focus"), F.col("confidence"), ok, F.col("insights")),
            "stop": should_stop(F.col("confidence"), ok, F.col("insights"), F.size("seen")),
        })
        out.append(met.select("start", "cycle", "focus", "observations", "entities", "confidence", "insights", "first_insight", "learned", "next_focus", "stop"))
        now = met.where("not stop").select("start", F.col("next_focus").alias("focus"), "seen")
    return functools.reduce(DataFrame.unionByName, out)


def session_cycles(questions: DataFrame, focus_sums: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The cycles of each question's session."""
    asked = questions.select(id_col, first_focus(F.col("question")).alias("start"))
    return asked.join(F.broadcast(cycles(focus_sums)), "start").drop("start")


def session_answers(questions: DataFrame, focus_sums: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each question: cycles, insights, success_rate, final_answer."""
    made = cycles(focus_sums).groupBy("start").agg(F.count(F.lit(1)).alias("cycles"), F.sum("insights").alias("insights"), F.array_sort(F.collect_list(F.struct("cycle", "focus", "first_insight"))).alias("c"))
    own = F.transform(F.filter("c", lambda x: x["first_insight"].isNotNull()), lambda x: F.concat(F.lit("- "), x["focus"], F.lit(": "), x["first_insight"]))
    head = F.array(F.concat(F.lit("Based on "), F.col("cycles").cast("string"), F.lit(" exploration cycles, here's what I found:")), F.lit("- Discovered 0 code entities"), F.concat(F.lit("- Generated "), F.col("insights").cast("string"), F.lit(" insights")))
    made = made.select("start", "cycles", "insights", F.lit(1.0).alias("success_rate"), F.array_join(F.concat(head, own, F.array(F.lit(ADVICE))), "\n").alias("final_answer"))
    return questions.select(id_col, first_focus(F.col("question")).alias("start")).join(F.broadcast(made), "start").drop("start")
