"""Answers, plans and sessions against worked examples."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import answers, extract, graph, project, prompts, sessions, vectors
from quillstone.plans import config
from quillstone.plans.indexer import batch_totals, index_batch, repository_list
from quillstone.sources import knowledge, repo

FILES = [
    ("README.md", "# Install\\npip install demo\\nuse `python -m demo` now\\n# Usage\\npip install no\n```python\\nprint('an example that is long enough')\\n```"),
    ("requirements-test.txt", "pytest>=7\\n# note\\n-r base.txt\\ncoverage\\nmock==1"),
    ("pyproject.toml", "[tool.pytest]\\n[[x]]\\n[tool.coverage]\\n[build]\\n[more]"),
    ("src/main.py", "import os\nfrom a import b\n\nclass A:\n    def run(self):\n        pass\n\n# note\ndef top():\n    \"\"\"doc\"\"\"\n    return 1\n" + "#" * 100),
    ("tests/test_one.py", "import pytest\n\ndef test_a():\n    pass\n" + "x = 1\n" * 30),
    ("config/settings.yaml", "a: 1"),
    (".github/workflows/ci.yml", "on: push"),
    ("Dockerfile", "FROM x"),
    ("src/api/routes.js", "import x from 'y'\nconst go = () => 1;\nclass W {\n}\n// c\n"),
]


@pytest.fixture(scope="module")
def listing(spark):
    rows = [(i, f"e{i}", p.rsplit("/", 1)[-1], "file", p, t, len(t.encode())) for i, (p, t) in enumerate(FILES)]
    return spark.createDataFrame(rows, "ord long, id string, name string, type string, path string, content string, size long").cache()


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "How to run the test suite?"), (2, "how do I install it"), (3, "any example of use"), (4, "which config settings"), (5, "deploy with docker"), (6, "what is this")]
    return spark.createDataFrame(rows, "conv_id long, question string").cache()


def test_reports(listing):
    made = {r.kind: r for r in answers.reports(listing).collect()}
    assert made["testing"].answer == "\\n\\n".join([answers.DEPENDENCIES, answers.PYTEST, answers.COVERAGE, "**Test Configuration:**\\n   - Test dependencies: pytest, coverage, mock"])
    assert (made["testing"].n_files, made["testing"].confidence) == (2, 0.8)
    assert made["setup"].answer == "**Installation Steps:**\\n1. `pip install -e .`\\n2. `pip install demo`\\n3. `python -m demo`" and made["setup"].confidence == 0.7
    assert made["usage"].answer.startswith("**Usage Examples:**\\n```python\\nprint(") and made["usage"].confidence == 0.6
    assert made["configuration"].answer == "**Configuration sections found:**\\n- [tool.pytest]\\n- [tool.coverage]\\n- [build]"
    assert made["deployment"].answer == "**Deployment configuration:**\\n- CI/CD workflow: ci.yml\\n- Docker configuration: Dockerfile"
    assert made["general"].answer == "**Found relevant code:**\\n- Files: README.md, requirements-test.txt, pyproject.toml (and 6 more)" and made["general"].n_files == 9


def test_reports_of_nothing(spark, listing):
    made = {r.kind: (r.answer, r.confidence, r.n_files) for r in answers.reports(listing.limit(0)).collect()}
    assert made["testing"] == (answers.RUN, 0.8, 0) and made["setup"] == (answers.NOTHING["setup"], 0.4, 0) and made["general"][0] == answers.HEADS["general"] + "\\n"
    odd = spark.createDataFrame([(1, None, None, None, None, None)], "ord long, id string, name string, type string, path string, content string")
    assert answers.reports(odd).count() == 6
    two = listing.withColumn("repo", F.pmod("ord", F.lit(2)))
    assert answers.reports(two, ["repo"]).count() == 12


def test_reasoning(listing, asked):
    made = answers.reports(listing)
    steps = answers.analyses(asked, made)
    assert [r.sub_question for r in steps.where("conv_id = 6").orderBy("step_no").collect()] == ["What are the key components involved?", "What are the best practices?"]
    got = {r.conv_id: r for r in answers.synthesis(steps).collect()}
    general = next(r.answer for r in made.collect() if r.kind == "general")
    assert got[6].final_answer == f"## what is this\n\n### 📚 Additional Information\n{general}\n{general}\n\n"
    assert got[6].confidence == pytest.approx((0.6 + 0.3 + 0.3 + 0.7) / 4) and (got[6].answer_type, got[6].steps) == ("general", 4)
    assert got[2].final_answer.index("### 🚀 Setup") < got[2].final_answer.index("### 💡 Usage") and got[2].answer_type == "installation"
    long = ["x" * 600, "short", "y" * 101, "z" * 200]
    text = asked.limit(1).select(answers.enhanced(F.lit("base"), F.array(*map(F.lit, long))).alias("t")).first().t
    assert text == "base\n\n📖 **Relevant Code References:**\n\n1. ```\n" + "x" * 500 + "\n```\n\n2. ```\n" + "y" * 101 + "\n```\n"
    line = asked.limit(1).select(answers.entity_context(F.lit("n"), F.lit("file"), F.create_map(F.lit("a"), F.lit("b"))).alias("t")).first().t
    assert line == "- n (file): No description"


def test_search_falls_back_to_types(spark, listing, asked):
    more = asked.unionByName(spark.createDataFrame([(7, "list every file"), (8, "Import OS")], asked.schema))
    hits = spark.createDataFrame([(8, 3, "e3")], "conv_id long, ord long, entity_id string")
    got = answers.found_or_typed(hits, listing, more, limit=4).collect()
    assert sorted((r.conv_id, r.ord) for r in got) == [*[(7, i) for i in range(4)], (8, 3)]


def test_plans(listing, asked):
    lines = [r.line for r in sessions.structure(listing).orderBy("line_no").collect()]
    assert lines == ["📄 Dockerfile", "📄 README.md", "📁 config/ (1 files)", "📄 pyproject.toml", "📄 requirements-test.txt", "📁 src/ (2 files)", "  📁 api/", "📁 tests/ (1 files)"]
    steps = {(r.conv_id, r.step_no): r for r in sessions.plans(asked, listing).collect()}
    assert steps[1, 1].goal == "Answer: How to run the test suite?" and steps[1, 1].areas == ["tests", "src", "config"]
    assert (steps[1, 1].step, steps[1, 1].action, steps[1, 1].targets) == ("Examine test directories and files", "examine_files", ["tests"])
    assert (steps[1, 2].action, steps[1, 2].targets) == ("examine_files", ["tests", "config", "config"])  # config and conf both ask for it
    assert steps[1, 3].action == "trace_relationships" and steps[6, 4].action == "validate_findings"
    done = {(r.conv_id, r.step_no): r for r in sessions.executed(sessions.plans(asked, listing), listing, listing).collect()}
    assert done[1, 1].first_result == "File test_one.py: 0 classes, 1 functions, 1 imports" and (done[1, 1].n_results, done[1, 1].n_insights) == (1, 1)
    assert done[1, 3].first_result == "Found 9 file entities with potential relationships" and (done[1, 3].n_results, done[1, 3].n_insights) == (1, 0)
    assert done[6, 4].first_result == "Validation completed for: Validate findings against question"
    made = {r.conv_id: r for r in sessions.plan_results(sessions.executed(sessions.plans(asked, listing), listing, listing)).collect()}
    assert (made[1].steps, made[6].steps, made[1].success_rate) == (8, 4, 1.0)
    inside = {r.area: r.result for r in sessions.contents(listing).collect()}
    assert inside["src"] == "Directory src: 1 files, 1 directories. Key files: main.py" and inside["config"] == "Directory config: 1 files, 0 directories. Key files: "


def test_sessions(listing, asked):
    sums = {r.focus: r for r in sessions.sensed(listing, listing, "here").collect()}
    one = sums["testing_infrastructure"]  # a folder, a file; entities: the file, and what the word test finds
    found = [i for i, (p, t) in enumerate(FILES) if "test" in (p + t).lower()]
    assert (one.observations, one.entities) == (2, 1 + len(found)) and one.confidence == pytest.approx(min(1, 0.2 + 0.05 * (1 + len(found))))
    assert one.actions == ["analyze_file_contents", "explore_directory_structure", "analyze_test_patterns"]
    assert one.findings == 1 + len(found) + 2 and one.insights == 1 + len(found) + 1
    assert one.first_insight == "Code organization insight: File test_one.py patterns: {'classes': 0, 'functions': 1, 'imports': 1, 'comments': 0, 'docstrings': 0}"
    over = sums["project_overview"]
    said = {r.said for r in sessions.observed_folders(listing).where("focus = 'project_overview'").collect()}
    assert said == {"Found project_overview directory: src (3 items)", "Directory: config (1 items)", "Directory: tests (1 items)"}
    assert over.observations == 3 + 3  # main.py, and README.md by two patterns
    assert sums["data_layer"].observations == 0 and sums["data_layer"].insights == 0
    rows = [r.asDict() for r in sessions.session_cycles(asked, sessions.sensed(listing, listing)).where("conv_id = 1").orderBy("cycle").collect()]
    seen, focus = set(), "testing_infrastructure"
    for i, r in enumerate(rows):
        assert (r["cycle"], r["focus"]) == (i + 1, focus)
        seen.add(focus)
        sure = sums[focus].confidence
        assert r["stop"] == ((sure > 0.8 and sums[focus].insights > 2) or len(seen) >= 4)
        ring = list(sessions.FOCUS_FOLDERS)
        focus = ring[(ring.index(focus) + 1) % 6] if sure > 0.7 else "project_overview"
        assert r["next_focus"] == focus
    assert rows[-1]["stop"] or len(rows) == 5
    text = {r.conv_id: r.final_answer for r in sessions.session_answers(asked, sessions.sensed(listing, listing)).collect()}
    assert text[1].startswith(f"Based on {len(rows)} exploration cycles, here's what I found:\n- Discovered 0 code entities\n- Generated ") and text[1].endswith("comprehensive understanding")
    assert sessions.session_cycles(asked, sessions.sensed(listing.limit(0), listing.limit(0))).where("conv_id = 6").count() == 5


def test_overview(listing):
    made = project.overview(listing).first()
    assert (made.files, made.primary_language, made.package_manager, made.build_system) == (9, "Python", "unknown", "modern_python")
    assert (made.has_tests, made.has_docs, made.has_config) == (True, False, False)
    assert made.suggestions == [project.BY_SIZE[0][1], project.BY_TECHNOLOGY[0][1], project.BY_FLAG[0][1]]
    none = project.overview(listing.limit(0)).first()
    assert (none.files, none.primary_language, none.has_tests) == (0, "Unknown", False)
    own = {r.path: r for r in project.file_analysis(listing).collect()}
    main = own["src/main.py"]
    assert (main.language, main.line_count, main.char_count) == ("python", 12, len(FILES[3][1]))
    assert main.patterns.imports == ["import os", "from a import b"] and main.patterns.functions == ["run", "top"] and main.patterns.classes == ["A"]
    assert (main.patterns.comment_lines, main.patterns.blank_lines) == (2, 2)
    script = own["src/api/routes.js"].patterns
    assert (script.imports, script.functions, script.classes, script.comment_lines) == (["import x from 'y'"], ["go"], ["W"], 1)
    assert own["README.md"].patterns is None


def test_inspection_items(spark):
    python = "import os.path as p\nfrom a.b import c as d, e\nfrom . import z\n@dec\nclass K(Base, m.X):\n    @staticmethod\n    def f(x, y=1):\n        pass\n"
    script = "import q from './lib'\nconst r = require('fs');\nclass W {}\nfunction go() {}\nconst h = () => 1;\n"
    files = spark.createDataFrame([("a.py", python, "python"), ("b.ts", script, "typescript"), ("c.py", "def (", "python"), ("d.py", None, "python")], "path string, content string, language string")
    got = [(r.path, r.kind, r.line, r.name, r.module, r.alias, r.args, r.bases, r.decorators) for r in extract.items(files).collect()]
    assert got == [
        ("a.py", "import", 1, None, "os.path", "p", None, None, None), ("a.py", "from_import", 2, "c", "a.b", "d", None, None, None), ("a.py", "from_import", 2, "e", "a.b", None, None, None, None),
        ("a.py", "class", 5, "K", None, None, None, ["Base", "m.X"], ["dec"]), ("a.py", "function", 7, "f", None, None, ["x", "y"], None, ["staticmethod"]),
        ("b.ts", "es6_import", 1, None, "./lib", None, None, None, None), ("b.ts", "commonjs_require", 2, None, "fs", None, None, None, None),
        ("b.ts", "class", 3, "W", None, None, None, None, None), ("b.ts", "function", 4, "go", None, None, None, None, None), ("b.ts", "function", 5, "h", None, None, None, None, None),
    ]


def test_vector_knowledge_base(spark, tmp_path):
    row = lambda i, name, kind: (i, f"id{i}", name, kind, f"p/{name}", f"text of {name}", "python", 5, None, {})
    kb = knowledge.create(spark, "vector", str(tmp_path / "kb"))
    kb.add(spark.createDataFrame([row(0, "alpha", "class"), row(1, "beta", "function"), row(2, "gamma", "function")], knowledge.ENTITIES))
    kb.add(spark.createDataFrame([row(5, "beta2", "class")[:1] + ("id1",) + row(5, "beta2", "class")[2:]], knowledge.ENTITIES))
    kb.save()
    again = knowledge.create(spark, "vector", str(tmp_path / "kb"))
    assert {(r.ord, r.id, r.name, r.type) for r in again.entities.collect()} == {(0, "id0", "alpha", "class"), (1, "id1", "beta2", "class"), (2, "id2", "gamma", "function")}
    assert {r.id: len(r.vector) for r in again.embeddings.collect()} == {"id0": 384, "id1": 384, "id2": 384}
    assert [r.id for r in again.search("  ", "class").collect()] == ["id0", "id1"] and again.search("").count() == 0
    found = again.search("alpha", limit=2).collect()
    assert len(found) == 2 and found[0].score >= found[1].score > 0.5 and {r.type for r in again.search("x", "function").collect()} == {"function"}
    near = again.similar("id0").collect()
    assert {r.id for r in near} == {"id1", "id2"} and near[0].score >= near[1].score and again.similar("nobody").count() == 0
    with pytest.raises(ValueError):
        knowledge.create(spark, "nope", "x")
    assert isinstance(knowledge.create(spark, "neo4j", str(tmp_path / "g")), knowledge.GraphKnowledgeBase)


def test_saved_versions(spark, tmp_path):
    kb = knowledge.create(spark, "graph", str(tmp_path / "kb"))
    row = lambda i, kind, text: (i, f"id{i}", f"name{i}", kind, "p", text, "python", 5, None, {})
    for i in range(3):
        kb.add(spark.createDataFrame([row(i, "class" if i else "function", "Needle" if i < 2 else "hay")], knowledge.ENTITIES))
        kb.save(f"m{i}")
    assert knowledge.create(spark, "text", str(tmp_path / "kb")).mark == "m2"
    assert len(list((tmp_path / "kb" / "versions").glob("*.json"))) == 3
    assert [r.id for r in kb.search("needle", "class").collect()] == ["id1"] and kb.search("NAME", "nothing").count() == 3  # the type holds for contents only
    kb.clear()
    assert kb.entities.count() == 0 and kb.version is None


def test_arrivals_are_taken_once(spark, tmp_path):
    from quillstone.streaming.arrivals import index_arrivals

    kb = knowledge.create(spark, "text", str(tmp_path / "kb"))
    spark.createDataFrame([(0, "a", "n", "file", "p", "c", "python", 1, None, {})], knowledge.ENTITIES).write.parquet(str(tmp_path / "in"))
    index_arrivals(spark, str(tmp_path / "in"), knowledge.ENTITIES, kb, str(tmp_path / "at"))
    assert kb.entities.count() == 1 and kb.mark.endswith("#0")


def test_nearest_of_each(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(90, 8))
    x[40:50] = x[3]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vector array<double>").repartition(5)
    got = {}
    for r in vectors.nearest_of_each(rows, rows, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    s = np.round(x @ x.T, 5)
    for i in range(90):
        want = sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], j))[:4]
        assert [j for _, j in sorted(got[i])] == want
    assert vectors.nearest_of_each(rows.limit(0), rows, 4).count() == 0


def test_greedy_clusters(spark):
    import random

    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(45)] + [("n01", "gone")]
    ents = spark.createDataFrame([(f"n{i:02}",) for i in range(40)], "id string")
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    links = [(a, b) for a, b in pairs if a != b and "gone" not in (a, b)]
    near = {f"n{i:02}": [] for i in range(40)}
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    done, want = set(), set()
    for v in sorted(near):
        if v in done or sum(len(near[x]) for x in near[v]) < 3:
            continue
        reach = {y for x in near[v] for y in [x, *near[x]]} - {v}
        own = {v} | (reach - done)
        done |= own
        if len(own) >= 3:
            want |= {(v, x) for x in own}
    assert {(r.cluster, r.id) for r in graph.greedy_clusters(edges, ents).collect()} == want
    assert graph.greedy_clusters(edges.limit(0), ents).count() == 0


def test_path_steps_are_edges(spark):
    import random

    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(80)]
    ents = spark.createDataFrame([(f"n{i}", f"n{i}", "x") for i in range(60)], "id string, name string, type string")
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    both = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    path = [r.id for r in graph.shortest_path(edges, ents, pairs[0][0], pairs[40][1], 8).orderBy("step").collect()]
    assert all(step in both for step in zip(path, path[1:], strict=False)) and (not path or (path[0], path[-1]) == (pairs[0][0], pairs[40][1]))


def test_prompts_and_traces(spark, tmp_path):
    asked = spark.createDataFrame([("q" * 150, "some context"), ("q2", None)], "question string, context string")
    assert [r.answer for r in prompts.ask(asked, prompts.model("mock"), context="context").collect()] == ["Mock response to: " + "q" * 100 + "...", "Mock response to: q2..."]
    said = asked.select(prompts.messages(F.col("question"), F.col("context")).alias("m")).collect()
    assert [[x.role for x in r.m] for r in said] == [["system", "user"], ["user"]]
    assert asked.limit(1).select(prompts.mock(F.array(F.struct(F.lit("system").alias("role"), F.lit("x").alias("content")))).alias("a")).first().a == "Mock response to: No user message..."
    with pytest.raises(ValueError):
        prompts.model("provider")
    files = spark.createDataFrame([("r", "b.py", "two"), ("r", "a.py", "one")], "repo string, path string, summary string")
    assert prompts.summaries_context(files, ["repo"]).first().context == "File summaries:\n\na.py: one\nb.py: two"
    starts = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', 'p'), ('b', timestamp'2024-01-01 00:00:00', 'p'), ('c', timestamp'2024-01-01 00:00:00', 'p') t(request_id, start_time, prompt)")
    ends = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:02', 'x', 75L, cast(null as string)), ('b', timestamp'2024-01-01 00:00:01', null, null, 'broke'), ('z', timestamp'2024-01-01 00:00:01', null, 1L, null) t(request_id, end_time, content, total_tokens, error)")
    made = prompts.traces(starts, ends)
    assert prompts.trace_stats(made).first().asDict() == {"requests": 3, "successes": 1, "failures": 1, "tokens": 75}
    assert prompts.get_trace(made, "a").first().duration_ms == 2000.0
    prompts.save_traces(made, str(tmp_path / "t"))
    prompts.save_traces(made, None)
    assert spark.read.json(str(tmp_path / "t/traces")).count() == 3


def test_batches_of_repositories(spark, tmp_path):
    for name in ("one", "two"):
        repo.write_text(str(tmp_path / name / "main.py"), "import os\n\nclass A:\n    pass\n")
    repo.write_text(str(tmp_path / "list.txt"), f"# all\n{tmp_path}/one\n\n  {tmp_path}/two  \n{tmp_path}/none\n")
    paths = [r.repository for r in repository_list(spark, str(tmp_path / "list.txt")).collect()]
    assert paths == [f"{tmp_path}/one", f"{tmp_path}/two", f"{tmp_path}/none"]
    done = index_batch(spark, paths, str(tmp_path / "kb"))
    assert [(r.status, r.files, r.entities) for r in done.collect()] == [("ok", 1, 2), ("ok", 1, 2), ("failed", 0, 0)]
    assert batch_totals(done).first().asDict() == {"total_repos": 3, "successful": 2, "failed": 1}


def test_service_keys(monkeypatch):
    monkeypatch.setenv("MAIL_KEY", "from the environment")
    assert config.service_key("mail", {"MAIL_KEY": "own"}) == "from the environment" and config.service_key("other", {"API_KEY": "last"}) == "last"
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert config.service_key("other", {}) is None and config.setting("MISSING", {}, "default") == "default"


def test_phrases_in_texts(spark, monkeypatch):
    from quillstone.operators import search

    monkeypatch.setattr(search, "BLOCK_BYTES", 20)
    texts = spark.createDataFrame([(1, "The cat sat on the Mat"), (2, "a catalogue"), (3, None), (4, "")], "ord long, content string")
    asked = spark.createDataFrame([(1, "cat"), (2, "CAT"), (3, "the mat"), (4, "logue"), (5, ""), (6, None), (7, "dog and a longer phrase")], "conv_id long, question string")
    got = sorted(tuple(r) for r in search.matches(asked, texts, "content", ["ord"]).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 2)]
    assert search.matches(asked.limit(0), texts, "content", ["ord"]).count() == 0


def test_similar_names_against_all_pairs(spark):
    import random

    from quillstone.operators import inference

    rng = random.Random(17)
    names = ["", "a", "ab", "Ab", "run", "Run", "tun"]
    for _ in range(60):
        base = "".join(rng.choice("abcdXY_") for _ in range(rng.randrange(1, 26)))
        names.append(base)
        for _ in range(2):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randrange(2)] = rng.choice(["", "z", "q"])
            names.append("".join(own))
    rows = [(i, f"e{i}", n, "class" if i % 9 else "function") for i, n in enumerate(names)]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    def alike(a, b):
        if a == b:
            return 1.0
        longest = max(len(a), len(b))
        return 1.0 - distance(a.lower(), b.lower()) / longest if longest else 1.0

    want = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[3] == b[3] and alike(a[2], b[2]) > 0.7}
    ents = spark.createDataFrame(rows, "ord long, id string, name string, type string")
    got = [(r.source_id, r.target_id) for r in inference.similar_names(ents).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_source_spreads_deep_trees(spark, tmp_path):
    for i in range(30):
        repo.write_text(str(tmp_path / "one" / "two" / f"d{i:02}" / "x" / "f.py"), "y = 1\n")
    repo.register(spark)
    read = spark.read.format("repository").option("path", str(tmp_path)).option("content", "false").load()
    reader = repo.RepositoryReader({"path": str(tmp_path)})
    assert len(reader.partitions()) >= 30
    paths = [r.path for p in reader.partitions() for r in [repo_row for repo_row in map(lambda x: type("R", (), {"path": x[0]}), reader.read(p))]]
    assert paths == sorted(paths) and len(paths) == 2 + 60 + 30 == read.count() and len(set(paths)) == len(paths)
    flat_ = spark.read.format("repository").option("path", str(tmp_path)).option("recursive", "false").load()
    assert [r.path for r in flat_.collect()] == ["one"]
