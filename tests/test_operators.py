import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import asking, documents, extract, graph
from quillstone.plans import samples
from quillstone.plans.config import Config
from quillstone.plans.indexer import index_repository
from quillstone.sources import knowledge, repo

NODES = [("main_py", "main.py", "file"), ("app_py", "app.py", "file"), ("models_py", "models.py", "file"), ("utils_py", "utils.py", "file"), ("user_class", "User", "class")]
EDGES = [("main_py", "app_py", "imports", 0.9), ("app_py", "main_py", "imports", 0.8), ("app_py", "models_py", "imports", 0.7), ("models_py", "user_class", "contains", 1.0), ("main_py", "app_py", "similar", 0.6)]


@pytest.fixture(scope="module")
def g(spark):
    ents = spark.createDataFrame(NODES, "id string, name string, type string")
    edges = spark.createDataFrame(EDGES, "source_id string, target_id string, relationship_type string, strength double").withColumn("id", F.monotonically_increasing_id().cast("string"))
    return ents, edges


def test_graph_a(g):
    ents, edges = g
    assert [(r.id, r.degree) for r in graph.central(edges, ents, 3).collect()] == [("app_py", 4), ("main_py", 3), ("models_py", 2)]
    assert [r.id for r in graph.shortest_path(edges, ents, "main_py", "user_class").orderBy("step").collect()] == ["main_py", "app_py", "models_py", "user_class"]
    assert {r.id for r in graph.neighborhood(edges, ents, "app_py", 2).collect()} == {"app_py", "main_py", "models_py", "user_class"}
    found = graph.components(edges, ents, 2).collect()
    assert {r.id for r in found} == {"main_py", "app_py", "models_py", "user_class"} and {r.size for r in found} == {4}
    assert graph.hubs(edges, ents).count() == 0
    assert [tuple(r) for r in graph.cycles(edges, 2).collect()] == [("app_py", "main_py")]
    assert [(r.other_id, r.strength) for r in graph.similar_by_edges(edges, ents, "main_py", 0.5).collect()] == [("app_py", 0.6)]
    assert graph.shortest_path(edges, ents, "utils_py", "main_py").count() == 0
    assert graph.degrees(edges).agg(F.sum("degree")).first()[0] == 2 * len(EDGES)
    assert graph.greedy_clusters(edges, ents).count() > 0


def test_extractors_on_corpus(spark):
    files = samples.files(spark)
    own = {(r.path[-4:], r.name, r.type, r.line) for r in extract.entities(files).collect()}
    assert {("a.py"[-4:], "Child", "class", 4), ("a.py"[-4:], "run", "function", 5), ("a.py"[-4:], "top", "function", 12)} <= own
    assert not any(n == "later" for _, n, _, _ in own)
    facts = extract.python_facts(samples.A)
    assert {(a, b, d, line) for k, a, b, line, d in facts if k == "call"} == {("run", "helper", "function", 7), ("run", "Oops", "function", 9), ("top", "run", "method", 13), ("top", "Child", "function", 13), ("module", "top", "function", 16)}
    assert {(a, b, line) for k, a, b, line, d in facts if k == "exception"} == {("run", "ValueError", 6), ("run", "Oops", 9)}
    assert [(a, line) for k, a, b, line, d in extract.javascript_facts(samples.JS) if k == "import"] == [("fs", 2), ("./lib/util", 1)]
    report = extract.inspect_python(samples.A)
    assert (report["classes"], report["functions"], report["complexity"], report["dependencies"]) == (1, 2, 2, ["os", "b"])
    assert extract.python_facts("def (") == [] and extract.python_facts("") == []


def test_relationships_of_corpus(spark):
    kinds = {r.relationship_type: r["count"] for r in samples.relationships(spark).groupBy("relationship_type").count().collect()}
    assert kinds == {"imports": 2, "calls": 4, "inherits": 1, "decorates": 1, "handles": 1, "same_package": 1, "similar": 1}
    cut = "def f():\n    return 1\n" + "#" * 2000 + "\n" + "f()\n"
    long = spark.createDataFrame([(0, "x/y.py", cut)], "ord long, path string, content string").withColumn("language", F.lit("python"))
    assert samples.index(long)[1].count() == 0  # the caller of f is the module, which is no entity


def test_shared_dependencies_of_whole_files(spark):
    rows = [(i, f"p{i}/f{i}.py", "# licence\n" * 200 + "import json\n") for i in range(2)]
    source = spark.createDataFrame(rows, "ord long, path string, content string").withColumn("language", F.lit("python"))
    assert samples.index(source)[1].where("relationship_type = 'shared_dependency'").count() == 1
    assert samples.index(source, 1500)[1].where("relationship_type = 'shared_dependency'").count() == 0
    assert samples.index(source, 2100)[1].where("relationship_type = 'shared_dependency'").count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("a/.env", "x\ny\n"), ("a/b.tar.gz", ""), ("c.py", "one\r\ntwo")], "p string, t string")
    got = df.select(T.suffix(F.col("p")).alias("s"), F.size(T.lines(F.col("t"))).alias("n")).collect()
    assert [(r.s, r.n) for r in got] == [("", 2), (".gz", 0), (".py", 2)]
    assert spark.range(1).select(T.name_similarity(F.lit("User"), F.lit("user")).alias("x")).first().x == 1.0
    assert spark.range(1).select(F.lit("a/b/c.py").rlike(T.glob_to_regex("*b*.py")).alias("x")).first().x


IMPORTS = "# licence\n\nimport os.path as p\r\n  from  a.b import c\nfrom . import d\nimportant x\nimport\t\nimport \u00a0 \u00a0numpy\nx = 1\nimport q from './lib/util';\n import {z} from \"fs\"; import y from 'no'\nconst r = require('x');\nfromage\n"


def test_imports_of_all_lines(spark, tmp_path):
    import duckdb

    from quillstone.plans.catalog import ORACLES, QUERIES

    rows = [(1, IMPORTS), (2, ""), (3, None), (4, "The import of goods"), (5, "x\n" * 2000 + "import late.one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["find_all_imports"](spark, str(tmp_path)).collect())
    python = ["os", "a", "", "numpy", "q", "{z}"]
    assert got == [(1, "javascript", 1, "util"), (1, "javascript", 2, "fs"), *((1, "python", i + 1, x) for i, x in enumerate(python)), (5, "python", 1, "late")]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(ORACLES["find_all_imports"]).fetchall()) == got
    other = spark.range(1).select(*[T.imports(F.lit(IMPORTS), F.lit(x)).alias(x) for x in ("typescript", "rust")]).first()
    assert (other.typescript, other.rust) == (["util", "fs"], [])


def test_rules(spark):
    q = spark.createDataFrame([("how do I run the test suite",), ("deploy to production",), ("hello",)], "q string")
    assert [r.k for r in q.select(asking.question_kind(F.col("q")).alias("k")).collect()] == ["testing", "deployment", "general"]
    one = q.select(asking.lessons(F.lit("api"), F.lit(0.9), F.lit(True), F.lit(2)).alias("x")).first().x
    assert len(one) == 3
    doc = spark.createDataFrame([("use `pip install x` now",)], "t string")
    assert doc.select(documents.commands(F.col("t")).alias("c")).first().c == ["pip install x"]
    assert doc.select(documents.install_instructions(F.lit("# Install\\npip install a\\n# Other\\npip install b")).alias("c")).first().c == ["pip install a"]


def test_repository_and_knowledge_base(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in (*samples.CORPUS, (".git/x", "no"), ("__init__.py", ""), ("core/bad.py", "def (")):
        repo.write_text(str(root / name), text)
    repo.register(spark)
    read = spark.read.format("repository").option("path", str(root)).load()
    paths = {r.path for r in read.where("not is_directory").collect()}
    assert paths == {"pkg/core/a.py", "pkg/core/b.py", "web/w.js", "__init__.py", "core/bad.py"}
    kb = knowledge.create(spark, "text", str(tmp_path / "kb"))
    made = index_repository(spark, str(root), kb, Config())
    assert made["files"] == 5 and made["entities"] == 14 and made["relationships"] >= 10
    again = knowledge.create(spark, "text", str(tmp_path / "kb"))
    assert again.entities.count() == made["entities"] and again.search("helper", "function").count() >= 1
    again.clear()
    assert again.entities.count() == 0
    with pytest.raises(ValueError):
        knowledge.create(spark, "nope", "x")
    assert index_repository(spark, str(root), again, Config(exploration_strategy="plan_act"))["errors"]


def test_repository_without_limits(spark, tmp_path):
    root = tmp_path / "repo"
    for i in range(53):
        repo.write_text(str(root / f"d{i}" / "x" / f"f{i}.py"), "y = 1\n")
    repo.write_text(str(root / "large.py"), "#" * 1_100_000)
    made = index_repository(spark, str(root), knowledge.create(spark, "text", str(tmp_path / "a")), Config())
    assert made["files"] == 54 and made["errors"] == []
    made = index_repository(spark, str(root), knowledge.create(spark, "text", str(tmp_path / "b")), Config(max_exploration_depth=5, max_file_size=1_048_576))
    assert made["files"] == 50 and [e.split()[0] for e in made["errors"]] == ["1", "3"]


def test_config(tmp_path, monkeypatch):
    c = Config(kb_type="vector")
    c.save(str(tmp_path / "c.json"))
    assert Config.from_file(str(tmp_path / "c.json")) == c
    monkeypatch.setenv("QUILLSTONE_MAX_EXPLORATION_DEPTH", "9")
    assert Config.from_file(str(tmp_path / "c.json")).max_exploration_depth == 9
    with pytest.raises(TypeError):
        Config.from_dict({"nope": 1})
    for bad in (Config(kb_type="x"), Config(exploration_strategy="x"), Config(max_exploration_depth=0)):
        with pytest.raises(ValueError):
            bad.validate()


B_NODES = ["main_py", "users_router", "items_router", "models_py", "database_py", "auth_utils", "user_class", "item_class", "get_users_func", "get_items_func"]
B_EDGES = [
    ("main_py", "users_router", "imports"), ("main_py", "items_router", "imports"), ("users_router", "models_py", "imports"), ("items_router", "models_py", "imports"),
    ("users_router", "database_py", "imports"), ("items_router", "database_py", "imports"), ("models_py", "user_class", "contains"), ("models_py", "item_class", "contains"),
    ("users_router", "get_users_func", "contains"), ("items_router", "get_items_func", "contains"), ("get_users_func", "user_class", "uses"), ("get_items_func", "item_class", "uses"),
    ("users_router", "items_router", "similar"), ("user_class", "item_class", "similar"), ("users_router", "auth_utils", "imports"),
]


def test_graph_b(spark):
    ents = spark.createDataFrame([(i, n, n, "x") for i, n in enumerate(B_NODES)], "ord long, id string, name string, type string")
    edges = spark.createDataFrame([(f"{a}-{k}-{b}", a, b, k, 0.9) for a, b, k in B_EDGES], "id string, source_id string, target_id string, relationship_type string, strength double")
    got = {r.id: r.degree for r in graph.degrees(edges).collect()}
    assert got == {"users_router": 6, "items_router": 5, "models_py": 4, "user_class": 3, "item_class": 3, "main_py": 2, "database_py": 2, "get_users_func": 2, "get_items_func": 2, "auth_utils": 1}
    path = [r.id for r in graph.shortest_path(edges, ents, "main_py", "user_class").orderBy("step").collect()]
    both = {(a, b) for a, b, _ in B_EDGES} | {(b, a) for a, b, _ in B_EDGES}
    assert len(path) == 4 and (path[0], path[-1]) == ("main_py", "user_class") and all(x in both for x in zip(path, path[1:], strict=False))
    assert {r.id for r in graph.neighborhood(edges, ents, "models_py", 2).collect()} == set(B_NODES)
    assert {r.size for r in graph.components(edges, ents, 3).collect()} == {10} and graph.components(edges, ents, 11).count() == 0
    assert graph.hubs(edges, ents).count() == 0 and [(r.id, r.out_degree) for r in graph.hubs(edges, ents, over=4).collect()] == [("users_router", 5)]
    assert {(r.other_id, r.relationship_type) for r in graph.related(edges, ents, "main_py").collect()} == {("users_router", "imports"), ("items_router", "imports")}
    assert {r.cluster: r.size for r in graph.greedy_clusters(edges, ents).collect()} == {"auth_utils": 7, "get_items_func": 3}


def test_whole_files_give_edges_that_a_prefix_loses(spark):
    cut = "def f():\n    return 1\n" + "#" * 2000 + "\n\ndef g():\n    return f()\n"
    long = spark.createDataFrame([(0, "x/y.py", cut)], "ord long, path string, content string").withColumn("language", F.lit("python"))
    kinds = lambda edges: sorted(r.relationship_type for r in edges.collect())
    assert kinds(samples.index(long)[1]) == ["calls"]
    assert kinds(samples.index(long, 1000)[1]) == []
