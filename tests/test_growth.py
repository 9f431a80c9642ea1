"""What grows with the square of a group leaves tasks small and moves inputs, not results."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import inference


def test_edges_of_basic_imports_are_not_shuffled(spark):
    facts = spark.createDataFrame([("s1", "x"), ("s1", "x"), ("s2", "x"), ("s1", "y"), ("p1", "x"), ("s3", None)], "source_id string, symbol string")
    one = spark.createDataFrame([("x", "p1"), ("x", "p2"), ("y", "p3"), ("y", "p3"), (None, "p4")], "name string, id string")
    made = inference.basic_imports(facts, one)
    assert sorted((r.source_id, r.target_id) for r in made.collect()) == [("p1", "p2"), ("s1", "p1"), ("s1", "p2"), ("s1", "p3"), ("s2", "p1"), ("s2", "p2")]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")]
    # an id with two names that one source uses gives one edge
    two = inference.basic_imports(facts, one.union(spark.createDataFrame([("y", "p1")], "name string, id string")))
    assert sorted((r.source_id, r.target_id) for r in two.collect()) == sorted((r.source_id, r.target_id) for r in made.collect())


def test_packages_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(inference, "BLOCK", 50)
    monkeypatch.setattr(inference, "SHARE", 5000)
    files = spark.range(300).select(F.col("id").alias("ord"), F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("a/b/"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("path"))
    made = inference.same_package(files)
    assert made.rdd.getNumPartitions() > 8
    got = {(r.source_id, r.target_id): r.strength for r in made.collect()}
    assert got == {(f"f{i}", f"f{j}"): 0.75 if i % 3 == j % 3 else 0.5 for i in range(300) for j in range(i + 1, 300)}


def test_deep_packages(spark):
    paths = ["a/b/c/d/e/f/g", "a/b/c/d/e/f/h", "a/b", "a/b/c", "a/c/d", "a/b/c/d/x/f/g", "a", "a//b/./z"]
    made = inference.same_package(spark.createDataFrame([(i, str(i), p) for i, p in enumerate(paths)], "ord long, id string, path string"))
    parts = [[x for x in p.split("/") if x not in ("", ".")] for p in paths]

    def shared(a, b):
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return n / max(len(a), len(b)) if n > 1 else None

    want = {(str(i), str(j)): shared(parts[i], parts[j]) for i in range(len(paths)) for j in range(i + 1, len(paths)) if shared(parts[i], parts[j])}
    assert {(r.source_id, r.target_id): r.strength for r in made.collect()} == want


def test_names_with_one_beginning_are_told_apart(spark):
    """Names that all begin alike meet by what follows."""
    names = ["w_" + "".join("abcdefgh"[(i * k + i // 7) % 8] for k in range(1, 7)) for i in range(400)]
    names = sorted(set(names))
    own = spark.createDataFrame([(x, len(x)) for x in names], "low string, n int")
    met = {(r.a, r.b) for r in inference._by_variants(own, 0.7, 2).collect()}
    assert len(met) < len(names) * (len(names) - 1) / 8

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in names for b in names if a < b and 1.0 - edits(a, b) / 8 > 0.7}
    assert want and want <= met


def test_shared_dependencies_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(inference, "BLOCK", 50)
    monkeypatch.setattr(inference, "SHARE", 5000)
    uses = spark.range(200).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.lit("t").alias("token"))
    made = inference.shared_dependencies(uses.union(uses.where("id = 7")))
    assert made.rdd.getNumPartitions() > 8
    got = sorted((int(r.source_id), int(r.target_id)) for r in made.collect())
    assert got == sorted([(i, j) for i in range(200) for j in range(i + 1, 200)] + [(7, 7)])


def test_facts_of_some_kinds(spark):
    """Only facts that are asked for leave a task; scripts are not read for kinds that they don't have."""
    from quillstone.operators import extract

    code = [("a.py", "import x\nclass A(B):\n    def f(self): raise E()\n@d\ndef g(): h()\n", "python"), ("b.js", "import y from 'z'\nq();\n", "javascript"), ("c.py", None, "python"), ("d.txt", "import x", "unknown")]
    files = spark.createDataFrame(code, "path string, content string, language string")
    every = extract.facts(files)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for kinds in (["inherit"], ["exception", "decorator"], ["import"], ["call", "inherit"]):
        assert rows(extract.facts(files, kinds)) == rows(every.where(F.col("kind").isin(kinds))) != []


def test_numbers_keep_the_order_of_ids(spark):
    from quillstone.operators import graph

    ids = [f"n{i * 7919 % 1000}" for i in range(1000)] + ["é", "", "n1"]
    got = graph.numbered(spark.createDataFrame([(x,) for x in [*ids, None]], "id string")).orderBy("n").collect()
    assert [r.id for r in got] == sorted(set(ids))


def test_ends_of_edges_are_not_made_distinct(spark):
    from quillstone.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "c")], "source_id string, target_id string")
    assert graph._ends(edges).count() == 6
    got = graph.shortest_paths(edges, spark.createDataFrame([("a", "c")], "source string, target string"), 5)
    assert sorted((r.step, r.id) for r in got.collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_phrases_share_one_automaton_of_keys(spark, monkeypatch):
    """Long phrases take few blocks; one that only shares its key with a text is not in it."""
    from quillstone.operators import search

    monkeypatch.setattr(search, "BLOCK_BYTES", 200)
    long = ["x" * 40 + "middle of it" + c * 40 for c in "abcdefgh"]
    texts = spark.createDataFrame([(i, f"before {x} after") for i, x in enumerate(long[:3])] + [(9, "middle of it")], "ord long, content string")
    made = search.matches(spark.createDataFrame(list(enumerate(long)), "conv_id long, question string"), texts, "content", ["ord"])
    assert sorted(map(tuple, made.collect())) == [(0, 0), (1, 1), (2, 2)]
    assert made._jdf.queryExecution().sparkPlan().toString().count("MapInArrow ") == 1


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_long_names_meet_by_shortened_forms(spark):
    """Names of 17 to 20 characters do not meet by segments of two or three characters, which most of them share."""
    syllables = ["the", "ing", "an", "re", "ou", "sh", "tion", "le"]
    names = ["w_" + "".join(syllables[(i * k + i // 5) % 8] for k in range(1, 9))[: 15 + i % 4] for i in range(300)]
    names = sorted({x for x in names if len(x) > 16})
    own = spark.createDataFrame([(x, len(x)) for x in names], "low string, n int")
    assert inference._by_segments(own, 0.7, 2).count() == 0
    want = {(a, b) for a in names for b in names if (len(a), a) < (len(b), b) and 1.0 - _edits(a, b) / len(b) > 0.7}
    assert want and {(r.a, r.b) for r in inference._near(inference._by_variants(own, 0.7, 2, 3), 0.7).collect()} == want


def test_edits_of_many_pairs_at_once():
    import random

    import pyarrow as pa

    rng = random.Random(5)
    for letters in ("ab", "abcé", "abcdefgh"):
        for n in (5, 20, 48):
            a = ["".join(rng.choice(letters) for _ in range(rng.randrange(n + 1))) for _ in range(200)]
            b = [x[: (k := rng.randrange(len(x) + 1))] + rng.choice(letters)[: rng.randrange(2)] + x[k + 1 :] if rng.random() < 0.7 else rng.choice(a) for x in a]
            for threshold in (0.9, 0.7, 0.3):
                want = [bool(x or y) and 1.0 - _edits(x, y) / max(len(x), len(y)) > threshold for x, y in zip(a, b, strict=True)]
                got = inference._few_edits(pa.array(["skipped", *a])[1:], pa.array(b), threshold)
                assert [g for g, x, y in zip(got, a, b, strict=True) if x or y] == [w for w, x, y in zip(want, a, b, strict=True) if x or y]


def test_words_of_a_line_are_looked_for_once(spark, tmp_path):
    from quillstone.plans import code

    texts = ["one two three\n\n7 Über-Maß x9y\n  lone1\n" + "a" * 5000 + "\n" + "-" * 5000 + "A" + "-" * 5000 + "\nÉa éB c", None, ""]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    made = code.code_files(spark, str(tmp_path))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" not in plan and plan.count(code.FIRST_TWO) == 2
    assert [r.content for r in made.orderBy("ord").collect()] == ["import w_one\nw_two()\npass\npass\nclass w_ber(w_ma):\n    def w_ma(self): w_ber()\npass\npass\npass\npass\npass\npass\nfrom w_a import w_b\npass", "pass\npass", "pass\npass"]


@pytest.mark.parametrize("kind", ["package", "token"])
def test_files_of_pairs_compress(spark, tmp_path, kind):
    """Pairs that follow one another in a file have rows in common."""
    import os

    rows = spark.range(700).select(F.col("id").alias("ord"), F.md5(F.col("id").cast("string")).alias("id"), F.concat(F.lit("a/b/"), F.col("id").cast("string")).alias("path"), F.lit("t").alias("token"))
    made = inference.same_package(rows) if kind == "package" else inference.shared_dependencies(rows)
    made.coalesce(1).write.option("compression", "snappy").parquet(str(tmp_path / "out"))
    written = sum(os.path.getsize(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out") if f.endswith(".parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 700 * 699 // 2 and written < 16 * 700 * 699 // 2


def test_a_codec_is_set_where_none_is(spark):
    from quillstone.operators import scratch

    files = spark.range(1)
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        scratch.compact(files)
        assert spark.conf.get(key) == "zstd"
        spark.conf.set(key, "snappy")
        scratch.compact(files)
        assert spark.conf.get(key) == "snappy"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_lines_of_imports_are_told_apart_once(spark):
    """Pairs of supplier and part are not made distinct before they become pairs of supplier and name."""
    from quillstone.plans import inferring

    plan = inferring._facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
