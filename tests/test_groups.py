"""Groups instead of pairs, vectors by cells, paths from both ends, extractors on odd texts: against brute force."""

import random
from collections import deque

import numpy as np
import pytest

from quillstone.operators import cells, extract, graph, hyper, inference, scratch


@pytest.fixture(scope="module")
def members(spark):
    rng = random.Random(3)
    uses = [(i, f"u{i}", f"t{rng.randrange(12) if rng.random() < 0.8 else 99}") for i in range(60) for _ in range(rng.randrange(0, 4))]
    uses += [(100 + i, f"v{i}", "own") for i in range(3)] + [(200, "alone", "t-alone"), (201, None, "x"), (202, "w", None)]
    return hyper.by_token(spark.createDataFrame(uses, "ord long, id string, token string"))


def walk(pairs, start, depth):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in seen and seen[x] < depth:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def test_groups_equal_their_pairs(spark, members):
    pairs = hyper.pairs(members, "shared", graph.F.lit(0.6))
    plain = [(r.source_id, r.target_id) for r in pairs.collect()]
    assert len(plain) == sum(r.pairs for r in hyper.sizes(members).collect())
    assert {(r.id, r.degree) for r in hyper.degrees(members).collect()} == {(r.id, r.degree) for r in graph.degrees(pairs).collect()}
    names = sorted({x for p in plain for x in p} | {"alone", "nobody"})
    entities = spark.createDataFrame([(n, n, "file") for n in names if n != "u5"], "id string, name string, type string")
    extra = spark.createDataFrame([("v0", "u7", "calls"), ("nobody", "gone", "calls")], "source_id string, target_id string, relationship_type string")
    both = pairs.select("source_id", "target_id").unionByName(extra.select("source_id", "target_id"))
    assert {tuple(r) for r in hyper.components(extra, members, entities).collect()} == {tuple(r) for r in graph.components(both, entities).collect()}
    assert [tuple(r) for r in hyper.central(extra, members, entities, 5).collect()] == [tuple(r) for r in graph.central(both, entities, 5).collect()]
    for depth in (1, 2, 4):
        got = {r.id: r.distance for r in hyper.distances(extra, members, "u3", depth).collect()}
        assert got == walk([*plain, ("v0", "u7"), ("nobody", "gone")], "u3", depth)


def test_packages(spark):
    files = spark.createDataFrame([(i, f"f{i}", p) for i, p in enumerate(["a/b/c.py", "a/b/d/e.py", "a/x.py", "solo.py", "./a/b/z.py", "a//b/q.py"])], "ord long, id string, path string")
    assert {(r.grp, r.members) for r in hyper.sizes(hyper.by_package(files)).collect()} == {("a/b", 4), ("a/x.py", 1)}


def brute_nearest(rows, queries, k):
    out = set()
    for i, q in queries:
        best = sorted(((-round(float(np.dot(q, v)), 5), j) for j, v in rows if j != i))[:k]
        out |= {(i, j, -s, n) for n, (s, j) in enumerate(best, 1)}
    return out


def test_cells_exact_and_recall(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS", 50)
    monkeypatch.setattr(cells, "QUERIES", 7)
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(12, 8))
    rows = [(i, (middle[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one common vector
    odd = [(5000, None), (5001, [1.0, 2.0]), (None, rows[1][1])]
    base = spark.createDataFrame([*rows, *odd], "id long, vector array<double>").repartition(4)
    queries = [r for r in rows if r[0] % 10 == 0]
    made = cells.Cells(base, cells=20)
    asked = spark.createDataFrame([*queries, queries[0], *odd], "id long, vector array<double>")
    want = brute_nearest(rows, queries, 5)
    assert {(r.query_id, r.id, r.score, r["rank"]) for r in made.search(asked, 5, probes=3).collect()} == want
    near = {(r.query_id, r.id) for r in made.search(asked, 5, exact=False, probes=6).collect()}
    assert len(near & {x[:2] for x in want}) >= 0.9 * len(want)


def test_cells_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "id long, vector array<double>")
    assert cells.Cells(none).search(one, 3).collect() == []
    assert cells.Cells(one).search(none, 3).collect() == []
    assert [tuple(r) for r in cells.Cells(one).search(one, 3).orderBy("query_id").collect()] == [(1, 2, 0.5, 1), (2, 1, 0.5, 1)]


def test_paths_of_many_pairs(spark):
    rng = random.Random(9)
    plain = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)]
    edges = spark.createDataFrame(plain, "source_id string, target_id string")
    asked = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)] + [("n1", "n1"), ("n1", "absent"), (None, "n2")]
    got = {}
    for r in graph.shortest_paths(edges, spark.createDataFrame(asked, "source string, target string"), 5).collect():
        got.setdefault((r.source, r.target), {})[r.step] = r.id
    known = {frozenset(p) for p in plain}
    for s, t in set(asked):
        far = walk(plain, s, 5).get(t) if s is not None else None
        assert ((s, t) in got) == (far is not None), (s, t)
        if far is not None:
            path = [got[s, t][i] for i in range(far + 1)]
            assert len(got[s, t]) == far + 1 and path[0] == s and path[-1] == t
            assert all(frozenset(x) in known for x in zip(path, path[1:], strict=False))


def test_path_past_what_is_no_entity(spark):
    edges = spark.createDataFrame([("s", "a"), ("a", "t"), ("s", "y"), ("y", "t")], "source_id string, target_id string")
    entities = spark.createDataFrame([("s",), ("t",), ("y",)], "id string")
    assert [tuple(r) for r in graph.shortest_path(edges, entities, "s", "t").orderBy("step").collect()] == [(0, "s"), (2, "t")]
    assert graph.shortest_path(edges, entities, "s", "a").collect() == []


def test_deep_and_large_texts_are_extracted(spark):
    deep, deeper = "x = " + "+".join(["f()"] * 5_000) + "\nclass A(B): pass\n", "x = " + "+".join(["a"] * 60_000)
    assert len(extract.python_facts(deep)) == 5_001 and [r["name"] for r in extract.python_items(deep)] == ["A"]
    assert extract.python_facts(deeper) == [] == extract.python_items(deeper) and extract.inspect_python(deeper)["issues"]
    rows = [("a.py", deep, "python"), ("b.py", deeper, "python"), ("c.js", "call(1);\n" * 300_000, "javascript"), ("d.py", None, "python")]
    files = spark.createDataFrame(rows, "path string, content string, language string")
    assert {r.path: r["count"] for r in extract.facts(files).groupBy("path").count().collect()} == {"a.py": 5_001, "c.js": 300_000}
    assert extract.facts(files).where("path = 'c.js'").agg({"line": "max"}).first()[0] == 300_000
    assert extract.inspections(files).count() == 4


def test_scope_leaves_nothing(spark):
    import os

    folder = scratch.shared(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch.scope():
        graph.components(spark.createDataFrame([("a", "b")], "source_id string, target_id string"), spark.createDataFrame([("a",), ("b",)], "id string")).collect()
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


@pytest.mark.parametrize("hub", [False, True])
def test_cycles_and_clusters(spark, hub):
    rng = random.Random(12)
    plain = [(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(60)]
    if hub:  # every one of many points at it and from it, without closing a walk of three
        plain += [("n00", f"x{i:03}") for i in range(300)] + [(f"x{i:03}", "n00") for i in range(300)]
    step = {(a, b) for a, b in plain if a != b}
    edges = spark.createDataFrame([(a, b, "calls") for a, b in plain] + [("n01", "n02", "other"), ("n01", "gone", "calls")], "source_id string, target_id string, relationship_type string")
    after = {}
    for a, b in step:
        after.setdefault(a, set()).add(b)
    for size in (2, 3, 4) if not hub else (2, 3):
        walks = [(a,) for a in after]
        for _ in range(size - 1):
            walks = [(*w, b) for w in walks for b in after.get(w[-1], ()) if b > w[0] and b not in w]
        want = {w for w in walks if w[0] in after.get(w[-1], ())}
        got = [tuple(r) for r in graph.cycles(edges, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    names = sorted({x for p in plain for x in p})
    near = {n: set() for n in names}
    count = {n: 0 for n in names}
    known = [(a, b) for a, b in [*plain, ("n01", "n02")] if a != b]
    for a, b in known:
        near[a].add(b)
        near[b].add(a)
    degree = {n: sum((a == n) + (b == n) for a, b in known) for n in names}
    for a, b in known:
        count[a] += degree[b]
        count[b] += degree[a]
    taken, want = set(), {}
    for n in names:
        if n in taken or count[n] < 3:
            continue
        reach = (near[n] | {y for x in near[n] for y in near[x]} | {n}) - taken
        taken |= reach
        if len(reach) >= 3:
            want |= {x: (n, len(reach)) for x in reach}
    entities = spark.createDataFrame([(n,) for n in names], "id string")
    assert {r.id: (r.cluster, r.size) for r in graph.greedy_clusters(edges, entities).collect()} == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("long", [48, 9])
def test_similar_names(spark, monkeypatch, long):
    monkeypatch.setattr(inference, "LONG", long)
    rng = random.Random(15)
    base = ["".join(rng.choice("abcd_XY") for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 8, 10, 11, 13, 14, 17, 20, 26, 33, 40, 46, 49, 52, 60, 70, 120)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randrange(0, max(1, int(0.36 * len(s))) + 1)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(2)] = rng.choice(["", "z", "A"])
        return "".join(s)

    names = [changed(b) for b in base for _ in range(6)] + ["", None, "é" * 60, "É" * 59 + "x"]
    rows = [(i, f"e{i}", n, rng.choice(["function", "function", "class", "file"])) for i, n in enumerate(names)]
    entities = spark.createDataFrame(rows, "ord long, id string, name string, type string")
    got = {(r.source_id, r.target_id): round(r.strength, 9) for r in inference.similar_names(entities).collect()}
    want = {}
    for i, a, n, k in rows:
        for j, b, m, q in rows:
            if i < j and k == q != "file":
                x, y = (n or "").lower(), (m or "").lower()
                s = 1.0 if not x and not y else 1 - edits(x, y) / max(len(x), len(y))
                if s > 0.7 + 1e-12:
                    want[a, b] = round(s, 9)
    assert got == want
    classes, near = inference.similar_classes(entities)
    assert sum(r.members * (r.members - 1) // 2 for r in classes.collect()) + sum(r.pairs for r in near.collect()) == len(want)


def test_rows_of_a_long_name_are_few(spark):
    names = spark.createDataFrame([("function", "ab" * 100 + "c" * i, 200 + i, 1) for i in range(2)], "type string, low string, n int, members long")
    assert inference._by_rare_pairs(names, 0.7).count() == 1
