"""The knowledge base as deltas, its index of texts, and two writers at once."""

import os
import random

import pytest

from quillstone.sources import grams, knowledge


def row(i, name="n", content="c", kind="class", ord_=None):
    return (i if ord_ is None else ord_, f"id{i}", name, kind, f"p/{name}", content, "python", 5, None, {"k": str(i)})


def made(spark, rows):
    return spark.createDataFrame(rows, knowledge.ENTITIES)


def seen(kb):
    return {(r.ord, r.id, r.name, r.content) for r in kb.entities.collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_deltas_and_compaction_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knowledge, "DELTAS", 4)
    rng = random.Random(2)
    kb, want = knowledge.create(spark, "text", str(tmp_path / "kb")), {}
    for step in range(9):
        if step % 3 == 2:
            gone = rng.sample(sorted(want), 3)
            kb.remove(spark.createDataFrame([(f"id{i}",) for i in gone], "id string"))
            for i in gone:
                del want[i]
        rows = [row(i, f"n{step}", ord_=100 * step + i) for i in rng.sample(range(40), 12)]
        kb.add(made(spark, rows))
        for r in rows:
            i = int(r[1][2:])
            want[i] = (want[i][0] if i in want else r[0], r[1], r[2], r[5])
        kb.save()
        assert len(kb.deltas) <= 4
    assert seen(kb) == set(want.values())
    kb.compact()
    assert len(kb.deltas) == 1 and seen(kb) == set(want.values()) and seen(knowledge.create(spark, "text", kb.path)) == set(want.values())
    assert kb.get("id7").count() == (7 in want)


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    kb = knowledge.create(spark, "text", str(tmp_path / "kb"))
    kb.add(made(spark, [row(i, content=f"{random.Random(i).random()} " * 200) for i in range(2000)]))
    kb.save()
    before = size(kb.path)
    kb.add(made(spark, [row(1, "other", "x")]))
    kb.save()
    assert size(kb.path) - before < before / 10
    assert kb.get("id1").first().name == "other" and kb.entities.count() == 2000


def test_a_save_that_breaks_off_leaves_the_version_before(spark, tmp_path, monkeypatch):
    kb = knowledge.create(spark, "text", str(tmp_path / "kb"))
    kb.add(made(spark, [row(1)]))
    kb.save("a")
    kb.add(made(spark, [row(2)]))

    def broken(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(knowledge.KnowledgeBase, "_publish", broken)
        with pytest.raises(OSError):
            kb.save("b")
    again = knowledge.create(spark, "text", kb.path)
    assert seen(again) == {(1, "id1", "n", "c")} and again.mark == "a"
    again.add(made(spark, [row(2)]))
    again.save("b")
    assert again.entities.count() == 2


def test_two_writers_lose_nothing(spark, tmp_path):
    a = knowledge.create(spark, "text", str(tmp_path / "kb"))
    b = knowledge.create(spark, "text", str(tmp_path / "kb"))
    a.add(made(spark, [row(1, "a"), row(2, "a")]))
    b.add(made(spark, [row(2, "b"), row(3, "b")]))
    a.save()
    b.save()
    a.load()
    assert {(r.id, r.name) for r in a.entities.collect()} == {("id1", "a"), ("id2", "b"), ("id3", "b")} == {(r.id, r.name) for r in b.entities.collect()}


def test_vectors_go_with_their_entities(spark, tmp_path):
    kb = knowledge.create(spark, "vector", str(tmp_path / "kb"))
    kb.add(made(spark, [row(i, f"n{i}") for i in range(3)]))
    kb.save()
    kb.remove(spark.createDataFrame([("id1",)], "id string"))
    kb.save()
    assert {r.id for r in kb.embeddings.collect()} == {"id0", "id2"}


def test_index_gives_what_a_scan_gives(spark, tmp_path):
    rng = random.Random(4)
    pieces = ["ab", "abc", "Straße", "ÉCLAIR", "𝒳y", "foo bar", "x", "İ", "aaa", "aaaa", " ", "zz\n"]
    text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30)))
    rows = [row(i, rng.choice(["n", "", None, "ab"]), rng.choice([text(), text(), None, "", "a"])) for i in range(300)]
    kb = knowledge.create(spark, "text", str(tmp_path / "kb"))
    kb.add(made(spark, rows[:200]))
    kb.save()
    kb.add(made(spark, [*rows[200:], row(3, "late", "brand new words")]))
    kb.save()
    all_ = kb.entities.cache()
    for phrase in ["a", "B", "ab", "ABC", "straße", "éclair", "𝒳Y", "foo bar", "aaaaa", "i̇", "\n", "brand NEW", "nowhere to be found", "", "xx", "p/ab"]:
        want = {r.id for r in knowledge.matching(all_, phrase).collect()}
        assert {r.id for r in kb.search(phrase).collect()} == want, phrase
    kb.compact()
    assert [r.id for r in kb.search("brand new").collect()] == ["id3"]
    all_.unpersist()


def test_index_reads_few_files(spark, tmp_path):
    kb = knowledge.create(spark, "text", str(tmp_path / "kb"))
    kb.add(made(spark, [row(i, content="needle" if i == 77 else f"hay {i}") for i in range(400)]))
    kb.save()
    found = kb._near("needle")
    assert [r.id for r in found.collect()] == ["id77"]
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "bucket" in plan.split("PartitionFilters")[1][:200]


def test_grams_of_a_shard_are_split(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(grams, "SHARD", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([5, 4, 3]), pa.array(["abcd", "abc", None])], ["row", "f0"])
    got = [(g, tuple(r)) for b in grams._postings(iter([batch])) for g, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
    abc = int(grams.codes("abc")[0])
    assert sorted(r for g, r in got if g == abc) == [(4, 5)] or sorted(r for g, r in got if g == abc) == [(4,), (5,)]
