"""Indexing of a tree that changes, against indexing it at once."""

import os

from quillstone.plans.indexer import index_changes, index_repository
from quillstone.sources import knowledge, repo


def tree(root, files):
    for path, text in files.items():
        repo.write_text(f"{root}/{path}", text)


FIRST = {
    "pkg/core/a.py": "import os\nfrom b import Base\n\nclass Child(Base):\n    def run(self):\n        helper()\n",
    "pkg/core/b.py": "class Base:\n    pass\n\ndef helper():\n    return 1\n",
    "web/w.js": "import x from './lib';\nfunction stop() { go(); }\n",
    "notes.txt": "import nothing",
}


def seen(kb):
    return {(r.id, r.name, r.content) for r in kb.entities.collect()}, {(r.id, r.source_id, r.target_id, r.relationship_type, r.strength) for r in kb.relationships.collect()}


def test_changes_equal_a_rebuild(spark, tmp_path):
    root, kb = str(tmp_path / "tree"), knowledge.create(spark, "source", str(tmp_path / "kb"))
    tree(root, FIRST)
    steps = [
        lambda: None,
        lambda: tree(root, {"pkg/core/b.py": "class Base:\n    pass\n\ndef helper2():\n    return 1\n", "pkg/core/c.py": "from b import helper2\n\nclass Base2(Base):\n    pass\n"}),
        lambda: os.remove(f"{root}/pkg/core/a.py"),
        lambda: None,
    ]
    for number, (step, files, gone) in enumerate(zip(steps, (3, 2, 0, 0), (0, 0, 1, 0), strict=True)):
        step()
        made = index_changes(spark, root, kb)
        assert (made["files"], made["gone"]) == (files, gone)
        whole = knowledge.create(spark, "text", str(tmp_path / f"whole{number}"))
        index_repository(spark, root, whole)
        assert seen(knowledge.create(spark, "source", kb.path)) == seen(whole)


def test_only_chosen_files_are_opened(spark, tmp_path):
    root = str(tmp_path / "tree")
    tree(root, {"a.py": "class A:\n    pass\n", "b.bin": "x"})
    os.mkfifo(f"{root}/never.bin")  # opening it would wait for ever
    kb = knowledge.create(spark, "text", str(tmp_path / "kb"))
    assert index_repository(spark, root, kb)["files"] == 1
