import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, SF), name)
        n.append(out.count())
        if name != "encode":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = out
    assert n == sorted(n, reverse=True) and n[-1] == n[-2] > 0
    assert corpus_pipeline.run(spark, SF).count() == n[-1]


def test_stages_against_brute_force(spark):
    """Which documents stay at each stage, in plain Python; the classifier's own rows aside, which are op4's."""
    import hashlib
    import re

    import numpy as np
    import sentencepiece
    from test_llm_operators import brute_components, brute_tiling

    from quillstone.llm import quality
    from quillstone.llm.queries import tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    stages, out = dict(corpus_pipeline.STAGES), docs

    def after(name):
        nonlocal out
        out = corpus_pipeline.cut(stages[name](spark, out, SF), name)
        return {r.doc_id for r in out.collect()}

    stay = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert after("quality") == stay
    last = {}
    for i in stay:
        last[text[i]] = max(i, last.get(text[i], i))
    stay = set(last.values())
    assert after("exact") == stay
    groups = brute_components([(i, text[i]) for i in sorted(stay)], 5, 80)
    stay = {i for i, (n, c) in groups.items() if i == c}
    assert after("near") == stay
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gram = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    grams = [gram(w) for w in items]
    bad = set()
    for i in stay:
        own = words(text[i])
        have = gram(own)
        for item, g in zip(items, grams, strict=True):
            if len(have & g) and len(own) < 3_000 and brute_tiling(own, item, 5) / len(item) >= 0.5:
                bad.add(i)
                break
    assert after("decontaminate") == stay - bad
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(corpus_pipeline.MODEL))
    for r in stages["encode"](spark, out, SF).collect():
        ids = sp.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, names that clash or hold dots, and an empty table go through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, uid string, `a.b` string, m map<string,int>"
    own = "a text of its own with some more words to read and to keep"
    rows = [(1, own, "en", "s", 1, "u", "x", {"k": 1})] * 2 + [(1, "other words", None, None, None, None, None, None), (None, own, "en", None, 3, "u", "y", None), (None, None, None, None, None, None, None, None), (2, "", "de", "s", 0, "", "", {}), (3, "long " * 50_000, "en", "s", 9, "u", "z", {})]
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of that sort is here at all"), (None, None)], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], schema)
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), name)
            if name != "encode":
                assert out.dtypes == docs.dtypes
                docs = out
        assert out.count() == docs.count() and (docs.count() > 0) == (n > 0)
    kept = corpus_pipeline.cut(corpus_pipeline.distinct(spark, spark.createDataFrame(rows, schema), str(tmp_path)), "kept").collect()
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept) == sorted([("1", len(own)), ("1", 11), ("2", 0), ("3", 250_000)])
