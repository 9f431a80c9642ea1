"""Texts that repeat themselves, columns of any name and type, coded payloads."""

import gzip
import json
import random
import resource
import time
import zlib

import pytest

from quillstone.llm import exact, jaccard, quality, tiling, warc


def by_both(doc, item, monkeypatch):
    got = []
    for pairs in (1 << 40, 0):
        monkeypatch.setattr(tiling, "PAIRS", pairs)
        items = tiling.Items([1, 2], [item, "some other words of an item here"], 3)
        words, _ = tiling._words(tiling.pa.array([doc]))
        got.append(items.coverage(words))
    return got


def test_search_by_length_marks_the_same(monkeypatch):
    rng = random.Random(11)
    for size in (1, 2, 3, 6):
        for _ in range(60):
            text = lambda n: " ".join(rng.choice("abcdef"[:size]) for _ in range(n))
            a, b = by_both(text(rng.randrange(3, 60)) + " some other words of", text(rng.randrange(3, 40)), monkeypatch)
            assert a == b


def test_equal_words_take_little_memory():
    items = tiling.Items([1], ["word " * 2_000], 5)
    words, _ = tiling._words(tiling.pa.array(["word " * 400_000]))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert items.coverage(words) == {0: 1.0}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000 and time.time() - began < 60


NAMES = ["__at", "__gone", "__one", "one", "row", "id", "sha", "a.b", "logit", "host", "kept_row", "c0", "uid"]


def test_stages_keep_any_column(spark):
    rng = random.Random(2)
    text = lambda i: " ".join(f"w{rng.randrange(300)}" for _ in range(30 + i))
    rows = [(i, text(i) if i else None, "en", "s") for i in range(12)]
    rows += [(20, rows[3][1], "de", "t"), (21, rows[5][1] + " extra", "de", None)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = "named_struct('a b', doc_id, '`x`', array(lang))"
    docs = base.selectExpr("*", *[f"{'doc_id * 7' if i % 2 else repr('v')} as `{n}`" for i, n in enumerate(NAMES)], f"{odd} as deep", "map('k', doc_id) as pairs")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, rows[7][1]), (2, None)], "item_id long, text string")
    want = {r.doc_id: json.dumps(r.asDict(True), sort_keys=True) for r in docs.collect()}
    made = {"exact": exact.last_stay(docs), "near": jaccard.nearest_stay(docs), "quality": quality.good_stay(docs, labels), "clean": tiling.clean_stay(docs, benchmark)}
    for name, df in made.items():
        assert df.schema.simpleString() == docs.schema.simpleString(), name
        got = df.collect()
        assert 0 < len(got) < len(rows) + (name == "quality"), name
        assert all(json.dumps(r.asDict(True), sort_keys=True) == want[r.doc_id] for r in got), name
    assert {r.doc_id for r in made["exact"].collect()} == set(want) - {3}
    assert 21 not in {r.doc_id for r in made["near"].collect()} and 7 not in {r.doc_id for r in made["clean"].collect()}


def message(head, payload):
    return ("HTTP/1.1 200 OK\r\n" + head + "\r\n\r\n").encode() + payload


PAGE = "<html><title>Café</title><p>naïve</p></html>"


@pytest.mark.parametrize(("head", "payload"), [
    ("content-type: text/html; charset=latin-1", PAGE.encode("latin-1")),
    ("CONTENT-TYPE: text/html;\r\n  charset=latin-1", PAGE.encode("latin-1")),
    ("Content-Encoding: gzip", gzip.compress(PAGE.encode())),
    ("content-encoding: deflate", zlib.compress(PAGE.encode())),
    ("Content-Encoding: gzip", PAGE.encode()),
    ("Transfer-Encoding: chunked", b"5;x=1\r\n" + PAGE.encode()[:5] + b"\r\n" + b"%x\r\n" % (len(PAGE.encode()) - 5) + PAGE.encode()[5:] + b"\r\n0\r\n\r\n"),
    ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n" % len(gzip.compress(PAGE.encode(), mtime=0)) + gzip.compress(PAGE.encode(), mtime=0) + b"\r\n0\r\n\r\n"),
])
def test_codings_are_undone(head, payload):
    text, meta = warc.derive_one("s", "u", warc.DATE, message(head, payload))
    assert "naïve" in text["block"] and "title: Café" in meta["block"] and "conversion-error" not in meta["block"]
    assert text["payload_digest"] == warc.digest(payload)


@pytest.mark.parametrize(("head", "payload"), [("Content-Encoding: br", b"\x0b\x02"), ("Content-Encoding: gzip", gzip.compress(b"x" * 99)[:-9]), ("Transfer-Encoding: chunked", b"ff\r\nshort")])
def test_what_cannot_be_undone_is_said(head, payload):
    text, meta = warc.derive_one("s", "u", warc.DATE, message(head, payload))
    assert text["block"] == "" and "conversion-error: " in meta["block"]


def test_folded_fields_are_one():
    headers, _ = warc.split_http(message("A: 1\r\n  2\r\n\t3\r\nB: x", b""))
    assert headers == [("A", "1 2 3"), ("B", "x")]


def test_bytes_tell_rows_of_one_digest_apart(spark):
    one = exact.ExactDedup(spark, digest=lambda text: exact.sha256(text).substr(1, 1))
    rng, rows, last = random.Random(3), [], {}
    for batch in range(3):
        new = [(100 * batch + i, f"{rng.randrange(40):02}") for i in range(60)]
        one.append(spark.createDataFrame(new, "doc_id long, text string").repartition(3))
        one.process()
        rows += new
        for i, t in new:
            last[t] = max(i, last.get(t, -1))
        sizes = {t: sum(t == x for _, x in rows) for t in last}
        got = {r.id: (r.keep_id, r.group_size, r.kept) for r in one.decisions().collect()}
        assert got == {i: (last[t], sizes[t], last[t] == i) for i, t in rows}


def test_no_python_in_exact_dedup(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = exact.deduplicate(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
