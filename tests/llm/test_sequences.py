"""As-of joins, phrases and the hidden Markov model against brute force."""

import bisect
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import asof, hmm, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_asof(points, orders, tolerance):
    runs = defaultdict(lambda: defaultdict(list))
    for key, t, priority, id_, value in orders:
        if key is not None and t is not None:
            runs[key][t].append((priority is None, -(priority or 0), id_ is None, id_ or 0, id_, value))
    seen = {}
    for pid, key, t in points:
        k, s = seen.get(pid, (None, None))
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        seen[pid] = (least(k, key), least(s, t))
    out = set()
    for pid, (key, t) in seen.items():
        row = (pid, key, t, None, None, None, 0)
        if key in runs and t is not None:
            times = sorted(runs[key])
            at = bisect.bisect_right(times, t) - 1
            if at >= 0 and t - times[at] <= tolerance:
                best = min(runs[key][times[at]], key=lambda r: r[:4])
                row = (pid, key, t, best[4], t - times[at], best[5], len(runs[key][times[at]]))
        out.add(row)
    return out


@pytest.mark.parametrize("limit", [5, 40, None])
def test_asof(spark, limit):
    rng = random.Random(3)
    maybe = lambda x: None if rng.random() < 0.03 else x
    key = lambda: 7 if rng.random() < 0.4 else rng.randrange(12)
    time = lambda: rng.choice([rng.randrange(-300, 900), 100 * rng.randrange(-3, 9)])
    points = [(maybe(i), maybe(key()), maybe(time())) for i in range(500)]
    points += points[:40] + [(None, 7, 50), (3, 7, -5)]
    orders = [(maybe(key()), maybe(time()), maybe(rng.randrange(1, 4)), maybe(i), maybe(i * 10)) for i in range(400)]
    a = spark.createDataFrame([(*p, "x") for p in points], "pid long, key long, t long, value string").repartition(3)
    b = spark.createDataFrame([(*o, 1) for o in orders], "key long, t long, priority long, id long, value long, slot int").repartition(4)
    got = [tuple(r) for r in asof.tolerant_join(a, b, 100, limit).collect()]
    want = brute_asof(points, orders, 100)
    assert len(got) == len(want)
    assert set(got) == want


def test_asof_of_empty_tables(spark):
    none = spark.createDataFrame([], "key long, t long, priority long, id long, value long")
    one = spark.createDataFrame([(1, 2, 3)], "pid long, key long, t long")
    assert [tuple(r) for r in asof.tolerant_join(one, none, 10).collect()] == [(1, 2, 3, None, None, None, 0)]
    assert asof.tolerant_join(one.where("pid > 1"), none, 10).collect() == []


def test_micros_have_no_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.000001' as a, timestamp_ntz'1969-12-31 23:59:59' as b, cast(null as timestamp_ntz) as c")
        assert tuple(df.select(*[asof.micros(x, df) for x in "abc"]).first()) == (1710037800000001, -1000000, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        some = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            inside = any(len(q) > len(p) and c == a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in counts.items() if c >= least)
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                some.append((-score, -a, " ".join(p).encode(), p, k))
        for i, (score, a, _, p, k) in enumerate(sorted(some)[:top], 1):
            out.add((lang, i, " ".join(p), -a, counts[p[:k]], counts[p[k:]], n[lang], -score))
    return out


def spoken(seed=5, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "Ünï", "x" * 90, "a", "b", "\x00z", "stock", "exchange"]
    fixed = ["new york stock exchange", "a b a b a b", "of the é"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([rng.choice(words), rng.choice(fixed)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", " \x0b"]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "de", "und", None, ""]), rng.choice([text, text, text, None, "", text + text])))
    return rows


@pytest.mark.parametrize(("least", "top"), [(6, 2000), (12, 5)])
def test_phrases(spark, least, top):
    rows = spoken()
    docs = spark.createDataFrame([(*r, i, 0) for i, r in enumerate(rows)], "lang string, text string, rank long, phrase int").repartition(3)
    got = [tuple(r) for r in phrases.collocations(docs, least, top).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_phrases(rows, least, top)


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", " .\n")], "lang string, text string")).collect() == []


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_phrases_across_parts(monkeypatch, size):
    monkeypatch.setattr(phrases, "SHARD", size)
    rows = [("en", t) for _, t in spoken(9, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([t or "" for _, t in rows])], ["lang", "text"])
    got = Counter()
    for least, most in ((1, 1), (2, 2), (3, 5)):
        for b in phrases._counted(least, most, [])(iter([batch])):
            for words, phrase, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                assert words == len(phrase.split(" "))
                got[phrase] += n
    want = Counter()
    for _, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            want.update(" ".join(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    assert got == want


def test_scores_beyond_64_bits(spark):
    a, n = 3 * 10**11, 7 * 10**12
    frequent = spark.createDataFrame([("en", 1, "x", 10**12), ("en", 1, "y", 4 * 10**11), ("en", 2, "x y", a)], "lang string, words int, phrase string, n long")
    totals = phrases.cut(spark.createDataFrame([("en", n)], "lang string, total long"), "totals")
    assert phrases.score_cuts(frequent, totals).first().score == 1000 * a * n // (10**12 * 4 * 10**11)


def small_model(k=3):
    rng = np.random.default_rng(1)
    emit = rng.random((hmm.CLASSES + 1, k)) ** 4 + 1e-3
    step = rng.random((k, k)) + 0.1
    return hmm.Model(np.array([0.5, 0.3, 0.2])[:k], step / step.sum(1, keepdims=True), emit / emit.sum(0))


def test_recursions_against_all_paths():
    m, texts = small_model(), [[5, 9, 5, 2], [7], [9, hmm.CLASSES, 5], [1, 0]]
    got = hmm.Texts([np.array(t, np.uint16).tobytes() for t in texts])
    scores, _ = got.forward(m)
    starts, steps, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES + 1, 3))
    for text, score in zip(texts, scores, strict=True):
        paths = {}
        for path in itertools.product(range(3), repeat=len(text)):
            p = m.start[path[0]] * m.emit[text[0], path[0]]
            for i in range(1, len(text)):
                p *= m.step[path[i - 1], path[i]] * m.emit[text[i], path[i]]
            paths[path] = p
        total = sum(paths.values())
        assert score == pytest.approx(math.log10(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for i, s in enumerate(path):
                emits[text[i], s] += p / total
                if i:
                    steps[path[i - 1], s] += p / total
    expected = got.expected(m)
    for a, b in zip(expected[:3], (starts, steps, emits), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_rounds_never_lose_and_chances_add_up():
    rng = np.random.default_rng(4)
    raw = [(rng.integers(1, 30, rng.integers(1, 40)) + 100 * (i % 2)).astype(np.uint16).tobytes() for i in range(80)]
    prior = np.full(hmm.CLASSES, 1 / hmm.CLASSES)
    model, texts, before = hmm.begin(raw, prior, 2, 0), hmm.Texts(raw), -np.inf
    for _ in range(12):
        now = texts.forward(model)[0].sum()
        assert now > before - 2  # smoothing may cost a little
        before = now
        model = hmm.improved(*texts.expected(model), prior)
        np.testing.assert_allclose(model.emit.sum(0), 1)
        np.testing.assert_allclose(model.step.sum(1), 1)


def test_language_model(spark):
    rng = random.Random(8)
    vocabulary = {x: [f"{x}{i}" for i in range(60)] for x in ("a", "b")}
    rows = [(i, " ".join(rng.choices(vocabulary[rng.choice("ab")], k=rng.randrange(0, 80)))) for i in range(400)]
    rows += [(None, "A1 b2"), (None, None), (7, ""), (7, "ＡÉ ünï" + " a1" * 3000), (500, "never" + "z" * 5000)]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, score double, n_known int").repartition(5)
    got = hmm.score(docs, rounds=2).collect()
    tokens = [(i, re.findall("[^ \t-\r]+", (t or "").translate(LOWER)) + [" "]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    unseen = [r for r in got if r.held_out]
    assert all(math.isfinite(r.score) for r in got)
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_language_model_without_training(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = hmm.score(docs).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    assert hmm.score(docs.where("doc_id < 0")).collect() == []
