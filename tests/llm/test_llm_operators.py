"""Operators against brute force, and on rows with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import components, exact, flat, jaccard, lengths, pieces, quality, suffixes, tiling, toxicity, urls, warc
from quillstone.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, at string, id string"
MODEL = "piece_bpe_32k.model"


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 30, 80, 200, 500)]
    shared = words(rng, 60, 10**6)
    near = base[3].split()
    out = [*base, base[2], base[2], shared + " " + base[1], base[1] + " " + shared, " ".join([*near[:190], *(f"x{i}" for i in range(10))]), " ".join([*near[:198], "y", "z"]), "", None, "a", "é " * 400, "ab" * 900, "long " * 6000, words(rng, 20_000)]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 3}", None, "clash", "clash", "clash") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated and null ids, repeated rows."""
    rows = [(1, "same text here for all of us"), (1, "same text here for all of us"), (1, "other"), (None, "same text here for all of us"), (None, None), (2, "")]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)


def brute_repeats(rows, t):
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        cov = bytearray(len(b))
        for s in range(len(b) - t + 1):
            w = b[s : s + t]
            if w in seen:
                cov[s : s + t] = b"\1" * t
            else:
                seen.add(w)
        spans = sum(1 for j in range(len(cov)) if cov[j] and (j == 0 or not cov[j - 1]))
        out[i] = (len(b), sum(cov), spans, hashlib.sha256(bytes(x for x, c in zip(b, cov, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("t", [100, 17])
def test_repeats(docs, texts, t):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, threshold=t).collect()}
    assert got == brute_repeats(texts, t)


def test_repeats_long_rows_go_in_parts(monkeypatch, spark):
    rng = random.Random(1)
    t = words(rng, 3000, 50)
    data, off = flat.flatten(pa.array([t + t]))
    whole = [np.concatenate(x) for x in zip(*suffixes.anchors(data, off, np.array([7]), 100), strict=True)]
    monkeypatch.setattr(flat, "BLOCK_BYTES", 1500)
    flat._powers.clear()
    parts = [np.concatenate(x) for x in zip(*suffixes.anchors(data, off, np.array([7]), 100), strict=True)]
    assert {*zip(*(x.tolist() for x in whole), strict=True)} == {*zip(*(x.tolist() for x in parts), strict=True)}
    h, _, _ = flat.word_hashes(data, off)
    monkeypatch.undo()
    assert np.array_equal(h, flat.word_hashes(data, off)[0])


def in_small_blocks(make, size):
    """``make`` of a batch function that runs with BLOCK_BYTES = ``size``, in the worker too."""

    def made(*args):
        def run(batches):
            before, flat.BLOCK_BYTES, flat.runs.__defaults__ = flat.BLOCK_BYTES, size, (size,)
            try:
                yield from make(*args)(batches)
            finally:
                flat.BLOCK_BYTES, flat.runs.__defaults__ = before, (before,)

        return run

    return made


@pytest.mark.parametrize("size", [1500, 40])
def test_repeats_across_parts(monkeypatch, spark, size):
    rng = random.Random(11)
    same = words(rng, 100, 10**6)
    rows = [(0, words(rng, 3000, 10**6)), (1, words(rng, 900, 10**6) + same + words(rng, 900, 10**6) + same), (2, same), (3, "ab" * 4000)]
    for name in ("_anchor_batches", "_range_batches"):
        monkeypatch.setattr(suffixes, name, in_small_blocks(getattr(suffixes, name), size))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, threshold=100).collect()}
    assert got == brute_repeats(rows, 100) and got[0][1] == 0


def test_repeats_odd_and_empty(odd):
    got = suffixes.remove_repeats(odd, threshold=8, texts=True).collect()
    assert len(got) == odd.count() and sum(r.n_removed > 0 for r in got) == 2
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, num):
    s = {i: shingles(t, k) for i, t in rows}
    p = {i: i for i in s}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                x, y = find(a), find(b)
                p[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize(("k", "num", "block"), [(4, 85, 256), (5, 80, 2)])
def test_jaccard(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(90)}" for _ in range(rng.choice([8, 14, 60, 300]))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 12])):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), "One two"), (len(rows) + 1, "one TWO"), (len(rows) + 2, ""), (len(rows) + 3, None), (len(rows) + 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(df, k=k, num=num).collect()}
    assert got == brute_components(rows, k, num)
    stay = {r.doc_id for r in jaccard.nearest_stay(df, k=k, num=num).collect()}
    assert stay == {i for i, (_, c) in got.items() if i == c}


def test_jaccard_odd_and_empty(odd):
    got = jaccard.join_classes(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.n_shingles == 3} == {1}
    assert jaccard.join_classes(odd.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_exact(docs, texts, odd):
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.deduplicate(docs).collect()}
    assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    stay = exact.last_stay(docs)
    assert {r.doc_id for r in stay.collect()} == {max(g) for g in groups.values()} and stay.columns == docs.columns
    made = exact.deduplicate(odd).collect()
    assert len(made) == odd.count() and sum(r.kept for r in made) == 3
    assert exact.last_stay(odd).count() == 3 and exact.deduplicate(odd.limit(0)).count() == 0


def test_exact_state_goes_on(spark, docs):
    one = exact.ExactDedup(spark)
    one.append(docs)
    one.process()
    one.append(spark.createDataFrame([(999, "a")], "doc_id long, text string"))
    one.process()
    row = one.state().where(F.col("digest") == hashlib.sha256(b"a").hexdigest()).first()
    assert (row.stay_id, row.group_size) == (999, 2)


def test_pieces_equal_the_library(spark, docs, texts, odd):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=tokenizer(MODEL))
    rng = random.Random(2)
    more = ["".join(rng.choice("ab  c▁é\n日😀") for _ in range(rng.randrange(60))) for _ in range(400)] + ["<s> </s> <0x0A>", " ", "▁", "x" * 900]
    own = pieces.model(tokenizer(MODEL))
    all_ = [t or "" for _, t in texts] + more
    want = sp.encode(all_, add_bos=True, add_eos=True)
    assert own.encode(all_) == want
    assert [own.decode(x) for x in want] == [sp.decode(x) for x in want]
    broken = [[1, 230, 2], [3 + 0xE9, 3 + 0x41], [5, 1, 29871, 6]]
    assert [own.decode(x) for x in broken] == [sp.decode(x) for x in broken]
    got = pieces.encode(docs, tokenizer(MODEL))
    for r in got.collect():
        ids = sp.encode(dict(texts)[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    back = {r.doc_id: r.text for r in pieces.decode(got, tokenizer(MODEL)).collect()}
    assert back == {i: (t or "") for i, t in texts}
    assert pieces.encode(odd, tokenizer(MODEL)).count() == odd.count() and pieces.encode(odd.limit(0), tokenizer(MODEL)).count() == 0


def test_long_words_and_rounds_agree():
    own = pieces.model(tokenizer(MODEL))
    rng = random.Random(3)
    for _ in range(30):
        w = "▁" + "".join(rng.choice("theandigr") for _ in range(rng.randrange(1, 80)))
        rounds = own.encode([w[1:]])[0][1:-1]
        assert [own.ids[s] for s in own._heap(w)] == rounds


def test_tiling(spark, docs, odd):
    rng = random.Random(4)
    item = [f"b{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, words(rng, 30, 10**6)), (3, "too short"), (4, None)], "item_id long, text string")
    reordered = " ".join([*item[20:], "x", *item[:20]]).upper()
    rows = [(1, words(rng, 100) + " " + " ".join(item) + "."), (2, reordered), (3, " ".join(item[:15])), (4, words(rng, 300)), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {r.doc_id: (r.contaminated, r.item_id, r.coverage) for r in tiling.judge(df, bench).collect()}
    assert got == {1: (True, 1, 1.0), 2: (True, 1, 1.0), 3: (False, None, None), 4: (False, None, None), 5: (False, None, None), 6: (False, None, None)}
    clean = tiling.clean_stay(df, bench)
    assert {r.doc_id for r in clean.collect()} == {3, 4, 5, 6} and clean.columns == df.columns
    assert tiling.judge(odd, bench).count() == odd.count() and tiling.judge(odd.limit(0), bench).count() == 0
    assert tiling.judge(df, bench.limit(0)).where("contaminated").count() == 0


def test_tiling_marks_never_overlap():
    items = tiling.Items([1], ["a b c d e f g h i j"], 5)
    doc, _ = tiling._words(pa.array(["a b c d e f a b c d e f g h i j"]))
    assert items.coverage(doc) == {0: 1.0}
    twice, _ = tiling._words(pa.array(["a b c d e x a b c d e"]))
    assert items.coverage(twice) == {0: 0.5}


def test_tiling_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 60)
    bench = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(8))) for i in range(6)], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(8))) for i in range(8)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in tiling.judge(df, bench).collect()} == {(i, i if i < 6 else None) for i in range(8)}


def test_tiling_in_blocks_of_odd_rows(spark, monkeypatch, odd):
    item = "some words of an item to find"
    bench = spark.createDataFrame([(i, f"{item} {i} " + " ".join(f"i{i}w{j}" for j in range(3))) for i in range(6)], "item_id long, text string")
    more = odd.unionByName(spark.createDataFrame([(1, f"{item} 1", None, None, None, None, None, None), (None, f"{item} 2", None, None, None, None, None, None)], SCHEMA))
    whole = sorted((str(r.doc_id), r.contaminated, r.n_items) for r in tiling.judge(more, bench).collect())
    clean = sorted(str(r) for r in tiling.clean_stay(more, bench).collect())
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 60)
    assert sorted((str(r.doc_id), r.contaminated, r.n_items) for r in tiling.judge(more, bench).collect()) == whole and len(whole) == 8
    assert sorted(str(r) for r in tiling.clean_stay(more, bench).collect()) == clean and len(clean) == 6


URLS = [None, "", "no scheme", "http://A.Net/x", "https://sub.example.NET/en/1?q#f", "http://example.com/de/", "http://x.org/fr/a", "http://x.org/fr", "http://net/", "http://net", "http://badnet/x", "http://a.com/x.net/en/", "http://adult-x.example.com/en/", "x://É.net/é?://y.org/fr/"]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: tuple(r)[1:] for r in urls.filter_urls(df).collect()}
    assert got[3] == ("a.net", "/x", "net/", "block") and got[4] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "allow")
    assert got[8][2:] == ("net/", "block") and got[9] == ("net", "", None, "allow") and got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow")
    assert got[12][2:] == (None, "block") and got[13] == ("É.net", "/é", "net/", "block") and got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_shift_and_equals_regex():
    rng = random.Random(6)
    globs = [bytes(rng.choice(b"ab*?") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    ok = urls.ShiftAnd(globs).accepted(texts)
    for j, g in enumerate(globs):
        r = re.compile(re.escape(g).replace(rb"\*", b".*").replace(rb"\?", b".") + rb"\Z", re.S)
        assert ok[:, j].tolist() == [bool(r.match(t)) for t in texts]


def test_warc(spark):
    page = "<html lang='en'><head><title>A &amp; B</title><script>no</script></head><body><p>One &lt;two&gt;<br>three</p><!-- no --><a href='/x'>link</a></body></html>"
    rows = [(1, "http://a/", page), (2, None, None), (None, "http://b/\r\nX: y", "<p>open <b>text"), (1, "http://a/", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    source = {r.record_id: r for r in warc.responses(df).collect()}
    made = warc.derive(warc.responses(df)).collect()
    assert len(made) == 8 and warc.derive(warc.responses(df.limit(0))).count() == 0
    for r in made:
        (fields, block), = warc.parse(bytes(r.record))
        assert fields["WARC-Refers-To"] == r.refers_to in source and fields["WARC-Type"] == r.warc_type and block.decode() == r.block
        assert fields["WARC-Block-Digest"] == warc.digest(block) and int(fields["Content-Length"]) == r.content_length == len(block)
        headers, payload = warc.split_http(bytes(source[r.refers_to].http))
        assert r.payload_digest == warc.digest(payload) and r.source_headers == headers and "X" not in fields
    text = next(r.block for r in made if r.source_id == 1 and r.warc_type == "conversion")
    assert text == "A & B\nOne <two>\nthree\nlink"
    meta = next(r.block for r in made if r.source_id == 1 and r.warc_type == "metadata")
    assert "title: A & B\r\n" in meta and "outlink: /x\r\n" in meta and "language: en\r\n" in meta


def test_warc_keeps_repeated_fields(spark):
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/html; charset=utf-8\r\nSet-Cookie: b=2\r\n\r\n<p>x"
    df = spark.createDataFrame([(1, "<urn:uuid:1>", "http://a/", warc.DATE, http)], "source_id long, record_id string, target_uri string, warc_date string, http binary")
    made = warc.derive(df).collect()
    assert len(made) == 2
    for r in made:
        assert [tuple(x) for x in r.source_headers] == [("Set-Cookie", "a=1"), ("Content-Type", "text/html; charset=utf-8"), ("Set-Cookie", "b=2")]
        assert b"X-Source-Set-Cookie: a=1\r\n" in bytes(r.record) and b"X-Source-Set-Cookie: b=2\r\n" in bytes(r.record)


def test_docs_cut_at_any_limit(spark):
    n = [0, 3, 3, 7, 20]
    sums = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long")))
    limits = [0, 1, 3, 5, 7, 8, 20, 21]
    got = {r.context_limit: (r.docs_cut, r.tokens_kept) for r in lengths.at_limits(sums, limits).collect()}
    assert got == {c: (sum(x > c for x in n), sum(min(x, c) for x in n)) for c in limits}


def test_lengths(spark, docs, texts, odd):
    path = tokenizer("byte_bpe_50k.tiktoken")
    encode = lengths._encoding(path).encode_ordinary
    n = [len(encode(t or "")) for _, t in texts]
    sums = lengths.suffix_sums(lengths.histogram(lengths.token_lengths(docs, path)))
    for r in sums.collect():
        assert r.n_docs == n.count(r.n_tokens) and r.tokens_total == sum(n) and r.docs_total == len(n)
        assert r.tokens_kept == sum(min(x, r.n_tokens) for x in n) and r.docs_cut == sum(x > r.n_tokens for x in n)
    assert {r.context_limit: r.tokens_kept for r in lengths.at_limits(sums, [0, 1, 7, 100, 10**7]).collect()} == {c: sum(min(x, c) for x in n) for c in (0, 1, 7, 100, 10**7)}
    q = {r.share: r.n_tokens for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert q == {s: sorted(n)[math.ceil(s * len(n)) - 1] for s in (0.1, 0.5, 1.0)}
    assert lengths.histogram(lengths.token_lengths(odd.limit(0), path)).count() == 0


def labelled(spark, n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        w = words(rng, 60, 3000).split()
        if toxic:
            for _ in range(rng.randrange(1, 8)):
                w[rng.randrange(60)] = rng.choice(["vileword", "rottenone", "nastything"])
        t = " ".join(w)
        rows.append((i, "!!! ".join(t.upper().split()) if bad else t, "en", f"s{i % 4}"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame([x for x in labels if x[0] % 2 == 0], "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd):
    df, labels = labelled(spark)
    model = toxicity.train(df, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in got if i % 2]
    assert sum(got[i].toxic == (i % 7 == 0) for i in held) / len(held) > 0.97
    for r in got.values():
        assert r.p_above == sorted(r.p_above, reverse=True) and abs(sum(r.p_above) - r.expected_severity) < 1e-9
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.train(df, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(odd, none).collect())


def test_toxicity_of_one_long_word(spark):
    n = 2 * flat.BLOCK_BYTES + 1000
    h, row = flat.stem_hashes(*flat.flatten(pa.array(["é" * (n // 2)])), toxicity.STEMS, toxicity.BETWEEN)
    assert len(set(h.tolist())) == 1 + len(toxicity.STEMS) and not row.any()
    many, _ = flat.stem_hashes(*flat.flatten(pa.array(["ab cdefg " + "x" * n + " yz"])), toxicity.STEMS, toxicity.BETWEEN)
    apart, _ = flat.stem_hashes(*flat.flatten(pa.array(["ab cdefg", "x" * n, "yz"])), toxicity.STEMS, toxicity.BETWEEN)
    assert sorted(many.tolist()) == sorted(apart.tolist())
    df, labels = labelled(spark, 60)
    model = toxicity.train(df, labels)
    assert toxicity.score(spark.createDataFrame([(1, "x" * n)], "doc_id long, text string"), model).count() == 1


def test_quality(spark, odd):
    df, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert all(got[i].kept == (i % 5 != 0) for i in got)
    stay = quality.good_stay(df, labels)
    assert {r.doc_id for r in stay.collect()} == {i for i in got if i % 5} and stay.columns == df.columns
    clash = odd.withColumn("path", F.lit("clash")).withColumn("logit", F.lit("clash")).withColumn("posterior", F.lit("x"))
    assert quality.good_stay(clash, labels).columns == clash.columns
    assert quality.judge(odd, labels).count() == odd.count() and quality.judge(odd.limit(0), labels).count() == 0
    assert all(r.kept for r in quality.judge(df, labels.where("quality = 1")).collect())


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 3.0)] * 50 + [("big", "b", -3.0)] * 50 + [("tiny", "a", -3.0)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, logit double"))
    got = {(r.site_host, r.site_path): r.path_mean for r in sites.collect()}
    assert got["big", "b"] < got["tiny", "a"] < mean < got["big", "a"]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_defeat_sums(spark):
    """Thue-Morse words and their complements collide under every sum of powers modulo 2**64."""
    own = pieces.model(tokenizer(MODEL))
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=tokenizer(MODEL))
    both = [thue_morse(2048), thue_morse(2048).translate({97: "b", 98: "a"})]
    assert own.encode(both) == sp.encode(both, add_bos=True, add_eos=True)
    data, off = flat.flatten(pa.array(both))
    h, _, _ = flat.word_hashes(data, off)
    assert h[0] != h[1]
    short, at = flat.flatten(pa.array([x[:60].upper() for x in both] + [both[0][:60]]))
    h, _, _ = flat.word_hashes(short, at)
    assert h[0] != h[1] and h[0] == h[2]
    df = spark.createDataFrame([*enumerate(both)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join_classes(df).collect()} == {0: 0, 1: 1}


def test_jaccard_keys_meet_whatever_is_common():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 256, 1 << (jaccard.MARKS - 3), dtype=np.uint8)  # half of all shingles come last
    for _ in range(300):
        n = int(rng.integers(1, 60))
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both[int(rng.integers(0, 4)) :], rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)])) for _ in "ab")
        if len(a) and len(b) and jaccard.linked(a, b, 80, 100) and not np.array_equal(a, b):
            assert np.intersect1d(jaccard.tile_keys(a, marks, 80, 100), jaccard.tile_keys(b, marks, 80, 100)).size


def test_jaccard_hot_passage_of_several_blocks(spark, monkeypatch):
    """Documents that are mostly one passage meet under its shingles, in several blocks, without being alike."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"o{i if i % 3 else i // 9 * 9}x{j}" for j in range(12))])) for i in range(60)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 5, 80)


def test_lengths_of_long_blank_runs(spark):
    path = tokenizer("byte_bpe_50k.tiktoken")
    encoding = lengths._encoding(path)
    rng = random.Random(8)
    for _ in range(40):
        t = "".join(rng.choice([" " * 1200, "\n" * 1100, "a b", " \t" * 700, "　" * 1000, "x", " ", "\x1c" * 1500, "1"]) for _ in range(6))
        assert lengths.count(encoding, t) == len(encoding.encode_ordinary(t))
    long = spark.createDataFrame([(1, " " * 2_000_000 + "end"), (2, "a " * 300_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens > 0 for r in lengths.token_lengths(long, path).collect()} == {1: True, 2: True}


def test_warc_against_plain_patterns():
    """The linear scans find what the plain patterns do, and tags that never close take no time."""
    title, href = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I), re.compile(r"<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I)
    lang, tag = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I), re.compile(r"<[a-zA-Z/!?][^>]*>")
    rng = random.Random(6)
    parts = ["<title", ">", "</title>", "<a ", "href=", "href = 'x y'", "<html ", "lang=", "lang='de'", " ", "t", "<b>", "&amp;", "<a", '"', "<p "]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        found = title.search(page)
        assert warc.title_of(page) == (warc.html.unescape(tag.sub("", found[1])) if found else "")
        assert warc.links_of(page) == [*dict.fromkeys(href.findall(page))]
        found = lang.search(page)
        assert warc.language_of(page) == (found[1] if found else "")
        assert warc._without(tag, "", page) == tag.sub("", page)
    began = __import__("time").time()
    for part in ("<title>", "<title", "<a ", "<html ", "<a href=x ", "<html lang=", "<p ", "<b", "</title", "<!-- ", "<script "):
        warc.derive_one("<urn:uuid:1>", "u", warc.DATE, b"HTTP/1.1 200 OK\r\n\r\n" + (part * (1_000_000 // len(part))).encode())
    assert __import__("time").time() - began < 60


def test_warc_header_bytes_stay():
    head = b"HTTP/1.1 200 OK\r\nServer: caf\xe9\r\nVia: \xc3\xa9\r\n\r\nbody"
    made = warc.derive_one("<urn:uuid:1>", "u", warc.DATE, head)
    assert all(b"X-Source-Server: caf\xe9\r\nX-Source-Via: \xc3\xa9\r\n" in x["record"] for x in made)
    assert made[0]["source_headers"] == [{"name": "Server", "value": "caf�"}, {"name": "Via", "value": "é"}]


def test_exact_over_appends(spark):
    one = exact.ExactDedup(spark)
    for _ in range(2):
        one.append(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1))
        one.process()
    made = one.decisions().collect()
    assert sorted((r.id, r.batch, r.group_size, r.kept) for r in made) == [(1, 0, 2, False), (1, 1, 2, True), (2, 0, 2, False), (2, 1, 2, True)]


def test_exact_large_group_and_ties(spark, monkeypatch):
    monkeypatch.setattr(exact, "CHUNK", 4)
    df = spark.createDataFrame([(i, "copy") for i in range(30)] + [(30, "own")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.deduplicate(df).collect()} == {(i, 29, 30, i == 29) for i in range(30)} | {(30, 30, 1, True)}
    tie = spark.createDataFrame([(1, "a", {"k": "1"}, x) for x in ("x", "z", "y")], "doc_id long, text string, `a.map` map<string,string>, `b.c` string")
    assert [r["b.c"] for r in exact.last_stay(tie).collect()] == ["z"] and exact.last_stay(tie).columns == tie.columns


def test_stages_keep_columns_with_dots(spark):
    df = spark.createDataFrame([(i, f"some words of a text {i} that go on", "en", "s", 1.5, {"k": i}) for i in range(6)], "doc_id long, text string, lang string, source string, `a.b` double, m map<string,int>")
    bench = spark.createDataFrame([(1, "nothing of that sort is here at all")], "item_id long, text string")
    assert tiling.clean_stay(df, bench).columns == df.columns and tiling.clean_stay(df, bench).count() == 6


def test_likelihood_slopes():
    """Against finite differences; the thresholds stay in order whatever the parameters."""
    rng = np.random.default_rng(5)
    n, k = 40, 6
    r, local, v = np.repeat(np.arange(n), 3), rng.integers(0, k, 3 * n), rng.random(3 * n) + 0.5
    y = rng.integers(0, toxicity.GRADES, n)
    for _ in range(5):
        p = rng.normal(size=k + toxicity.GRADES - 1)
        _, grad = toxicity.likelihood(p, r, local, v, y, 1e-3)
        for i in range(len(p)):
            step = np.zeros(len(p))
            step[i] = 1e-6
            slope = (toxicity.likelihood(p + step, r, local, v, y, 1e-3)[0] - toxicity.likelihood(p - step, r, local, v, y, 1e-3)[0]) / 2e-6
            assert slope == pytest.approx(grad[i], abs=1e-5)


def test_toxicity_scores_by_hand(spark):
    """Scores of a fitted model, word by word in plain Python."""
    df, labels = labelled(spark, 200)
    model = toxicity.train(df, labels)
    rows = {r.doc_id: r.text for r in df.limit(25).collect()} | {900: "vileword, VILEWORD! rottenone " * 3, 901: "", 902: None}
    asked = spark.createDataFrame([*rows.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(asked, model).collect()}
    for i, t in rows.items():
        places = {}
        for w in re.findall("[0-9a-z]+", (t or "").lower()):
            raw = pa.array([w])
            for h in flat.stem_hashes(*flat.flatten(raw), toxicity.STEMS, toxicity.BETWEEN)[0].tolist():
                places[h >> (64 - toxicity.BITS)] = places.get(h >> (64 - toxicity.BITS), 0) + 1
        s = sum(model.weights[x] * (1 + math.log(c)) for x, c in places.items())
        above = [1 / (1 + math.exp(b - s)) for b in model.thresholds.tolist()]
        assert got[i].p_above == pytest.approx(above) and got[i].expected_severity == pytest.approx(sum(above)) and got[i].toxic == (above[0] >= model.cut)


def test_quality_posteriors_by_hand(spark):
    """Host and path means without the document itself, shrunk, in plain Python from p_document."""
    df, labels = labelled(spark, 150)
    df = df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "de")).withColumn("source", F.when(F.col("doc_id") == 7, "alone").otherwise(F.col("source")))
    rows = quality.judge(df, labels).collect()
    n = len(rows)
    mean = (sum(r.p_document for r in rows) + 0.5) / (n + 1)

    def strength(groups, parent):
        got = [(len(g), sum(g), m) for g, m in zip(groups, parent, strict=True)]
        v, m_, w = sum(c * (s / c - m) ** 2 for c, s, m in got), sum(c * m * (1 - m) for c, _, m in got), sum(m * (1 - m) for _, _, m in got)
        return min(max(m_ / n / max((v - w) / n, 1e-9) - 1, 1.0), 1e6)

    hosts, paths = {}, {}
    for r in rows:
        hosts.setdefault(r.host, []).append(r.p_document)
        paths.setdefault((r.host, r.path), []).append(r.p_document)
    k = strength(hosts.values(), [mean] * len(hosts))
    whole = {h: (sum(g) + k * mean) / (len(g) + k) for h, g in hosts.items()}
    k2 = strength(paths.values(), [whole[h] for h, _ in paths])
    for r in rows:
        h, g = hosts[r.host], paths[r.host, r.path]
        host = (sum(h) - r.p_document + k * mean) / (len(h) - 1 + k)
        path = (sum(g) - r.p_document + k2 * host) / (len(g) - 1 + k2)
        odds = math.log(r.p_document / (1 - r.p_document)) + math.log(path / (1 - path)) - math.log(mean / (1 - mean))
        assert (r.host_mean, r.path_mean) == (pytest.approx(host), pytest.approx(path)) and r.posterior == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
        assert r.kept == (r.posterior >= 0.5)


def test_warc_records_by_another_parser(spark):
    """Records read back line by line: links, lengths and digests."""
    import base64
    import html.parser

    class Visible(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.said, self.hidden, self.links = [], 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            self.links += [v for k, v in attrs if tag == "a" and k == "href"]

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")

        def handle_data(self, data):
            self.said += [] if self.hidden else data.split()

    rng = random.Random(12)
    parts = ["<p>one two</p>", "<a href='http://x/1'>link</a>", "<script>var a = 1;</script>", "<b>bold</b>", "<br/>", "&amp; more", "<style>p {}</style>", "text"]
    pages = [(i, f"http://h/{i}", "<html lang='de'><head><title>T &amp; t</title></head><body>" + " ".join(rng.choice(parts) for _ in range(12)) + "</body></html>") for i in range(30)]
    made = warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    sha = lambda raw: "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert len(made) == 60
    for r in made:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        block = rest[: int(fields["Content-Length"])]
        page = pages[r.source_id][2]
        assert first == "WARC/1.0" and rest == block + b"\r\n\r\n" and block.decode() == r.block and sha(bytes(r.record)) == r.record_digest
        assert (fields["WARC-Type"], fields["WARC-Refers-To"], fields["WARC-Target-URI"]) == (r.warc_type, r.refers_to, pages[r.source_id][1])
        assert (fields["WARC-Block-Digest"], fields["WARC-Payload-Digest"]) == (sha(block), sha(page.encode()))
        assert fields["X-Source-Content-Type"] == "text/html; charset=utf-8"
        seen = Visible()
        seen.feed(page)
        if r.warc_type == "conversion":
            assert r.block.split() == seen.said
        else:
            meta = [x.split(": ", 1) for x in r.block.split("\r\n")[:-1]]
            assert meta[:3] == [["title", "T & t"], ["language", "de"], ["charset", "utf-8"]] and [v for k, v in meta if k == "outlink"] == [*dict.fromkeys(seen.links)]
    assert len({r.record_id for r in made}) == 60


def brute_tiling(doc, item, seed):
    """Words of the item under marks: the longest unmarked common run, the first in document and item, again and again."""
    d, m, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for x in range(len(doc)):
            for y in range(len(item)):
                n = 0
                while x + n < len(doc) and y + n < len(item) and doc[x + n] == item[y + n] and not d[x + n] and not m[y + n]:
                    n += 1
                if n > best[0]:
                    best = (n, x, y)
        n, x, y = best
        if n < seed:
            return total
        d[x : x + n], m[y : y + n] = [True] * n, [True] * n
        total += n


def test_tiling_against_plain_search():
    rng = random.Random(14)
    for _ in range(150):
        item = [rng.choice("abcde") for _ in range(rng.randrange(8, 30))]
        cut = rng.randrange(len(item))
        doc = [rng.choice("abcde") for _ in range(rng.randrange(0, 12))] + item[cut:] + ["z"] * rng.randrange(2) + item[:cut]
        words, _ = tiling._words(pa.array([" ".join(doc)]))
        got = tiling.Items([1], [" ".join(item)], 4).coverage(words)
        assert got.get(0, 0.0) == brute_tiling(doc, item, 4) / len(item)


def test_jaccard_with_more_copies_than_are_shipped(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(jaccard, "HOT_GROUPS", 1)
    rng = random.Random(23)
    base = [words(rng, 40, 10**6) for _ in range(3)]
    rows = [(i, base[0]) for i in range(40)] + [(40 + i, base[1]) for i in range(5)] + [(50, base[0] + " x"), (51, base[1] + " y"), (52, base[2])]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 5, 80)


def test_urls_long_and_repeated(spark):
    long = "https://Sub.Example.NET/en/" + "x/" * 500_000
    rows = [(1, long), (1, long), (2, None), (2, "http://" + "a." * 100_000 + "net")]
    got = sorted((r.page_id, r.rule or "", r.verdict, len(r.host), len(r.path)) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == [(1, "example.net/en/", "allow", 15, 1_000_004)] * 2 + [(2, "", "allow", 0, 0), (2, "", "allow", 200_003, 0)]
