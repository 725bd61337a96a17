"""Each operator against a brute-force version on a small fixture with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyledger.llm import context_mixing, decontamination, html_extract, license_scan, near_dedup, packing, pii, quality_classifier, quality_rules, url_filter
from skyledger.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def test_near_duplicates(docs, none):
    rows = docs.collect()
    got = near_dedup.near_duplicates(docs).collect()
    sets = [(r.doc_id, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])) for r in rows for w in [words(r.text)]]
    least = list(range(len(sets)))
    for _ in sets:
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    want = []
    for i, (doc, s) in enumerate(sets):
        ids = [d for j, (d, _) in enumerate(sets) if least[j] == least[i] and d is not None]
        want.append((doc, len(s), min(ids, default=None) if s else doc, doc == min(ids, default=None) if s else True))
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert near_dedup.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(3, 3), (1, 0), (25, 20)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).select("node", "root").collect())
    assert got == {i: i // 10 * 10 for i in range(40) if i % 10}


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_decontamination(spark, docs, none, block_bytes):
    phrase = docs.where("doc_id = 12").first().text.split(" ")
    items = [(1, " ".join(phrase[5:20])), (2, "ONE, two"), (3, None), (4, ""), (5, "not anywhere " * 10), (5, " ".join(phrase[5:20])), (None, "no id here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        w = token.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item) if item is not None else "")
    want = []
    for r in docs.collect():
        w, hit, found = token.findall((r.text or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        want.append((r.doc_id or -1, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = decontamination.decontaminate(docs, bench, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id or -1, *tuple(r)[1:6]) for r in got) == sorted(want)
    assert sum(w[5] for w in want) >= 4
    assert decontamination.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(docs, bench.limit(0)).collect())


def test_near_matches_need_all_words_within_the_span(spark):
    docs = spark.createDataFrame([(1, "b x a y c"), (2, "a b x x x x x x c"), (3, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = {r.doc_id: (r.n_near, r.n_hit) for r in decontamination.decontaminate(docs, bench, within=5).collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (1, 3)}


def _base_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans_are_the_patterns():
    rng = np.random.default_rng(3)
    for letters in ("a@.b- %", "1.25 -", "+1 2().-3", "a1@.+-(5 )é"):
        for _ in range(3000):
            text = "".join(rng.choice(list(letters), rng.integers(0, 30)))
            assert pii.base_spans(text) == _base_spans(text), text


def test_pii(docs, none):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    r, text = got[70], docs.where("doc_id = 70").first().text
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    base = ",".join(f"{k}:{a}:{z}" for k, a, z in _base_spans(text))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(r.spans.split(","))
    assert got[40].spans == "" and got[40].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {x.doc_id: x.text for x in pii.mask(docs).collect()}
    assert masked[40] is None and masked[10] == docs.where("doc_id = 10").first().text
    assert "555-2896" not in masked[70].replace("858-555-2896", "") and "<email>" in masked[70]
    assert pii.find(none).count() == 0


def test_repeats_share_the_label():
    weights = pii.fit(np.zeros((0, pii.FEATURES)), np.zeros(0, int))
    weights[0, 0] = 2.0
    _, spans = pii.label("call +1 (858) 555-2896 or 858-555-2896; in 2024", weights)
    assert [s[0] for s in spans] == ["phone", "phone"]
    assert pii.label("in 2024 and 858-555-2896", weights) == ([], [])


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=256).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 256)):
            want[r.doc_id, k, a, min(256, len(ids) - a), zlib.crc32(ids[a : a + 256].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *[n for _, n in sorted(own)]])[:-1]) and sum(n for _, n in own) <= 256
    assert packing.pack(none, path).count() == 0


def test_word_encoder_equals_the_tokenizer():
    import public_tokenizers

    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    texts = [None, "<|startoftext|> a<|endoftext|>b", "J̌ É x", "É ÀÈ×x÷ ß...é é.É ,é,", "漢字。x . Σας İ", "a\u0085b\x1cb", "x" * 3000]
    texts += ["".join(rng.choice(list("aB.'é<|>ß 1\u0301×!Éſ\t漢 sS"), rng.integers(0, 40))) for _ in range(2000)]
    ids, starts = e.texts(pa.array(texts, pa.string()), 0)
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*e.whole.encode(t or "", add_special_tokens=False).ids, 0], t


@pytest.mark.parametrize("rank_by", ["dot", "norm"])
def test_best_fit_keeps_every_capacity(rank_by):
    plan = packing.best_fit({60: 3, 30: 5, 7: 40, 1: 9}, 100, max_docs=4, max_cost=5000, weights=(1.0, 0.5, 0.5), rank_by=rank_by)
    own = collections.defaultdict(list)
    for length, low, high, at, offset in plan.rules.tolist():
        for r in range(low, high):
            own[at + r - low].append((offset, length))
    assert sum(map(len, own.values())) == 57 and len(own) == plan.sequences
    for pieces in own.values():
        assert len(pieces) <= 4 and sum(n for _, n in pieces) <= 100 and sum(n * n for _, n in pieces) <= 5000


def test_quality_rules(docs, none):
    got = collections.Counter(tuple(r)[:7] for r in quality_rules.judge(docs).collect())
    want = collections.Counter()
    for r in docs.collect():
        t = r.text or ""
        w = WORDS.findall(t)
        times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert got == want
    assert quality_rules.judge(none).count() == 0


def test_url_filter(spark):
    urls = ["http://A.NET/x", "http://net/", "http://net", "https://m.example.net/en/1?x", "http://example.net/de/", "x://a.org/fr/#t", "http://b.example.com/de/", "http://notnet/", None, "", "plain", "http://x.net?a=/b"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "")], "page_id long, url string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect() if r.page_id not in (8, 9, 10))
    assert [(r[0], r[3], r[4]) for r in got] == [(0, "net/", "block"), (0, "net/", "block"), (1, "net/", "block"), (2, None, "allow"), (3, "example.net/en/", "allow"), (4, "net/", "block"),
                                                 (5, "org/fr/", "allow"), (6, "example.com/de/", "block"), (7, None, "allow"), (11, None, "allow")]
    assert got[0][1:3] == ("a.net", "/x")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_license_scan(spark, none):
    rows = [(1, "Text.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0.  Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "licensed"), (5, "licensed")]
    got = sorted((r.doc_id, r.n_sentences, r.licenses, r.license or "") for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, "MIT", "MIT"), (2, 2, "Apache-2.0,CC-BY-NC-4.0", "Apache-2.0"), (3, 0, "", ""), (4, 0, "", ""), (5, 1, "", ""), (5, 1, "", "")]
    assert license_scan.scan(none).count() == 0


def test_html_extraction(spark):
    page = "<html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>T &amp; {0}</h1><p><b>one<br>two<p>three {0}</article><footer>end</footer>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(5)] + [(9, None, None), (10, "http://x.org", ""), (11, "http://y.org", "<p>plain <div class=sidebar>s</div> text")]
    rows += [rows[0]]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert [g[1] for g in got] == ["T & 0\none two\nthree 0"] * 2 + [f"T & {i}\none two\nthree {i}" for i in range(1, 5)] + ["", "", "plain\ntext"]
    assert all(g[2] == len(g[1]) for g in got)


def test_quality_classifier(spark, docs, none):
    rows, marks = [], []
    for i in range(200):
        good = i % 2
        text = " ".join(f"word{(i * 31 + k * 17) % 97}" if good else "Spam###" for k in range(40 + i))
        rows.append((i, text))
        marks.append((i, good))
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    got = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    assert quality_classifier.classify(none, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, labels).collect())
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_context_mixing(spark, docs, none):
    text = docs.where("doc_id BETWEEN 10 AND 15")
    many = docs.unionByName(text.crossJoin(spark.range(20)).withColumn("doc_id", F.col("doc_id") * 100 + F.col("id")).drop("id"))
    got = context_mixing.score(many).collect()
    rows = many.collect()
    counts = collections.Counter(w for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for w in [*words(r.text), " "])
    total, types = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in rows:
        w = [*words(r.text), " "]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        want[r.doc_id, len(w), sum(counts[x] > 0 for x in w), total, round(base, 4)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert context_mixing.score(none).count() == 0


def test_decisions_form_a_distribution():
    """Over all words of a book and its escape, the tree's probabilities add up to one."""
    tree = context_mixing.huffman([5.0, 3.0, 2.0, 1.0, 0.5])
    rng = np.random.default_rng(1)
    p = rng.random(10)
    total = 0.0
    for leaf in range(5):
        s = slice(tree.first[leaf], tree.first[leaf + 1])
        total += float(np.prod(np.where(tree.bits[s] == 1, p[tree.nodes[s]], 1 - p[tree.nodes[s]])))
    assert abs(total - 1) < 1e-12
