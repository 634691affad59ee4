import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import components, decontamination, html_text, jaccard_join, licenses, suffix_dedup, syncmers, toxicity


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(None, 1), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_jaccard_groups(spark, docs):
    random.seed(1)
    base = [r.text for r in docs.where("length(text) > 300").orderBy("doc_id").limit(5).collect()]
    rows = []
    for t in base:
        for _ in range(8):
            w = t.split()
            for _ in range(random.randint(0, max(1, len(w) // 35))):
                w[random.randrange(len(w))] = f"zz{random.randrange(10**6)}"
            rows.append((2 * 10**6 + len(rows), " ".join(w)))
    rows += [(3 * 10**6 + k, " ".join(random.choice("ab") for _ in range(1 + k % 9))) for k in range(40)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in jaccard_join.groups(both).collect()}
    sets = {}
    for r in both.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where, parent = {}, {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for x in s if d is not None else ():
            where.setdefault(x, []).append(d)
    for d, s in sets.items():
        for e, k in Counter(e for x in s for e in where.get(x, ()) if d is not None and e > d).items():
            if 100 * k >= 75 * (len(s) + len(sets[e]) - k):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(s), root(d)) for d, s in sets.items()}
    assert jaccard_join.groups(docs.limit(0)).count() == 0


def test_two_stage():
    random.seed(3)
    for _ in range(30):
        t = np.array([random.randint(1, 3) for _ in range(random.randint(1, 200))] + [0], np.uint16)
        b = bytes(t.astype(np.uint8))
        assert suffix_dedup.two_stage(t, 300).tolist() == sorted(range(len(b)), key=lambda i: b[i:] + b"\0" * 300)


@pytest.mark.parametrize("many", [10_000, 3])
def test_suffix_dedup(spark, docs, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    random.seed(4)
    line = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    common = line(400)
    rows = [(2 * 10**6 + k, line(random.randint(0, 300)) + common[random.randint(0, 80) :] + line(random.randint(0, 300))) for k in range(15)]
    rows += [(3 * 10**6, line(250) * 2), (3 * 10**6 + 1, "same row " * 40), (3 * 10**6 + 1, "same row " * 40)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    known = [(r.doc_id, (r.text or "").encode()) for r in both.collect()]
    starts = Counter(t[s : s + 200] for _, t in known for s in range(len(t) - 199))
    want = []
    for d, t in known:
        m = np.zeros(len(t) + 1, np.int32)
        for s in range(len(t) - 199):
            if starts[t[s : s + 200]] > 1:
                m[s] += 1
                m[s + 200] -= 1
        gone = np.cumsum(m)[:-1] > 0
        want.append((str(d), len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(both).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.clean(docs).columns == docs.columns and suffix_dedup.clean(docs).count() == docs.count()


def test_decontamination(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    host = [r.text for r in docs.where("length(text) > 800").orderBy("doc_id").limit(8).collect()]
    rows = [(2 * 10**6 + k, h[:400] + " " + items[k] + " " + h[400:]) for k, h in enumerate(host)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(both, bench).collect()}
    squeezed = {d: " ".join((t or "").lower().split()) for d, t in both.collect()}
    exact = {(d, i) for d, t in squeezed.items() if d is not None for i, x in items.items() if " ".join(x.lower().split()) in t}
    assert exact <= got and len(got - exact) <= 2
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_directions_are_of_all_passages(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sizes = [0, 1, 16, 17, 40, 200, 32]
    terms, offsets = rng.integers(0, 40, sum(sizes)).astype("<u2"), np.concatenate([[0], np.cumsum(sizes)])
    idf = rng.uniform(0.1, 2, 40)
    rows = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        for k in range(a, b, decontamination.UNIT):
            x = np.bincount(terms[k : min(b, k + 2 * decontamination.UNIT)], minlength=40) * idf
            rows.append(x / np.linalg.norm(x))
    weights, out = rng.normal(size=(40, 5)), np.zeros((40, 5))
    scaled = np.vstack([weights * idf[:, None], np.zeros((1, 5))]).astype(np.float32)
    decontamination._passages_product(terms, offsets, scaled, idf, out)
    assert np.allclose(out, np.array(rows).T @ (np.array(rows) @ weights), atol=1e-4)

    seen = []
    basis = decontamination.basis
    monkeypatch.setattr(decontamination, "basis", lambda texts, *rest: seen.append(texts.count()) or basis(texts, *rest))
    docs = spark.range(4200).selectExpr("id as doc_id", "concat('word', id % 50, if(id % 100 = 0, ' a b c d e f', ' g')) as text")
    bench = spark.createDataFrame([(1, "a b c d e f", None)], "item_id long, text string, answer string")
    assert decontamination.leaks(docs, bench, rank=8).count() == 42 and seen == [4200]


def test_common_subsequence():
    random.seed(6)
    for _ in range(50):
        a, b = [random.randrange(5) for _ in range(12)], [random.randrange(5) for _ in range(15)]
        t = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.common_subsequence(decontamination._masks(np.array(a)), 12, b) == t[-1, -1]


def test_toxicity(spark, docs):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    known = {r.doc_id: r.toxic for r in labels.collect()}
    pos = [r.score for r in rows if r.held_out and known.get(r.doc_id) == 1]
    neg = [r.score for r in rows if r.held_out and known.get(r.doc_id) == 0]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.8
    out = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    machine = toxicity.Machine(np.arange(6), 3)
    x = [[0, 2, 5], [1, 2], []]
    raw, _ = machine.raw(np.array([0, 0, 0, 1, 1]), np.array([0, 2, 5, 1, 2]), 3)
    assert np.allclose(raw, [sum(machine.v[a] @ machine.v[b] for i, a in enumerate(t) for b in t[i + 1 :]) for t in x])


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 2))
    rows, terms = np.nonzero(x)
    machine = toxicity.Machine(np.arange(2), 4).fit(rows, terms, (x.sum(1) == 2).astype(float), epochs=60)
    p = machine.score(np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), 4)
    assert p[2] > 0.5 > max(p[0], p[1], p[3])


def test_syncmers(docs):
    got = {r.doc_id: r for r in syncmers.fingerprint(docs).collect()}
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted((d for d in known if d is not None), reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for d in ids:
        t, k = known[d], len(known[d]) // 3
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - k] + known[after[d]][:k]).encode()).hexdigest())
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
        if t == known[after[d]]:
            assert got[d].fingerprint == got[after[d]].fingerprint
    assert got[10**6].fingerprint == "" and syncmers.fingerprint(docs.limit(0)).count() == 0


def test_syncmers_are_all_kept(spark):
    random.seed(3)
    word = lambda n: [f"w{random.randrange(400)}" for _ in range(n)]
    shared = word(100)
    texts = {1: word(900) + shared + word(1200), 2: word(1500) + shared + word(700), 3: ["same"] * 40 + word(300), 4: ["short", "one"], 5: []}
    got = {r.doc_id: r for r in syncmers.fingerprint(spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")).collect()}

    def hashes(rows, kind):
        rows = sorted(set(rows))
        cols = [f"c{k}" for k in range(len(rows[0]))]
        df = spark.createDataFrame(rows, ", ".join(f"{c} {kind}" for c in cols))
        return {tuple(r)[:-1]: r.h for r in df.selectExpr("*", f"xxhash64({', '.join(cols)}) as h").collect()}

    edited = {}
    for d, t in texts.items():
        t, after = " ".join(t), " ".join(texts[d - 1 or max(texts)])
        k = len(t) // 3
        edited[d, 1], edited[d, 0] = (t[: len(t) - k] + after[:k]).split(), t.split()
    of_word = hashes([(w,) for t in edited.values() for w in t], "string")
    pairs = {x: [(of_word[a,], of_word[b,]) for a, b in zip(t, t[1:], strict=False)] for x, t in edited.items()}
    of_pair = hashes([p for ps in pairs.values() for p in ps], "long")
    inner = {x: [of_pair[p] for p in ps] for x, ps in pairs.items()}
    chosen = {x: [i for i in range(len(g) - 4) if min(g[i : i + 5]) in (g[i], g[i + 4])] for x, g in inner.items()}
    of_anchor = hashes([(inner[x][i], inner[x][i + 2], inner[x][i + 4]) for x, at in chosen.items() for i in at], "long")
    anchors = {x: [of_anchor[inner[x][i], inner[x][i + 2], inner[x][i + 4]] for i in at] for x, at in chosen.items()}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    text = lambda a: "".join(f"{x % 2**64:016x}" for x in a)
    for d in (1, 2, 3):
        own, other = anchors[d, 0], anchors[d, 1]
        assert (got[d].positions, got[d].edited_positions) == (chosen[d, 0], chosen[d, 1])
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (text(own), text(other))
        assert got[d].near_edited == like(own, other) and (d == 1 or got[d].near_next == like(own, anchors[d - 1, 0]))
    assert len(anchors[1, 0]) > 500 and got[2].near_next > 0
    assert (got[4].positions, len(got[4].fingerprint), got[5].positions, got[5].fingerprint) == ([0], 16, [], "")


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>
<main><article><h1>Title &amp; more</h1><p>First,   long paragraph of the article; with marks.<p>Second one, also long enough, and <b>bold</b>&nbsp;text.</p><div class="ad">Buy!</div><ul><li>point one</li></ul></article>
<section id="comments"><p>I like it, a lot, really, truly.</p></section></main><aside>More</aside><form><p>Name</p></form><script>var t="</p>";</script><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Title & more\nFirst, long paragraph of the article; with marks.\nSecond one, also long enough, and bold text.\npoint one"
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<p>a b"), (4, "w", "<<>&#0;<p")], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(rows).collect()][:3] == ["", "", "a b"]


def test_licenses(spark):
    mit = next(t for k, t in licenses.KNOWN if k == "MIT" and len(t) > 500)
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ,")), (2, "x y\nReleased under the MIT licence\nmore"), (3, None), (4, "a permission note")]
    got = {r.doc_id: (r.text_license, r.line_licenses, r.n_license_lines) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "", 0), 2: (None, "MIT", 1), 3: (None, "", 0), 4: (None, "", 0)}


def test_license_files(spark):
    texts = dict(licenses.KNOWN[12:14])
    apache, bsd = (next(t for k, t in licenses.KNOWN if k == x and len(t) > 500) for x in ("Apache-2.0", "BSD-3-Clause"))
    rows = [("MIT License\n\nCopyright (c) 2020 Some One\n\n" + texts["MIT"], "MIT", ""), ("ISC License\nCopyright 2021, X Inc.\n" + texts["ISC"], "ISC", ""), (apache, "Apache-2.0", "Apache-2.0"), (bsd.split("\n", 1)[0] + "\n" + bsd.split("\n", 1)[1].replace(" ", "\n"), "BSD-3-Clause", ""), ("text\nCopyright 2020 X. Licensed under the MIT License.\n", None, "MIT")]
    rows = [(k, *r) for k, r in enumerate(rows)]
    got = licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text_license, r.line_licenses) for r in got} == {r[0]: r[2:] for r in rows}


def test_clean_keeps_odd_columns(spark):
    text = "a passage that two texts share, word for word, " * 8
    rows = [(1, "one " + text, 9, 5, 6, 7, "x"), (None, "two " + text, None, 5, 6, 7, "y"), (2, None, 3, 5, 6, 7, "z"), (2, "", 0, 5, 6, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans int, _id int, _mark int, row string")
    got = {r.row + str(r.doc_id) + str(r.text is None): r for r in suffix_dedup.clean(docs).collect()}
    assert suffix_dedup.clean(docs).columns == docs.columns and len(got) == 4
    assert all((r.spans, r._id, r._mark) == (5, 6, 7) for r in got.values())
    assert len(got["x1False"].text) < 10 and got["x1False"].n_chars == len(got["x1False"].text) and got["z2True"].text is None


def test_leaks_without_ids_go(spark):
    item = " ".join(f"question{k} word{k * 7 % 13}" for k in range(20)) + ". The answer is forty two."
    rows = [(None, "before " + item + " after", "a"), (None, "clean text of no one", "b"), (3, item, "c"), (3, "another clean one", "d"), (4, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontamination.without_leaks(docs, bench, rank=8)
    assert left.columns == docs.columns and {r.row for r in left.collect()} == {"b", "d", "e"}
    with pytest.raises(ValueError):
        decontamination.leaks(docs, bench, most_bytes=10)


def test_scores_by_hand(spark, docs):
    """Scores of whole texts from the machine's weights, term by term and pair by pair."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    machine = toxicity.learn(docs, labels)
    number = {int(b): i for i, b in enumerate(machine.buckets)}
    known = docs.select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), round(r.score, 9), r.predicted) for r in toxicity.score(docs, machine).collect())
    want = []
    for d, text in known:
        found = set()
        for w in re.findall(r"\w+", (text or "").lower()):
            found.add(zlib.crc32(w.encode()) % toxicity.BUCKETS)
            found |= {zlib.crc32(b"^" + w[:k].encode()) % toxicity.BUCKETS for k in (4, 5, 6) if len(w) >= k}
        t = sorted(number[f] for f in found if f in number)
        raw = machine.w0 + sum(machine.w[t]) + sum(machine.v[a] @ machine.v[b] for i, a in enumerate(t) for b in t[i + 1 :])
        score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        want.append((str(d), score))
    assert len(got) == len(want) and all(g[0] == w[0] and abs(g[1] - w[1]) < 1e-6 and g[2] == int(w[1] >= 0.5) for g, w in zip(got, sorted((d, round(x, 9)) for d, x in want), strict=True))
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x < 0.5 for _, x in want)


def test_long_texts(spark):
    """Texts beyond the slices' and pieces' size: 5 MB with a repeated passage on the border of pieces."""
    rng = random.Random(7)
    word = lambda n: " ".join("%x" % rng.getrandbits(24) for _ in range(n))
    passage = word(60)
    text = word(300_000)
    text = text[: suffix_dedup.PIECE - 100] + passage + text[suffix_dedup.PIECE - 100 :] + " " + word(400_000)
    docs = spark.createDataFrame([(1, text), (2, "other " + passage + " end"), (3, text[:-3] + "xyz")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs.where("doc_id < 3")).collect()}
    assert got[1].n_removed == got[2].n_removed >= len(passage) and got[1].n_spans == got[2].n_spans == 1 and got[1].n_bytes == len(text)
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(docs).collect()}
    words = text.split()
    assert groups[1] == (len({tuple(words[k : k + 5]) for k in range(len(words) - 4)}), 1) and groups[3][1] == 1 and groups[2][1] == 2


def test_groups_of_ids_that_repeat(spark):
    """Rows of one id are one node, with the links of each of its texts."""
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(5, word(1)), (5, word(2)), (6, word(1) + " more"), (7, word(2) + " more"), (8, word(3)), (8, word(3)), (None, word(1)), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.groups(docs).collect())
    assert got == [(0, 0), (5, 5), (5, 5), (6, 5), (7, 5), (8, 8), (8, 8), (9, 9), (9, 9)]
