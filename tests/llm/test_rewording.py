"""Reworded benchmark items against a plain program over all pairs of passages and items, without a latent space."""

import math
import random
import re
from collections import Counter

from factloom.llm import decontamination


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _words(text):
    return re.findall(r"\w+", (text or "").lower())


def plain(texts, items, share=0.5, answer_share=0.4, sure=0.8):
    """{(doc_id, item_id): share of the common subsequence} by the checks alone."""
    words = {d: _words(t) for d, t in texts.items()}
    known = set().union(*map(_words, items.values()))
    held = Counter(w for ws in words.values() for w in set(ws) & known)
    idf = {w: math.log((len(words) + 1) / (held[w] + 1)) + 0.1 for w in known}
    out = {}
    for i, text in items.items():
        item, answer = _words(text), _words([s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if _words(s)][-1])
        bag, weight, own = Counter(item), sum(idf[w] for w in item), set(item)
        for d, ws in words.items():
            for first in range(0, len(ws), 16):
                window = ws[max(0, first - len(item)) : first + 32 + len(item)]
                if sum(w in own for w in window) < share * len(item):
                    continue
                got = _common(item, window) / len(item)
                covered = sum(min(n, bag[w]) * idf[w] for w, n in Counter(w for w in window if w in own).items())
                if got >= share and covered >= share * weight and (_common(answer, window) / len(answer) >= answer_share or got >= sure):
                    out[d, i] = max(got, out.get((d, i), 0))
    return out


def test_reworded_items(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    clean = [r.text for r in docs.where("length(text) > 800").orderBy("doc_id").limit(40).collect()]
    pool, rnd = _words(" ".join(clean)), random.Random(3)
    texts, planted = dict(enumerate(clean)), {}
    for rate in (0.1, 0.2, 0.3):
        for i, text in items.items():
            words = [rnd.choice(pool) if rnd.random() < rate else w for w in text.split()]
            host, d = rnd.choice(clean), 1000 + len(planted)
            texts[d] = " ".join([host[:300], *words, host[300:600]])
            planted[d] = (rate, i)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.lcs_share for r in decontamination.leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).collect()}
    for rate in (0.1, 0.2, 0.3):
        mine = [(d, i) for d, (r, i) in planted.items() if r == rate]
        assert sum(x in got for x in mine) >= 0.9 * len(mine)
    want = plain(texts, items)
    assert got.keys() <= want.keys() and len(got) >= 0.97 * len(want)
    assert all(share <= want[pair] + 1e-9 for pair, share in got.items())
