import random
import re
from collections import Counter, defaultdict
from itertools import groupby

from factloom.llm import divergence


def plain(rows, least, top):
    groups, langs, holders = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang, source].update(terms)
        langs[lang].update(terms)
        holders[lang].update(set(terms))
    kept = {lang: [t for t, n in found.items() if n >= least] for lang, found in holders.items()}

    def shares(counts, terms):
        total = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(terms)) for t in terms}

    p = {g: shares(c, kept[g[0]]) for g, c in groups.items()}
    q = {lang: shares(c, kept[lang]) for lang, c in langs.items()}
    out = []
    for (lang, source), own in p.items():
        out += [(lang, source, "pair", other, sum(abs(own[t] - p[lang, other][t]) for t in own)) for a, other in p if a == lang and other != source]
        out += [(lang, source, "term", t, own[t] - q[lang][t]) for t in own if groups[lang, source][t] and own[t] > q[lang][t]]
    out.sort(key=lambda r: (r[0], r[1], r[2], -r[4], r[3].encode()))
    ranked = [(*r, k) for _, g in groupby(out, key=lambda r: r[:3]) for k, r in enumerate(g, 1)]
    return sorted(r for r in ranked if r[2] == "pair" or r[5] <= top)


def test_audit_equals_plain(spark):
    random.seed(11)
    words = ["Word", "word", "é", "É", "日本", "a1b", "x_y", "don't", "😀z", " nb", "Zed", "kK", "tie", "tiE", "rare"]
    rows = [(random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "S3", "é", None]), " ".join(random.choice(words[: random.randint(2, 15)]) for _ in range(random.randint(0, 30)))) for _ in range(300)]
    rows += [("xx", "alone", "one two"), ("none", "a", "12 34"), ("none", "b", None), ("none", "c", ""), ("en", "no terms", "1 2 3"), (None, None, None)] + [("en", "s1", "Word tie")] * 40
    rows += [("en", "long", "word " * 50_000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as term", "2 as n", "3 as p", "4 as value", "cast(null as long) as doc_id")
    for least, top in ((30, 50), (1, 3), (10_000, 50)):
        got = sorted(tuple(r) for r in divergence.audit(docs, least, top).collect())
        assert got == plain(rows, least, top)
    assert divergence.audit(docs.limit(0)).count() == 0
