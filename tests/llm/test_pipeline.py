"""The stages of the pipeline, each on what the one before kept, against brute force on a small table."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, with near copies, a shared passage, a benchmark item inside a text, odd texts and a column that clashes."""
    out = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    word = lambda n: " ".join("".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    base, passage, items = word(120), word(70), [word(45) + ".", word(50) + "."]  # an item that two texts held would go as a repeat
    near = base.split()
    near[60] = "changed"
    texts = [base, " ".join(near), base, word(40) + " " + passage + " " + word(30), word(50) + " " + passage + " " + word(20), word(60) + " " + items[0] + " " + word(60), "", None]
    rows = [(10**6 + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, word(30), "en", "s", 1), (None, word(9) + " " + items[1], "en", "s", 1)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("score", F.lit(3))
    both.coalesce(2).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    bench.unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(items)], bench.schema)).write.parquet(f"{out}/benchmark.parquet")
    return out, items


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows after each stage, read once."""
    rows, out = spark.read.parquet(f"{folder[0]}/documents.parquet"), {}
    out["start"] = [r.asDict() for r in rows.collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.cut(stage(spark, rows, folder[0]), f"stage-{name}")
        out[name] = [r.asDict() for r in rows.collect()]
    return out


def _key(r):
    return (str(r["doc_id"]), r["text"] or "")


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "decontamination", "packing"]
    for name in ("toxicity", "near_copies", "repeats", "decontamination"):
        assert list(stages[name][0]) == list(stages["start"][0])


def test_toxic_rows_go(stages):
    before, after = {_key(r) for r in stages["start"]}, {_key(r) for r in stages["toxicity"]}
    assert after <= before and len(after) > 0.8 * len(before)


def test_one_of_each_group_stays(stages):
    sets = {}
    for r in stages["toxicity"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        if r["doc_id"] is not None:
            sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 3 * max(len(x), len(y)) <= 4 * min(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    want = sorted(str(d) for d in ids if root(d) == d) + ["None"] * sum(r["doc_id"] is None for r in stages["toxicity"])
    assert sorted(str(r["doc_id"]) for r in stages["near_copies"]) == sorted(want)


def test_repeated_passages_go(stages):
    known = [(r["doc_id"], (r["text"] or "").encode()) for r in stages["near_copies"]]
    count = {}
    for _, t in known:
        for s in range(len(t) - 199):
            count[t[s : s + 200]] = count.get(t[s : s + 200], 0) + 1
    want = []
    for d, t in known:
        keep = np.ones(len(t), bool)
        for s in range(len(t) - 199):
            if count[t[s : s + 200]] > 1:
                keep[s : s + 200] = False
        want.append((str(d), bytes(np.frombuffer(t, np.uint8)[keep]).decode("utf-8", "ignore")))
    assert sorted(_key(r) for r in stages["repeats"]) == sorted(want)


def test_leaks_go(stages, folder):
    squeezed = lambda t: " ".join((t or "").lower().split())
    held = lambda name: [any(squeezed(x) in squeezed(r["text"]) for r in stages[name]) for x in folder[1]]
    assert held("repeats") == [True, True] and held("decontamination") == [False, False]
    assert {_key(r) for r in stages["decontamination"]} <= {_key(r) for r in stages["repeats"]} and len(stages["decontamination"]) > 0.8 * len(stages["repeats"])


def test_all_that_is_left_is_packed(stages):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in stages["decontamination"] if r["doc_id"] is not None)
    pieces, windows = {}, {}
    for r in stages["packing"]:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] * 4 == len(r["ids"])
        windows.setdefault(r["sequence_id"], []).append(r)
        if r["doc_id"] is not None:
            pieces.setdefault(r["doc_id"], []).append(r)
    assert sorted(b"".join(bytes(r["ids"]) for r in sorted(p, key=lambda r: r["start"])) for p in pieces.values()) == want
    assert all(sum(r["length"] for r in w) <= 2048 for w in windows.values())
