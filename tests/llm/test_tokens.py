import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import packing, pretokens, token_counts, token_output


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 700])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.repeat(np.arange(n), np.minimum(rng.geometric(0.3, n) ** 6, 20_000)).astype(np.uint32)
    rng.shuffle(ids)
    lengths = token_output.code_lengths(np.bincount(ids) if n else np.zeros(0, np.int64))
    assert lengths.max(initial=0) <= 16 and (n < 2 or sum(2.0 ** -int(x) for x in lengths if x) == 1)
    parts = np.array([len(ids) // 3, 0, len(ids) - len(ids) // 3])
    payload, size, marks, _ = token_output.encode(ids, parts, token_output.canonical(lengths), lengths)
    assert (token_output.decode(payload, parts, size, marks, token_output.decode_table(lengths)) == ids).all()


def test_token_output(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_output.write_blocks(docs, str(tmp_path / "out"), path, 2)
    own, start, known = Tokenizer.from_file(path), 0, texts(docs)
    got = token_output.read_blocks(spark, str(tmp_path / "out")).collect()
    assert len(got) == docs.count()
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*own.encode(known[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += r.n_tokens


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    token_output.write_blocks(none, str(tmp_path / "out"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_output.read_blocks(spark, str(tmp_path / "out")).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_token_counts(docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    own, known = sentencepiece.SentencePieceProcessor(model_file=model), texts(docs)
    for r in token_counts.count_tokens(docs, model).collect():
        assert (r.n_bytes, r.n_tokens) == (len(known[r.doc_id].encode()), len(own.encode(known[r.doc_id])))


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, known, pieces, windows = Tokenizer.from_file(path), texts(docs), {}, {}
    for r in packing.pack(docs, path, 1).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for doc, text in known.items():
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 1], "<u4")
        rows = sorted(pieces[doc], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in rows) == ids.tobytes() and all(r.doc_tokens == len(ids) for r in rows)
        assert [r.start for r in rows] == np.cumsum([0, *[r.length for r in rows[:-1]]]).tolist()
    for rows in windows.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *[r.length for r in rows[:-1]]]).tolist() and sum(r.length for r in rows) <= 2048


@pytest.mark.parametrize("seed", range(6))
def test_packing_costs_least(seed):
    rng = np.random.default_rng(seed)
    points = np.cumsum(rng.integers(1, 9, 40))
    kind, size, costs = rng.integers(0, 3, 40).astype(np.int8), 16, (0.0, 1.0, 4.0)
    cost = lambda a, b, j: (0 if (b - a) & (b - a - 1) == 0 else size - (b - a)) + costs[kind[j]] + 2.0
    best = [0.0]
    at = [0, *points.tolist()]
    for j in range(1, len(at)):
        best.append(min(best[i] + cost(at[i], at[j], j - 1) for i in range(j) if at[j] - at[i] <= size))
    ends = packing.windows(points, kind, size, costs, 2.0)
    index = {p: j for j, p in enumerate(points.tolist())}
    assert abs(sum(cost(a, b, index[b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) - best[-1]) < 1e-9


def test_caches_do_not_add_up():
    a, b = pretokens.Cache(lambda ws: [len(w) for w in ws]), pretokens.Cache(lambda ws: [w.upper() for w in ws], 2)
    assert a.get(["x", "yy"]) == [1, 2] and len(a.young) == 2
    assert b.get(["x", "yy", "z"]) == ["X", "YY", "Z"] and not a.young and b.get(["z", "w"]) == ["Z", "W"]
    assert a.get(["x"]) == [1] and not b.young and not b.old


def test_token_counts_of_odd_texts():
    """Blanks in a row, the library's own sign for a blank, special strings, marks and line feeds in any order."""
    rng, model = random.Random(8), public_tokenizers.path("piece_bpe_32k.model")
    signs = ["a", "b", "the", "ing", " ", "  ", "▁", " ▁ ", "\n", "\t", "\r", "\x00", "\x1f", "　", "​", "ﬁ", "é", "日", "😀", ".", "0", "1 2", "<s>", "</s>", "<unk>", "<0x0A>"]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    codes, offsets, words = pretokens.split(pa.array(odd), "piece")
    sums = np.concatenate([[0], np.cumsum(np.array(token_counts._counter(model).get(words))[codes])])
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=model).encode(odd)]
    assert (sums[offsets[1:]] - sums[offsets[:-1]]).tolist() == want
