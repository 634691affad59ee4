"""Benchmark passages in documents, also reworded ones, by latent semantic retrieval and exact checks.

Terms are words: those of the benchmark have a coordinate each, all others share 4,096 hashed ones. Document frequencies
are counted over all documents. A passage is ``2 * UNIT`` words, one begins every ``UNIT`` words. A randomised SVD of
TF-IDF passages (all passages of all documents, and the benchmark items, which weigh as much as all of these) gives
``rank`` directions: tasks multiply their rows, partial products are summed on the executors by blocks of terms. Every passage of every document is projected; an item is a candidate where the cosine is at
least ``cosine``. Candidates are checked on whole words around the passage: longest common subsequence with the item,
coverage of the item's words by IDF weight, and the same subsequence check for its answer (a column ``answer``, or the item's
last sentence).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, join_small, map_slices, slices
from .pretokens import Cache, ragged, split

UNIT, HASHED, BLOCK = 16, 4096, 256
#: Bytes of coded words worked on at once; passages and items of one block of the search.
CODED_BYTES, PASSAGES, ITEMS = 2 << 20, 4096, 1024
#: Occurrences of a term that are summed together.
GROUP = 32
_WORD = re.compile(r"\w+")
_caches: dict[int, Cache] = {}


class Items:
    """The benchmark: words of each item and of its answer; its size is that of the benchmark table, never of the corpus."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        self.ids, self.words, self.answers = [], [], []
        for item, text, answer in rows:
            words = _WORD.findall((text or "").lower())
            if not words:
                continue
            last = [s for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if _WORD.search(s)]
            self.ids.append(item)
            self.words.append(words)
            self.answers.append(_WORD.findall((answer or last[-1]).lower()) or words)
        self.number = {w: i for i, w in enumerate(sorted({w for ws in (*self.words, *self.answers) for w in ws}))}
        self.terms = len(self.number) + HASHED
        self.kind = "<u2" if self.terms < 1 << 16 else "<u4"
        self.key = zlib.crc32(repr((self.ids, self.words)).encode())

    def term(self, word: str) -> int:
        i = self.number.get(word)
        return len(self.number) + zlib.crc32(word.encode()) % HASHED if i is None else i

    def coded(self, words: list[str]) -> np.ndarray:
        return np.array([self.term(w) for w in words], np.int64)

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Terms of each text in order, and offsets."""
        if self.key not in _caches:
            _caches.clear()
            _caches[self.key] = Cache(lambda chunks: [self.coded(_WORD.findall(c.lower())).astype("<u4").tobytes() for c in chunks])
        codes, offsets, words = split(texts, "word")
        coded = _caches[self.key].get(words)
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        pool = np.frombuffer(b"".join(coded), "<u4")
        per = length[codes]
        sums = np.concatenate([[0], np.cumsum(per)])
        return pool[ragged((np.cumsum(length) - length)[codes], per)].astype(np.int64), sums[offsets]


def coded(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id and the terms of each text in order, as bytes: a text is split once, whatever reads its words later."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            terms, offsets = items.of_texts(batch.column("text"))
            data, width = terms.astype(items.kind).tobytes(), int(items.kind[-1])
            rows = [data[width * a : width * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "terms"])

        return run

    return map_slices(docs, make, "doc_id long, terms binary")


def words_of(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of coded texts, one after the other, and offsets."""
    rows = column.to_pylist()
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // int(kind[-1])
    return np.frombuffer(b"".join(rows), kind), np.concatenate([[0], np.cumsum(sizes)])


def frequencies(texts: DataFrame, items: Items, docs_at_once: int = 256) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents. The driver gets a row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(items.terms + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, "terms", CODED_BYTES):
                terms, offsets = words_of(part.column("terms"), items.kind)
                for a in range(0, part.num_rows, docs_at_once):
                    stops = offsets[a : a + docs_at_once + 1]
                    held = np.zeros((len(stops) - 1, items.terms), bool)
                    held[np.repeat(np.arange(len(stops) - 1), np.diff(stops)), terms[stops[0] : stops[-1]]] = True
                    total[: items.terms] += held.sum(0)
                rows += part.num_rows
        total[-1] = rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "n"])

    out = np.zeros(items.terms + 1, np.int64)
    for term, n in texts.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out[:-1], int(out[-1])


def _units(terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each unit and its text; a unit never crosses texts."""
    size = np.diff(offsets)
    n = -(-size // UNIT)
    doc = np.repeat(np.arange(len(size)), n)
    return offsets[:-1][doc] + UNIT * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)), doc


def _latent(terms: np.ndarray, offsets: np.ndarray, first: np.ndarray, doc: np.ndarray, a: int, b: int, weights: np.ndarray, step: int = 512) -> np.ndarray:
    """Rows of ``weights`` (its last one 0) summed over the passages a to b; a passage is a unit and the next one of its text."""
    last = min(b + 1, len(first))
    begin, own = first[a:last], doc[a:last]
    at = begin[:, None] + np.arange(UNIT)
    word = np.where(at < offsets[own + 1][:, None], terms[np.minimum(at, len(terms) - 1)], len(weights) - 1).astype(np.int64)
    out = np.empty((last - a, weights.shape[1]), np.float32)
    held = np.empty((step, weights.shape[1]), np.float32)
    for k in range(0, last - a, step):
        part, rows = word[k : k + step], out[k : k + step]
        np.take(weights, part[:, 0], 0, rows, "clip")
        for j in range(1, UNIT):
            rows += np.take(weights, part[:, j], 0, held[: len(rows)], "clip")
    joined = np.flatnonzero(own[1:] == own[:-1])
    joined = joined[joined < b - a]
    out[joined] += out[joined + 1]
    return out[: b - a]


def _product(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, idf: np.ndarray, out: np.ndarray, scale: float = 1.0) -> None:
    """Add A' A weights to ``out`` for TF-IDF rows of unit length, given as (terms, offsets of the rows)."""
    for terms, starts in rows:
        if not len(terms):
            continue
        size = np.diff(np.append(starts, len(terms)))
        row = np.repeat(np.arange(len(starts)), size)
        key, count = np.unique(row * len(idf) + terms, return_counts=True)
        row, term = key // len(idf), key % len(idf)
        value = count * idf[term]
        norm = np.sqrt(np.bincount(row, value**2))
        value = value / np.maximum(norm[row], 1e-12)
        cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        z = np.add.reduceat(weights[term] * value[:, None], cuts, axis=0)
        order = np.argsort(term, kind="stable")
        term = term[order]
        cuts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        out[term[cuts]] += scale * np.add.reduceat(z[row[order]] * value[order, None], cuts, axis=0)


def _row_sums(table: np.ndarray, weights: np.ndarray, step: int = 512) -> np.ndarray:
    """Rows of ``weights`` summed over each row of indices in ``table``."""
    out = np.empty((len(table), weights.shape[1]), np.float32)
    held = np.empty((step, weights.shape[1]), np.float32)
    for k in range(0, len(table), step):
        part, rows = table[k : k + step], out[k : k + step]
        np.take(weights, part[:, 0], 0, rows, "clip")
        for j in range(1, table.shape[1]):
            rows += np.take(weights, part[:, j], 0, held[: len(rows)], "clip")
    return out


def _passages_product(terms: np.ndarray, offsets: np.ndarray, weights: np.ndarray, idf: np.ndarray, out: np.ndarray) -> None:
    """Add A' A weights to ``out`` for the TF-IDF rows of unit length of all passages; ``weights`` are those times IDF, and a last row of 0.

    Words are summed by units, and a passage is a unit and the next one of its text; back from passages to terms likewise.
    """
    none = len(idf)
    first, doc = _units(terms, offsets)
    if not len(first):
        return
    at = first[:, None] + np.arange(UNIT)
    held = at < offsets[doc + 1][:, None]
    word = np.where(held, terms[np.minimum(at, len(terms) - 1)], none).astype(terms.dtype)
    joined = np.flatnonzero(doc[1:] == doc[:-1])
    # a term that a passage holds c times adds (c IDF)^2 to the square of its length: 1, 3, 5, ... for each time
    both = np.full((len(first), 2 * UNIT), none, terms.dtype)
    both[:, :UNIT] = word
    both[joined, UNIT:] = word[joined + 1]
    both.sort(axis=1)
    both = np.ascontiguousarray(both.T)
    square = np.append(idf, 0.0) ** 2
    norm, times = square[both[0]], np.zeros(len(first), np.int64)
    for j in range(1, 2 * UNIT):
        times = (times + 1) * (both[j] == both[j - 1])
        norm += square[both[j]] * (2 * times + 1)
    sums = _row_sums(word.astype(np.int64), weights)
    rows = sums.copy()
    rows[joined] += sums[joined + 1]
    rows /= np.maximum(norm, 1e-12)[:, None].astype(np.float32)
    back = np.vstack([rows, np.zeros((1, rows.shape[1]), np.float32)])
    back[joined + 1] += rows[joined]
    # occurrences by term, each term's filled up to whole groups with the row of 0
    unit, term = np.nonzero(held)[0], word[held]
    order = np.argsort(term, kind="stable")
    count = np.bincount(term, minlength=none)
    groups = -(-count // GROUP)
    slots = np.full(GROUP * groups.sum(), len(rows), np.int64)
    slots[ragged(GROUP * (np.cumsum(groups) - groups), count)] = unit[order]
    found = np.flatnonzero(count)
    sums = np.add.reduceat(_row_sums(slots.reshape(-1, GROUP), back), (np.cumsum(groups) - groups)[found], axis=0)
    out[found] += idf[found, None] * sums


def basis(texts: DataFrame, items: Items, idf: np.ndarray, passages: int, rank: int, seed: int = 11) -> np.ndarray:
    """Terms x rank: leading right singular vectors, by a randomised range finder with one power step over all texts."""
    wide = min(rank + 8, items.terms)
    own = [(items.coded(w), np.array([0])) for w in items.words]
    scale = max(1.0, passages / max(1, len(own)))

    def multiplied(weights: np.ndarray) -> np.ndarray:
        scaled = np.vstack([weights * idf[:, None], np.zeros((1, weights.shape[1]))]).astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((items.terms, scaled.shape[1]))
            for batch in batches:
                for part in slices(batch, "terms", CODED_BYTES // 2):
                    _passages_product(*words_of(part.column("terms"), items.kind), scaled, idf, out)
            starts = range(0, items.terms, BLOCK)
            out = out.astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array([out[a : a + BLOCK].tobytes() for a in starts], pa.binary())], ["block", "part"])

        def total(key, df: pd.DataFrame) -> pd.DataFrame:
            s = None
            for x in df["part"]:
                x = np.frombuffer(x, np.float32).astype(float)
                s = x if s is None else s + x
            return pd.DataFrame({"block": [key[0]], "part": [s.tobytes()]})

        out = np.zeros((items.terms, weights.shape[1]))
        for block, part in texts.mapInArrow(run, "block long, part binary").groupBy("block").applyInPandas(total, "block long, part binary").collect():
            out[block : block + BLOCK] = np.frombuffer(bytes(part)).reshape(-1, weights.shape[1])
        _product(own, weights, idf, out, scale)
        return out

    q, _ = np.linalg.qr(multiplied(np.random.default_rng(seed).normal(size=(items.terms, wide))))
    y = multiplied(q)
    value, vector = np.linalg.eigh(q.T @ y)
    return q @ vector[:, np.argsort(-value)[:rank]]


def common_subsequence(mask: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence: the item as bits, one addition for each word."""
    full = (1 << length) - 1
    v = full
    for w in words:
        if m := mask.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 128, cosine: float = 0.45, share: float = 0.5, answer_share: float = 0.4, sure: float = 0.8, most_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of the best passage, for each pair that passes the checks.

    A pair passes if its common subsequence and its weighted coverage reach ``share`` of the item, and the answer's
    ``answer_share`` or else the item's ``sure``. Null or empty texts and items give no pairs; rows that share a ``doc_id`` count as one; rows
    without a ``doc_id`` give none (``without_leaks`` judges them, too). The driver and the tasks hold the benchmark's words: its text may have
    ``most_bytes`` at most, which is checked before it is read.
    """
    docs = id_and_text(docs).where("doc_id is not null")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"the benchmark's texts have {size} bytes; run it in parts of {most_bytes}")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = Items([tuple(r) for r in benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer")).distinct().orderBy("item_id", "text").collect()])
    if not items.ids:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")
    texts = cut(coded(docs, items), "coded")
    df, total = frequencies(texts, items)
    idf = np.log((total + 1) / (df + 1)) + 0.1
    passages = texts.agg(F.coalesce(F.sum(F.ceil(F.octet_length("terms") / (UNIT * int(items.kind[-1])))), F.lit(0))).first()[0]
    vectors = (basis(texts, items, idf, int(passages), rank) * idf[:, None]).astype(np.float32)
    own = [items.coded(w) for w in items.words]
    known = np.stack([vectors[c].sum(0) for c in own])
    known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)
    known = known.astype(np.float32)
    vectors = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    vocabulary = len(items.number)

    def make():
        masks, goals = [_masks(c) for c in own], [items.coded(a) for a in items.answers]
        goal_masks = [_masks(g) for g in goals]
        bags = [dict(zip(*(x.tolist() for x in np.unique(c, return_counts=True)), strict=True)) for c in own]
        weight = [sum(idf[t] * n for t, n in b.items()) for b in bags]
        gain = np.zeros(items.terms)

        def possible(terms: np.ndarray, lo: np.ndarray, hi: np.ndarray, i: int) -> np.ndarray:
            """Windows in which enough words, and enough of their weight, are words of the item: no window beyond can pass."""
            gain[own[i]] = idf[own[i]]
            found = gain[terms[ragged(lo, hi - lo)]]
            gain[own[i]] = 0
            starts = np.cumsum(hi - lo) - (hi - lo)
            enough = np.add.reduceat(found > 0, starts, dtype=np.int64) >= share * len(own[i]) - 1e-6
            return np.flatnonzero(enough & (np.add.reduceat(found, starts) >= share * weight[i] * (1 - 1e-9)))

        def checked(words: list[int], i: int) -> tuple[float, float] | None:
            """Shares of the item and of its answer that the words hold in order, if they pass."""
            got = common_subsequence(masks[i], len(own[i]), words) / len(own[i])
            if got < share:
                return None
            left, covered = dict(bags[i]), 0.0
            for w in words:
                if left.get(w, 0):
                    left[w] -= 1
                    covered += idf[w]
            ans = common_subsequence(goal_masks[i], len(goals[i]), words) / len(goals[i])
            return (got, ans) if covered >= share * weight[i] and (ans >= answer_share or got >= sure) else None

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            terms, offsets = words_of(batch.column("terms"), items.kind)
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            first, doc = _units(terms, offsets)
            for a in range(0, len(first), PASSAGES):
                b = min(a + PASSAGES, len(first))
                latent = _latent(terms, offsets, first, doc, a, b, vectors)
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
                for c in range(0, len(own), ITEMS):
                    near = latent @ known[c : c + ITEMS].T
                    item, passage = np.nonzero((near >= cosine).T)
                    stops = np.flatnonzero(np.append(item[1:] != item[:-1], True)) + 1 if len(item) else []
                    for x, y in zip([0, *stops[:-1]], stops, strict=False):
                        i, p = c + int(item[x]), passage[x:y]
                        d = doc[a + p]
                        lo = np.maximum(offsets[d], first[a + p] - len(own[i]))
                        hi = np.minimum(offsets[d + 1], first[a + p] + 2 * UNIT + len(own[i]))
                        for k in possible(terms, lo, hi, i).tolist():
                            words = terms[lo[k] : hi[k]]
                            if passed := checked(words[words < vocabulary].tolist(), i):
                                key, value = (int(d[k]), i), (passed[0], float(near[p[k], i - c]), passed[1])
                                best[key] = max(best.get(key, value), value)
            rows = [(ids[d], items.ids[i], v[1], v[0], v[2]) for (d, i), v in best.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(cols)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        return run

    found = map_slices(texts, make, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double", "terms", CODED_BYTES)
    best = F.max(F.struct("lcs_share", "cosine", "answer_share")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item was found.

    Texts are known by a digest here, so rows without a ``doc_id``, or that share one, are judged by their own text. Null and empty texts stay,
    equal texts go or stay together; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.xxhash64(text, F.length(text))
    found = cut(leaks(docs.select(digest.alias("doc_id"), text.alias("text")), benchmark, **options).select("doc_id").distinct(), "leaks")
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest.alias("doc_id"))
    return join_small(marked, found, "doc_id", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
