"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w[f] + sum over pairs f < g of <v[f], v[g]>), for the terms f, g that a text holds: the
pairwise part learns terms that only weigh together, such as an insult with the mention of a group. Terms are the
lower-cased words and their first 4, 5 and 6 letters, hashed to 2**20 buckets; a text has a term or not, however
long it is. Learning takes at most ``max_rows`` labelled rows (a documented bound; the first by a hash of their id)
and the ``max_terms`` buckets of the highest chi-square statistic among those rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, map_slices
from .pretokens import Cache, ragged, split

BUCKETS = 1 << 20
_WORD = re.compile(r"\w+")


def _terms(chunks: list[str]) -> list[bytes]:
    out = []
    for chunk in chunks:
        found = []
        for w in _WORD.findall(chunk.lower()):
            found.append(zlib.crc32(w.encode()))
            found += [zlib.crc32(b"^" + w[:k].encode()) for k in (4, 5, 6) if len(w) >= k]
        out.append((np.array(found, np.uint32) & np.uint32(BUCKETS - 1)).astype("<u4").tobytes())
    return out


_cache = Cache(_terms)


def text_terms(texts: pa.Array, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every term of every text, once each, ascending; ``number``: of each bucket, -1 to leave it out."""
    codes, offsets, words = split(texts, "word")
    coded = _cache.get(words)
    length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    pool = np.frombuffer(b"".join(coded), "<u4")
    word = np.repeat(np.arange(len(words)), length)
    if number is not None:
        pool = number[pool]
        word, pool = word[pool >= 0], pool[pool >= 0]
        length = np.bincount(word, minlength=len(words)).astype(np.int64)
    first = np.cumsum(length) - length
    per = length[codes]
    term = pool[ragged(first[codes], per)].astype(np.int64)
    text = np.repeat(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), per)
    key = np.unique(text * BUCKETS + term)
    return key // BUCKETS, key % BUCKETS


class Machine:
    """Weights over the kept buckets; small: ``max_terms`` x (1 + factors) floats."""

    def __init__(self, buckets: np.ndarray, factors: int = 8, seed: int = 7):
        self.buckets = buckets
        self.w0, self.w = 0.0, np.zeros(len(buckets))
        self.v = np.random.default_rng(seed).normal(0, 0.02, (len(buckets), factors))

    def number(self) -> np.ndarray:
        out = np.full(BUCKETS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def raw(self, rows: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.stack([np.bincount(rows, self.v[terms, k], n) for k in range(self.v.shape[1])], 1)
        square = np.bincount(rows, (self.v[terms] ** 2).sum(1), n)
        return self.w0 + np.bincount(rows, self.w[terms], n) + 0.5 * ((total**2).sum(1) - square), total

    def score(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, terms, n)[0], -30, 30)))

    def fit(self, rows: np.ndarray, terms: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> "Machine":
        """AdaGrad on the logistic loss; rows ascending."""
        n = len(y)
        self.w0 = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        if not len(self.buckets) or not 0 < y.sum() < n:
            return self
        start = np.searchsorted(rows, np.arange(n + 1))
        g0, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        rng, m = np.random.default_rng(seed), len(self.buckets)
        for _ in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, batch):
                pick = order[a : a + batch]
                size = start[pick + 1] - start[pick]
                t, r = terms[ragged(start[pick], size)], np.repeat(np.arange(len(pick)), size)
                raw, total = self.raw(r, t, len(pick))
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)
                dw = np.bincount(t, err[r], m)
                dv = np.stack([np.bincount(t, err[r] * (total[r, k] - self.v[t, k]), m) for k in range(self.v.shape[1])], 1)
                seen = np.unique(t)
                dw[seen] += decay * self.w[seen]
                dv[seen] += decay * self.v[seen]
                g0 += err.sum() ** 2
                gw += dw**2
                gv += dv**2
                self.w0 -= rate * err.sum() / g0**0.5
                self.w -= rate * dw / gw**0.5
                self.v -= rate * dv / gv**0.5
        return self


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 12_000, max_terms: int = 4096, min_rows: int = 5) -> Machine:
    """Fit on the labelled rows that are not held out. Null labels and ids are left out; of several labels of an id the highest holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, terms = text_terms(batch.column("text"))
            stops = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            data = terms.astype("<u4").tobytes()
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([data[4 * a : 4 * b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "y", "terms"])

        return run

    rows = cut(map_slices(docs.join(F.broadcast(known), "doc_id"), make, "doc_id long, y int, terms binary"), "toxic-terms")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                t = np.frombuffer(t, "<u4")
                n[t] += 1
                pos[t] += y > 0
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(pos[used])], ["term", "n", "pos"])

    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0))).first()
    share = positive / total if total else 0.0
    lift = F.pow(F.col("pos") - F.lit(share) * F.col("n"), 2) / (F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
    best = rows.select("y", "terms").mapInArrow(counts, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= min_rows).orderBy(lift.desc(), "term").limit(max_terms).select("term").collect()
    machine = Machine(np.array(sorted(r.term for r in best), np.int64))
    number = machine.number()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [number[np.frombuffer(t, "<u4")] for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([k[k >= 0].astype("<u4").tobytes() for k in kept], pa.binary())], ["doc_id", "y", "terms"])

    fit = rows.mapInArrow(keep, "doc_id long, y int, terms binary").orderBy("doc_id", "terms").collect()
    sizes = [len(r.terms) // 4 for r in fit]
    return machine.fit(np.repeat(np.arange(len(fit)), sizes), np.frombuffer(b"".join(bytes(r.terms) for r in fit), "<u4").astype(np.int64), np.array([float(r.y > 0) for r in fit]))


def held_out(doc_id):
    """crc32 of the id as text leaves no remainder by 5; a row without an id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted of every row. A null or empty text has no terms: its score is sigmoid(w0).

    Narrow: the weights travel with the task, no row is shuffled.
    """

    def make():
        number = machine.number()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, terms = text_terms(batch.column("text"), number)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(machine.score(rows, terms, batch.num_rows))], ["doc_id", "score"])

        return run

    return map_slices(id_and_text(docs), make, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    machine = learn(id_and_text(docs), labels, **options)
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted toxic; rows stay where they are."""
    machine = learn(id_and_text(docs), labels, **options)
    number = machine.number()

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import slices

        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column("text"), "")
                rows, terms = text_terms(texts, number)
                yield part.filter(pa.array(machine.score(rows, terms, part.num_rows) < 0.5))

    return docs.mapInArrow(verdict, docs.schema)
