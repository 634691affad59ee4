"""Order-preserving packing into windows of ``size`` tokens by dynamic programming.

The texts of a slice, one after the other, form a stream of tokens. A window is a run of the stream of at most
``size`` tokens. It is padded to ``size``, unless its length is a power of two. Windows may end at the end of a
text (free), at the end of a sentence (``sentence_cost`` tokens), or, every ``grid`` tokens within sentences
longer than ``grid``, inside one (``word_cost``). With f(j) the least cost of the stream up to candidate j,

    f(j) = cut(j) + window_cost + min( size - p(j) + min { f(i) + p(i) : p(j) - size <= p(i) < p(j) },
                                       min { f(i) : p(j) - p(i) a power of two } )

The first minimum slides: a monotone queue gives it in constant time. The second is a look-up for each power.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_slices
from .pretokens import Encoder


def cut_points(n: np.ndarray, split: tuple, per: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending token positions where a window may end, and their kind: 0 text, 1 sentence, 2 inside one."""
    codes, offsets, words = split
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), np.diff(offsets))
    after = np.cumsum(per) + doc  # ids up to and with each pre-token; each earlier text has its end id besides
    stop = pc.match_substring_regex(pa.array(words, pa.string()), r"[.!?:;\x{3002}][\"')\]]*$").to_numpy(zero_copy_only=False) if words else np.zeros(0, bool)
    sentence = after[stop[codes].astype(bool)] if len(codes) else np.empty(0, np.int64)
    at = np.union1d(ends, sentence)
    at = at[at > 0]
    gap = np.diff(np.concatenate([[0], at]))
    wide = np.flatnonzero(gap > grid)
    inside = np.concatenate([np.arange(at[i] - gap[i] + grid, at[i], grid) for i in wide.tolist()] or [np.empty(0, np.int64)])
    allp = np.union1d(at, inside)
    kind = np.full(len(allp), 2, np.int8)
    kind[np.searchsorted(allp, at)] = 1
    kind[np.searchsorted(allp, ends)] = 0
    return allp, kind


def windows(points: np.ndarray, kind: np.ndarray, size: int, costs: tuple[float, float, float], window_cost: float) -> np.ndarray:
    """Ends of the windows of least cost; ``points`` are ascending and at most ``size`` apart."""
    total = int(points[-1])
    place = array("i", bytes(4 * (total + 1)))
    powers = [1 << k for k in range(size.bit_length() - 1, -1, -1) if 1 << k <= size]
    pos, cut = [0, *points.tolist()], [0.0, *np.asarray(costs, float)[kind].tolist()]
    cost, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    place[0] = -1
    for j in range(1, len(pos)):
        p = pos[j]
        low = p - size
        while queue[0][1] < low:
            queue.popleft()
        best, i = queue[0][0] + size - p, queue[0][2]
        for k in powers:
            if k <= p and (m := place[p - k]):
                m = 0 if m < 0 else m
                if cost[m] < best:
                    best, i = cost[m], m
        best += cut[j] + window_cost
        cost[j], back[j], place[p] = best, i, j
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = 2048, grid: int = 64, sentence_cost: float = 1.0, word_cost: float = 4.0, window_cost: float = 4.0) -> DataFrame:
    """One row for each piece of a text: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ``ids``.

    ``sequence_id`` is the partition's number times 2**33 plus the sequence's in it. No shuffle: a partition's
    slices (about 8 MB of text) are packed in the order in which they are stored, each to its end, so a task that
    runs anew gives the same rows. A null or empty text is its end id alone; rows without a ``doc_id`` are
    packed too; an empty table gives no rows.
    """

    def make():
        encoder = Encoder.of(tokenizer, "word")
        first = [0]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, n, split, per = encoder.ids(batch.column("text"), end)
            points, kind = cut_points(n, split, per, grid)
            ends = windows(points, kind, size, (0.0, sentence_cost, word_cost), window_cost)
            doc_ends = np.cumsum(n)
            stops = np.union1d(ends, doc_ends)
            starts = np.concatenate([[0], stops[:-1]])
            doc, window = np.searchsorted(doc_ends, starts, side="right"), np.searchsorted(ends, starts, side="right")
            opened = np.concatenate([[0], ends])[window]
            data = ids.tobytes()
            pieces = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            part = batch.column("part").to_numpy(zero_copy_only=False)[doc]
            out = [pc.take(batch.column("doc_id"), pa.array(doc)), starts - (doc_ends - n)[doc], stops - starts, np.array([zlib.crc32(x) for x in pieces], np.int64), n[doc], (part << 33) + first[0] + window, starts - opened]
            first[0] += len(ends)
            return pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in out), pa.array(pieces, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        return run

    rows = id_and_text(docs).withColumn("part", F.spark_partition_id().cast("long"))
    return map_slices(rows, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
