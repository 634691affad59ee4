"""Removal of every byte that a ``WIDTH``-byte string covers which also starts anywhere else, by sorted suffixes.

Which suffixes must be sorted together: every 200-byte string has an anchor, the 64-byte string in it with the least hash
(the first of equals). Consecutive starts with one anchor make a segment: those starts and the 199 bytes after the last. Equal
200-byte strings have equal anchors at equal places, so segments are compared within one anchor's key only:

1. segments that are equal as a whole (two 64-bit hashes and the shape) are counted by a window over the key; all their starts
   repeat. This settles copies and the inside of common passages without moving a text;
2. of keys with several distinct segments, one of each goes, with its bytes, to the task of its key. There the suffixes of many
   keys' segments are sorted in two stages: those smaller than their successor directly, by 8 bytes at a time; the rest are
   induced by a scan over the buckets of first characters. Neighbours among the segments' own starts with a common
   prefix of 200 bytes repeat;
3. keys with more than ``MANY`` distinct segments (the edges of a passage that very many texts have) take their starts'
   200-byte strings by hash to a grouped count instead, which splits over tasks and has no bound.

Removed bytes are the union of [start, start + 200) over repeated starts, by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_slices, partitions
from .jaccard_join import mix

WIDTH, GRAM, MANY = 200, 64, 10_000
PIECE = 2 << 20
SORT_BYTES = 1 << 20
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _C[0])


def grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of data[i : i + size] for each i where it fits; ``size`` a power of two from 8."""
    n = len(data) - 7
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.lib.stride_tricks.as_strided(data, (n, 8), (1, 1)).copy().view("<u8").ravel()
    step = 8
    out = mix(out)
    while step < size:
        out = mix(out[:-step] * _C[1] + out[step:] * _C[2]) if step * 2 == size else out[:-step] * _C[1] + mix(out[step:] + _C[3])
        step *= 2
    return out


class Ranges:
    """Two 64-bit hashes of any range of ``data``: polynomials with random digits, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        digit = _BYTE[data]
        self.sums = []
        for base in (_C[4] | np.uint64(1), _C[5] | np.uint64(1)):
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), base)]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digit * up[1:], dtype=np.uint64)])
            del up
            self.sums.append((sums, inverse))

    def of(self, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        out = []
        for sums, inverse in self.sums:
            down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(start.max(initial=0)), inverse)]))
            out.append(mix((sums[stop] - sums[start]) * down[start]))
        return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i where it fits: least from block starts and to block ends."""
    n = len(x)
    if n < width:
        return np.empty(0, x.dtype)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, 1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text and place in it of each run) with runs of whole texts, or of a long text's parts that overlap by WIDTH - 1."""
    held, doc, at, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < WIDTH:
            continue
        for a in range(0, max(1, len(t) - WIDTH + 1), PIECE):
            part = t[a : a + PIECE + WIDTH - 1]
            if held and size + len(part) > PIECE + WIDTH:
                yield held, np.array(doc), np.array(at)
                held, doc, at, size = [], [], [], 0
            held.append(part)
            doc.append(i)
            at.append(a)
            size += len(part)
    if held:
        yield held, np.array(doc), np.array(at)


def segments(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, d1, d2, run, first start in the run, number of starts of each segment of the runs."""
    size = np.array([len(x) for x in held])
    data = np.frombuffer(b"".join(held), np.uint8)
    run = np.repeat(np.arange(len(held)), size)
    begin = np.cumsum(size) - size
    g = grams(data)
    packed = (g >> np.uint64(28) << np.uint64(28)) | np.arange(len(g), dtype=np.uint64)
    anchor = (sliding_least(packed, WIDTH - GRAM + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    start = np.flatnonzero(np.arange(len(anchor)) + WIDTH <= (begin + size)[run[: len(anchor)]])
    if not len(start):
        z = np.empty(0, np.int64)
        return z, z, z, z, z, z
    anchor, r = anchor[start], run[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    lo, anchor = start[first], anchor[first]
    d1, d2 = Ranges(data).of(lo, lo + n - 1 + WIDTH)
    shape = (anchor - lo).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)
    return g[anchor].view(np.int64), (d1 + shape * _C[0]).view(np.int64), (d2 ^ mix(shape)).view(np.int64), r[first], lo - begin[r[first]], n


def two_stage(text: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Suffixes of ``text`` (uint16, its last character 0) in the order of their first ``depth`` characters at least.

    Suffixes smaller than their successor are sorted directly, 4 characters at a time and only where they still tie; the others are
    induced bucket by bucket: a suffix stands before those that follow it in the text, so a scan in order meets each successor first.
    """
    n = len(text)
    differs = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    nxt = differs[np.searchsorted(differs, np.arange(n))]  # end of the run of equal characters
    smaller = np.ones(n, bool)
    inner = nxt < n - 1
    smaller[inner] = text[nxt[inner] + 1] > text[nxt[inner]]
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint16)]).astype(np.uint64)
    four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
    direct = np.flatnonzero(smaller)
    order = direct[np.argsort(four[direct], kind="stable")]
    key = four[order]
    tie = np.zeros(len(order), bool)
    same = key[1:] == key[:-1]
    tie[1:] |= same
    tie[:-1] |= same
    group = np.cumsum(np.concatenate([[True], ~same]))
    for at in range(4, depth, 4):
        where = np.flatnonzero(tie)
        if not len(where):
            break
        own, g = order[where], group[where]
        key = four[np.minimum(own + at, n)]
        rank = np.lexsort((key, g))
        own, g, key = own[rank], g[rank], key[rank]
        order[where] = own
        same = (g[1:] == g[:-1]) & (key[1:] == key[:-1])
        t = np.zeros(len(where), bool)
        t[1:] |= same
        t[:-1] |= same
        tie[where] = t
        group[where] = np.cumsum(np.concatenate([[True], ~same]))
    counts = np.bincount(text, minlength=258)
    begin = np.cumsum(counts) - counts
    out = np.empty(n, np.int64)
    small_counts = np.bincount(text[order], minlength=258)
    small_begin = begin + counts - small_counts
    taken = np.cumsum(small_counts) - small_counts
    head = begin.copy()

    def induce(block: np.ndarray) -> None:
        before = block - 1
        before = before[before >= 0]
        before = before[~smaller[before]]
        before = before[np.argsort(text[before], kind="stable")]
        c = text[before]
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else []
        for a, b in zip(starts, np.append(starts[1:], len(c)), strict=True) if len(c) else ():
            k = int(c[a])
            out[head[k] : head[k] + b - a] = before[a:b]
            head[k] += b - a

    for c in np.flatnonzero(counts).tolist():
        done = int(begin[c])
        while done < head[c]:
            block = out[done : head[c]].copy()
            done = int(head[c])
            induce(block)
        own = order[taken[c] : taken[c] + small_counts[c]]
        out[small_begin[c] : small_begin[c] + small_counts[c]] = own
        induce(own)
    return out


def repeated_starts(rows: list[bytes], n: np.ndarray) -> list[np.ndarray]:
    """For each segment, which of its ``n`` starts have their 200-byte string at another start of ``rows``."""
    size = np.array([len(x) for x in rows])
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(rows), np.uint16)
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint16) + 1
    owned = np.zeros(len(text) + 1, np.int64)
    np.add.at(owned, begin, 1)
    np.add.at(owned, begin + n, -1)
    owned = np.cumsum(owned)[:-1] > 0
    order = two_stage(text)
    order = order[owned[order]]
    wide = np.concatenate([text, np.zeros(8, np.uint16)]).astype(np.uint64)
    four = (wide[:-3] << np.uint64(48)) | (wide[1:-2] << np.uint64(32)) | (wide[2:-1] << np.uint64(16)) | wide[3:]
    pair = np.arange(len(order) - 1)
    for at in range(0, WIDTH, 4):  # common prefixes of neighbours, as far as they reach
        pair = pair[four[order[pair] + at] == four[order[pair + 1] + at]]
    hit = np.zeros(len(text), bool)
    hit[order[pair]] = True
    hit[order[pair + 1]] = True
    return [hit[b : b + k] for b, k in zip(begin.tolist(), n.tolist(), strict=True)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _keys() -> tuple[Column, Column]:
    """_id and _mark; the mark tells apart rows that share an id. A null text is the empty text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text).alias("_mark")


def _segment_rows(docs: DataFrame) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids, marks = batch.column("_id").to_numpy(zero_copy_only=False), batch.column("_mark").to_numpy(zero_copy_only=False)
            for held, doc, at in pieces(texts):
                key, d1, d2, run_of, lo, n = segments(held)
                of = doc[run_of] if len(run_of) else run_of
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(d1), pa.array(d2), pa.array(ids[of]), pa.array(marks[of]), pa.array(lo + (at[run_of] if len(run_of) else 0)), pa.array(n.astype(np.int32))], ["key", "d1", "d2", "_id", "_mark", "lo", "n"])

        return run

    return map_slices(docs, make, "key long, d1 long, d2 long, _id long, _mark long, lo long, n int")


def _cut_out(df: DataFrame, schema: str, hashed: bool) -> DataFrame:
    """Rows of ``want`` (array of key, lo, n) with text to each segment's bytes, or to hashes of its starts' strings."""

    def make():
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for text, want, i, m in zip(*(batch.column(c).to_pylist() for c in ("text", "want", "_id", "_mark")), strict=True):
                data = text.encode()
                if hashed:
                    for w in want:
                        part = np.frombuffer(data[w["lo"] : w["lo"] + w["n"] + WIDTH - 1], np.uint8)
                        k = np.arange(w["n"])
                        h1, h2 = Ranges(part).of(k, k + WIDTH)
                        yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.full(w["n"], i)), pa.array(np.full(w["n"], m)), pa.array(w["lo"] + k)], ["h1", "h2", "_id", "_mark", "lo"])
                else:
                    yield pa.RecordBatch.from_pylist([{"key": w["key"], "_id": i, "_mark": m, "lo": w["lo"], "n": w["n"], "bytes": data[w["lo"] : w["lo"] + w["n"] + WIDTH - 1]} for w in want], schema=arrow)

        return run

    arrow = pa.schema([("key", pa.int64()), ("_id", pa.int64()), ("_mark", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])
    return map_slices(df, make, schema)


def _sort_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size, key = 0, None

    def close() -> pa.RecordBatch:
        hits = repeated_starts([h[4] for h in held], np.array([h[3] for h in held]))
        rows = [(h[0], h[1], h[2] + a, h[2] + b) for h, hit in zip(held, hits, strict=True) for a, b in _runs(hit)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["_id", "_mark", "lo", "hi"])

    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "_id", "_mark", "lo", "n", "bytes")), strict=True):
            if size > SORT_BYTES and k != key:
                yield close()
                held, size = [], 0
            key = k
            held.append(tuple(row))
            size += len(row[4])
    if held:
        yield close()


def _with_text(docs: DataFrame, by_text: DataFrame, how: str = "inner") -> DataFrame:
    """Join by id and mark; both sides may be large, so neither is broadcast by a hint."""
    return docs.join(by_text, ["_id", "_mark"], how)


def repeats(keyed: DataFrame) -> DataFrame:
    """_id, _mark, spans (array of first and last repeated start) of the texts that have any."""
    parts = partitions(keyed.sparkSession)
    keyed = keyed.select("_id", "_mark", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    same = Window.partitionBy("key", "d1", "d2")
    rows = _segment_rows(keyed.where("octet_length(text) >= 200")).repartition(parts, "key")
    rows = rows.withColumn("copies", F.count("*").over(same)).withColumn("place", F.row_number().over(same.orderBy("_id", "_mark", "lo")))
    rows = rows.withColumn("kinds", F.sum((F.col("place") == 1).cast("long")).over(Window.partitionBy("key")))
    rows = cut(rows.where("copies > 1 or kinds > 1"), "segments")
    whole = rows.where("copies > 1").select("_id", "_mark", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))

    def wanted(which: str) -> DataFrame:
        want = rows.where("place = 1 and kinds > 1").where(which)
        return _with_text(keyed, want.groupBy("_id", "_mark").agg(F.collect_list(F.struct("key", "lo", "n")).alias("want")))

    cut_out = _cut_out(wanted(f"kinds <= {MANY}"), "key long, _id long, _mark long, lo long, n int, bytes binary", False)
    edges = cut_out.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sort_keys, "_id long, _mark long, lo long, hi long")
    spans = whole.unionByName(edges)
    if not rows.where(f"kinds > {MANY}").isEmpty():
        strings = cut(_cut_out(wanted(f"kinds > {MANY}"), "h1 long, h2 long, _id long, _mark long, lo long", True), "strings")
        often = strings.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1")
        spans = spans.unionByName(strings.join(often, ["h1", "h2"], "left_semi").select("_id", "_mark", "lo", F.col("lo").alias("hi")))
    return cut(spans.groupBy("_id", "_mark").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "spans")


def kept(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """(bytes that stay, removed bytes, maximal removed runs)."""
    if not spans:
        return data, 0, 0
    out, at, runs, removed = [], 0, 0, 0
    for s in spans:
        a, b = s["lo"], s["hi"] + WIDTH
        if a > at or not runs:
            runs += 1
            out.append(data[at:a])
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    out.append(data[at:])
    return b"".join(out), removed, runs


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row.

    A null text is the empty text; texts shorter than 200 bytes lose nothing. Rows that share a ``doc_id``, or have none, are texts of
    their own; a row that repeats another one whole counts as elsewhere. An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *_keys())
    table = repeats(keyed)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [kept(t, s) for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([hashlib.sha256(f[0]).hexdigest() for f in found]), pa.array([f[0] for f in found], pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        return run

    return map_slices(_with_text(keyed, table, "left"), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def clean(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the repeated bytes taken out of ``text`` and ``n_chars`` (if there) counted anew.

    Bytes of a character that is cut apart go too. Rows of which nothing stays are kept, with the empty text; a null text stays null. Null and
    repeated ids as in ``dedup``; columns of any name (but dots) come through as they are. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text").select("row", "text", *_keys())
    table = repeats(rows)

    @F.pandas_udf("string")
    def rest(text, spans):
        return text.combine(spans, lambda t, s: t if s is None or t is None else kept(t.encode(), list(s))[0].decode("utf-8", "ignore"))

    joined = _with_text(rows, table, "left")
    joined = joined.withColumn("left", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest("text", "spans")))
    types = {f.name: f.dataType for f in docs.schema}
    new = {"text": F.col("left"), "n_chars": F.length("left").cast(types.get("n_chars", "long"))}
    return joined.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
