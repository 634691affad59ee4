"""Token ids as canonical length-limited Huffman code, in independent blocks with bit-offset checkpoints.

Two passes over the texts' ids: the ids of every text are made once and kept as a table; their counts over
all texts give one code (package-merge, 16 bits at most, canonical, so code lengths are the whole codebook).
Each text is coded by itself, then dealt to ranges of ``doc_id`` and written in ascending order as blocks:

    part, block        place of the block; blocks of a part ascend
    token_start        tokens of the part before the block
    n_tokens           tokens in the block
    doc_ids            int64 of each text
    doc_tokens         uint32 tokens of each text
    doc_bytes          uint32 coded bytes of each text (texts start at a byte)
    checkpoints        uint32 bit offset in its text of every 512th token of each text
    payload            the code bits, high bit first

A reader needs the codebook and one block. Decoding looks up 16 bits at a time in a table of 65,536 entries,
for all checkpoints of a block in step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, map_slices, partitions, release, saved
from .pretokens import Encoder

MAX_BITS = 16
STEP = 512
BLOCK_TOKENS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length of every id, 0 for one that doesn't occur: package-merge."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        length[:k] += 1
        take = 2 * (take - k)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each 16 bits that may come next."""
    codes, ids, size = canonical(lengths), np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.uint8)
    for i in np.flatnonzero(lengths).tolist():
        free = MAX_BITS - int(lengths[i])
        a = int(codes[i]) << free
        ids[a : a + (1 << free)], size[a : a + (1 << free)] = i, lengths[i]
    return ids, size


def encode(ids: np.ndarray, n: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Payload, bytes of each text, checkpoints one after the other, their number in each text."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    before = np.concatenate([[0], np.cumsum(bits)])
    text_bits = before[ends] - before[ends - n]
    text_bytes = (text_bits + 7) >> 3
    base = (np.cumsum(text_bytes) - text_bytes) * 8
    at = before[:-1] + np.repeat(base - before[ends - n], n)
    word, shift = at >> 6, 64 - (at & 63) - bits
    value = codes[ids].astype(np.uint64)
    high = np.where(shift >= 0, value << np.maximum(shift, 0).astype(np.uint64), value >> np.maximum(-shift, 0).astype(np.uint64))
    out = np.zeros((int(text_bytes.sum()) >> 3) + 2, np.uint64)
    if len(word):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[starts]] = np.bitwise_or.reduceat(high, starts)
        over = np.flatnonzero(shift < 0)
        out[word[over] + 1] |= value[over] << (64 + shift[over]).astype(np.uint64)
    marks = (n + STEP - 1) // STEP
    first = np.repeat(ends - n, marks) + STEP * (np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks))
    checkpoints = (at[first] - np.repeat(base, marks)).astype("<u4") if len(first) else np.empty(0, "<u4")
    return out.astype(">u8").tobytes()[: int(text_bytes.sum())], text_bytes, checkpoints, marks


def decode(payload: bytes, n: np.ndarray, text_bytes: np.ndarray, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block."""
    symbol, size = table
    n, text_bytes = n.astype(np.int64), text_bytes.astype(np.int64)
    raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    marks = (n + STEP - 1) // STEP
    lane = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
    pos = np.repeat((np.cumsum(text_bytes) - text_bytes) * 8, marks) + checkpoints
    todo = np.minimum(STEP, np.repeat(n, marks) - lane * STEP)
    dest = np.repeat(np.cumsum(n) - n, marks) + lane * STEP
    out = np.empty(int(n.sum()), "<u4")
    order = np.argsort(-todo, kind="stable")
    pos, todo, dest = pos[order], todo[order], dest[order]
    live = len(pos) - np.searchsorted(todo[::-1], np.arange(STEP), side="right")
    for step in range(STEP):
        k = int(live[step])
        if not k:
            break
        here = pos[:k]
        key = (window[here >> 3] >> (8 - (here & 7)).astype(np.uint32)) & 0xFFFF
        out[dest[:k] + step] = symbol[key]
        pos[:k] = here + size[key]
    return out


def _ids_table(docs: DataFrame, path: str, end: int) -> DataFrame:
    def make():
        encoder = Encoder.of(path, "byte")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, n, _, _ = encoder.ids(batch.column("text"), end)
            small = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids
            width = small.itemsize
            ends = np.cumsum(n) * width
            data = small.tobytes()
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array([data[e - k : e] for e, k in zip(ends.tolist(), (n * width).tolist(), strict=True)], pa.binary())], ["doc_id", "n_tokens", "ids"])

        return run

    return map_slices(docs, make, "doc_id long, n_tokens long, ids binary")


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
    rows = batch.column("ids").to_pylist()
    return np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype(np.uint32) for x, k in zip(rows, n.tolist(), strict=True)]) if rows else np.empty(0, np.uint32), n


def global_counts(ids: DataFrame) -> np.ndarray:
    """Occurrences of every id over all texts; the driver gets a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                c = np.bincount(_unpack(batch)[0]).astype(np.int64)
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])

    rows = ids.select("n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end: int, parts: int | None = None) -> None:
    """Write the files described above to ``path``/blocks, and the code lengths to ``path``/codebook.

    A null text is the empty text and holds ``end`` alone. Rows with one ``doc_id`` stay next to each other; rows
    without one come first. An empty table gives no blocks.
    """
    spark = docs.sparkSession
    parts = parts or partitions(spark)
    ids, ids_path = saved(_ids_table(id_and_text(docs), tokenizer, end), "ids")
    lengths = code_lengths(global_counts(ids))
    codes = canonical(lengths)
    bounds = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, n = _unpack(batch)
            payload, size, marks, k = encode(values, n, codes, lengths)
            ends, stops = np.cumsum(size), np.cumsum(k) * 4
            data = marks.tobytes()
            part = np.searchsorted(np.asarray(bounds), batch.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right")
            cut = lambda d, e, s: pa.array([d[b - x : b] for b, x in zip(e.tolist(), s.tolist(), strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column("doc_id"), pa.array(n), cut(data, stops, k * 4), cut(payload, ends, size)], ["part", "doc_id", "n_tokens", "checkpoints", "payload"])

        return run

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, number, start, count = None, 0, 0, 0

        def close() -> pa.RecordBatch:
            ids_, n_, marks_, data_ = zip(*held, strict=True)
            null = np.array([i is None for i in ids_])
            return pa.RecordBatch.from_pylist([{"part": part, "block": number, "token_start": start, "n_tokens": sum(n_), "null_ids": int(null.sum()), "doc_ids": np.array([i or 0 for i in ids_], "<i8").tobytes(), "doc_tokens": np.array(n_, "<u4").tobytes(), "doc_bytes": np.array([len(x) for x in data_], "<u4").tobytes(), "checkpoints": b"".join(marks_), "payload": b"".join(data_)}], schema=out)

        out = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("token_start", pa.int64()), ("n_tokens", pa.int64()), ("null_ids", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "doc_tokens", "doc_bytes", "checkpoints", "payload"))])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "checkpoints", "payload")), strict=True):
                if held and (row[0] != part or count + row[2] > BLOCK_TOKENS):
                    yield close()
                    start, number, held, count = start + count, number + 1, [], 0
                if row[0] != part:
                    part, number, start = row[0], 0, 0
                held.append(row[1:])
                count += row[2]
        if held:
            yield close()

    coded = map_slices(ids, make, "part int, doc_id long, n_tokens long, checkpoints binary, payload binary", "ids")
    coded.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first()).mapInArrow(blocks, "part int, block long, token_start long, n_tokens long, null_ids long, doc_ids binary, doc_tokens binary, doc_bytes binary, checkpoints binary, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    release(spark, ids_path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, as ``ids``, the little-endian ids of every text, from the files.

    The driver gets one row for each part of the files.
    """
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").head()[0]), np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = dict(blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, base = 0, {}
    for part in sorted(totals):
        base[part] = before
        before += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                ids = decode(row["payload"], n, np.frombuffer(row["doc_bytes"], "<u4"), np.frombuffer(row["checkpoints"], "<u4"), table)
                ends = np.cumsum(n)
                data = ids.tobytes()
                texts = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                doc = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=np.arange(len(doc)) < row["null_ids"]), pa.array(base[row["part"]] + row["token_start"] + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in texts], pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
