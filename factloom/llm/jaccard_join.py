"""Jaccard join of word shingles by PartEnum signatures, and its connected components.

Sets whose sizes allow a similarity of 3/4 lie in one band of sizes or in neighbouring ones (bands [l, 4l/3]); a set takes part
in the instance of its band and of the next. Linked sets of at most r shingles differ in d <= 2r/7 of them. An instance for sizes
up to r deals the domain of shingles to n1 groups of ``PARTITIONS`` partitions each and enumerates in each group the subsets of all
partitions but ``SPARED``; a signature is the hash of what a set holds in the partitions of one subset. Where at most ``SPARED``
shingles of a group differ, one subset at least is the same in both sets; with d < (SPARED + 1) n1 some group is like that.

Subsets in which a set holds nothing are no signatures. With y(g) partitions of group g that hold something, a set's group
stands min(y, SPARED + 1) differing shingles less one; n1 is large enough for the sum of these to pass d. The few sets for which it
doesn't (weak ones, by chance) also give the signatures of up to ``DEALS`` - 1 other deals of the domain, and those still weak then each
shingle: of a linked pair either one set is strong in some deal, which both have, or both give their shingles. No link is lost.

The same count says how many signatures linked sets share at least (``least``). In the order of (number of sets, signature) the
first common one is followed by that many less one in either set, so a set keeps only its rarest signatures, all but the last
``least`` - 1, and two sets meet at one only if that many follow in both. Of signatures that the same sets keep, one stays.

Signatures travel as packed bytes, dealt by hash, with a row of figures for each text; one that only one text has goes no further.
Copies count as one set. Each set of a signature is compared with the signature's first set. Signatures whose sets are then not yet
connected stay open: their sets are compared with more firsts in each round, as far as they aren't connected, until all are or
all pairs have met. So a group of copies is never expanded into its pairs. Two sets of one band don't meet in the instance of the next, where
they would only meet again, and pairs go whose parities (a bit for each of 1,024 parts of the domain) differ more than linked
sets can. All comparisons are of whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, flat, id_and_text, join_small, map_slices, partitions, release, saved
from .components import components

WORDS = 5
#: First sets of an open signature that a round compares: as many times those of the round before.
MORE = 16
PARITY = [f"p{k}" for k in range(16)]
#: Partitions of a group, and those that a subset leaves out; groups beyond the fewest possible, as some partitions are empty.
PARTITIONS, SPARED, BEYOND = 3, 1, 1.08
SUBSETS = list(combinations(range(PARTITIONS), PARTITIONS - SPARED))
DEALS = 3
#: Bytes of text of a slice; shingles of a row of a set; tasks to which the comparisons with one set are dealt.
SLICE, CHUNK, SALTS = 4 << 20, 2048, 64
#: Bytes of a signature within its bucket.
KEY = 4
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
#: A-Z to a-z, and the white space of words to blanks.
_FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_INFO = np.dtype([("doc", "<i8"), ("known", "?"), ("n", "<i8"), ("d1", "<i8"), ("d2", "<i8"), ("even", "<i4"), ("odd", "<i4"), ("band", "<i4")])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts in them)."""
    texts = pc.fill_null(flat(texts).cast(pa.binary()), b"")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = (bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data else b"").translate(_FOLD)
    offsets = offsets - offsets[0]
    solid = np.frombuffer(raw, np.uint8) != 32
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    at = np.flatnonzero(begin)
    size = np.flatnonzero(end) + 1 - at
    eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), 0, (1,))  # the 8 bytes from each place on
    value, live, k = np.full(len(at), _M[5], np.uint64), np.arange(len(at)), 0
    while len(live):
        left = size[live] - k
        chunk = eight[at[live] + k]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        value[live] = mix((value[live] ^ chunk) * _M[0] + np.uint64(k + 1))
        live, k = live[left > 8], k + 8
    return mix(value + size.astype(np.uint64)), np.searchsorted(at, offsets)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, ascending within a text; offsets)."""
    h, offsets = words(texts)
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    left = offsets[1:][doc] - np.arange(len(h))  # words from here to the end of the text
    short = size < WORDS
    keep = left >= WORDS
    if short.any():
        keep |= short[doc] & (left == size[doc])
    at = np.flatnonzero(keep)
    value = np.zeros(len(at), np.uint64)
    whole = not short.any()
    for k in range(WORDS):
        term = padded[at + k] * _M[k]
        value += term if whole else np.where(left[at] > k, term, np.uint64(0))
    value = mix(value + np.minimum(left[at], WORDS).astype(np.uint64))
    doc = doc[at]
    starts = np.searchsorted(doc, np.arange(n + 1))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        value[a:b].sort()
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[first], np.searchsorted(doc[first], np.arange(n + 1))


def digests(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def total(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return (s[offsets[1:]] - s[offsets[:-1]]).view(np.int64)

    return total(mix(value ^ _M[5])), total(mix(value * _M[6] + _M[0]))


def bands(most: int) -> np.ndarray:
    """Largest size of each band."""
    out, low = [], 1
    while not out or out[-1] < most:
        out.append(low * 4 // 3)
        low = out[-1] + 1
    return np.array([*out, low * 4 // 3], np.int64)


def _losses() -> list[int]:
    """Signatures that a group loses at most by its first, second, ... differing shingle."""
    size = PARTITIONS - SPARED
    held = [math.comb(PARTITIONS - k, size) for k in range(SPARED + 2)]
    return [a - b for a, b in zip(held, held[1:], strict=False)]


def _deal(value: np.ndarray, offsets: np.ndarray, up: int, deal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the instance of each set's band (or the next, ``up`` = 1), their sets, number and ``least`` of the instances."""
    size = np.diff(offsets)
    n, doc = len(size), np.repeat(np.arange(len(size)), size)
    tops = bands(int(size.max(initial=1)))
    instance = np.searchsorted(tops, size) + up
    r = tops[np.minimum(instance, len(tops) - 1)]
    n1 = np.where(size > 0, np.ceil(BEYOND * (2 * r // 7 + 1) / (SPARED + 1)).astype(np.int64) + 1, 0)
    base = np.cumsum(n1) - n1
    if deal:
        value = mix(value ^ (_M[3] * np.uint64(deal)))
    group = (((value & np.uint64(0xFFFFFFFF)) * n1[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + base[doc]
    cell = group * PARTITIONS + (value >> np.uint64(33)).astype(np.int64) % PARTITIONS
    groups = int(n1.sum())
    held = np.bincount(cell, minlength=groups * PARTITIONS).reshape(groups, PARTITIONS) > 0
    total = np.zeros(groups * PARTITIONS, np.uint64)
    np.add.at(total, cell, mix(value ^ _M[4]))
    of = np.repeat(np.arange(n), n1)
    name = ((np.arange(groups) - base[of]).astype(np.uint64) << np.uint64(24)) + ((instance[of] * DEALS + deal).astype(np.uint64) << np.uint64(3))
    total = total.reshape(groups, PARTITIONS)
    part = [mix(total[:, j] + mix(name + np.uint64(j))) for j in range(PARTITIONS)]
    keys, sets = [], []
    for subset in SUBSETS:
        some = np.flatnonzero(held[:, list(subset)].any(1))
        keys.append(mix(sum(part[j][some] for j in subset)))
        sets.append(of[some])
    filled = held.sum(1)
    differ, least = (size + np.minimum(r, size * 4 // 3)) // 7, np.zeros(n, np.int64)
    for k, loss in enumerate(_losses()):
        able = np.bincount(of[filled > k], minlength=n)
        lost = np.minimum(differ, able)
        least += loss * (able - lost)
        differ = differ - lost
    return np.concatenate(keys), np.concatenate(sets), instance, least


def signatures(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their set) and, for each set, how many of its signatures each linked set shares at least in its instance of
    even and of odd number. The last bit of a signature is that of its instance's number."""
    n = len(offsets) - 1
    keys, docs, slack = [], [], np.ones((n, 2), np.int64)

    def add(key: np.ndarray, doc: np.ndarray, instance: np.ndarray) -> None:
        keys.append((key & ~np.uint64(1)) | (instance & 1).astype(np.uint64))
        docs.append(doc)

    for up in (0, 1):
        weak, v, o = np.arange(n), value, offsets
        for deal in range(DEALS):
            key, of, instance, least = _deal(v, o, up, deal)
            add(key, weak[of], instance[of])
            if not deal:
                slack[np.arange(n), instance & 1] = np.maximum(least, 1)
            stay = (least <= 0) & (np.diff(o) > 0)
            size = np.diff(o)
            v, weak, instance = v[np.repeat(stay, size)], weak[stay], instance[stay]
            o = np.concatenate([[0], np.cumsum(size[stay])])
            if not len(weak):
                break
        else:
            number = np.repeat(instance, np.diff(o))
            add(mix(v * _M[2] + number.astype(np.uint64)), np.repeat(weak, np.diff(o)), number)
    return np.concatenate(keys), np.concatenate(docs), slack


def packed_signatures(docs: DataFrame, bits: int) -> DataFrame:
    """bucket, keys (``KEY`` bytes each), docs (differences of ids, ``width`` bytes each): a row for each slice and bucket. One more
    row of a slice holds ``info``: id, shingles, digests and ``least`` of each of its texts."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            batch = batch.take(pc.sort_indices(batch.column("doc_id")))
            value, offsets = shingles(batch.column("text"))
            size, (d1, d2) = np.diff(offsets), digests(value, offsets)
            known = pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            # copies of a set within the slice count once, under the least id
            able = np.flatnonzero(known & (size > 0))
            order = able[np.lexsort((able, size[able], d2[able], d1[able]))]
            new = np.ones(len(order), bool)
            new[1:] = (d1[order[1:]] != d1[order[:-1]]) | (d2[order[1:]] != d2[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
            keep = np.zeros(len(size), bool)
            keep[order[new]] = True
            kept = np.flatnonzero(keep)
            key, of, slack = signatures(value[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[kept])]))
            info = np.zeros(len(size), _INFO)
            info["doc"], info["known"], info["n"], info["d1"], info["d2"] = ids, known, size, d1, d2
            info["even"], info["odd"] = 1, 1
            info["band"] = np.searchsorted(bands(int(size.max(initial=1))), size) & 1
            at = np.zeros(len(size), np.int64)
            at[kept] = np.arange(len(kept))
            info["even"][order], info["odd"][order] = slack[at[order[new]]][np.cumsum(new) - 1].T if len(order) else (1, 1)
            order = np.argsort(of.astype(np.uint16) if len(kept) < 1 << 16 else of, kind="stable")
            key, of = key[order], of[order]
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
            key, bucket, ids = key[order], bucket[order], ids[kept][of[order]]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
            stops = np.append(starts[1:], len(bucket)) if len(starts) else starts
            raw = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes()
            rows_k, rows_d, width = [], [], []
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                step = np.diff(ids[a:b], prepend=0)
                later = int(step[1:].max(initial=0))
                kind = "<u1" if later < 1 << 8 else "<u2" if later < 1 << 16 else "<u4" if later < 1 << 32 else "<i8"
                rows_k.append(raw[a * KEY : b * KEY])
                rows_d.append(ids[a : a + 1].astype("<i8").tobytes() + step[1:].astype(kind).tobytes())
                width.append(int(kind[-1]))
            own = int(d1.view(np.uint64).sum() >> np.uint64(64 - bits))
            columns = [pa.array([*bucket[starts].tolist(), own], pa.int64()), pa.array([*width, 0], pa.int32()), pa.array([*rows_k, b""], pa.binary()), pa.array([*rows_d, b""], pa.binary()), pa.array([*[None] * len(width), info.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "width", "keys", "docs", "info"])

        return run

    return map_slices(docs, make, "bucket long, width int, keys binary, docs binary, info binary", limit=SLICE)


def shared(packed: DataFrame, parts: int, held_most: int = 2_000_000) -> DataFrame:
    """sig, doc_id of every signature that several texts have; without sig, doc_id, n, d1, d2, even, odd, band (whether its number is odd) of each text.

    A task reads bucket after bucket. What it holds of a bucket is compacted whenever it passes ``held_most`` entries: repeated
    signatures are passed on and leave one entry behind, however many sets have them.
    """
    figures = ["n", "d1", "d2", "even", "odd", "band"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, count = None, [], 0

        def compact() -> pa.RecordBatch:
            key = np.concatenate([h[0] for h in held])
            doc = np.concatenate([h[1] for h in held])
            done = np.concatenate([h[2] for h in held])
            order = np.argsort(key, kind="stable")
            key, doc, done = key[order], doc[order], done[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            run_of = np.cumsum(first) - 1
            many = np.bincount(run_of)[run_of] > 1
            out = many & ~done
            held[:] = [(key[first], doc[first], (done | many)[first])]
            # a run's mark: passed on before, or now
            sig = (np.int64(now) << (8 * KEY)) | key[out].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(doc[out]), *(pa.nulls(len(sig), pa.int64()) for _ in figures)], ["sig", "doc_id", *figures])

        for batch in batches:
            for bucket, width, keys, docs, info in zip(*(batch.column(c).to_pylist() for c in ("bucket", "width", "keys", "docs", "info")), strict=True):
                if info is not None:
                    x = np.frombuffer(info, _INFO)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(x["doc"], mask=~x["known"]), *(pa.array(x[c].astype(np.int64)) for c in figures)], ["sig", "doc_id", *figures])
                    continue
                if bucket != now or count > held_most:
                    if held:
                        yield compact()
                    if bucket != now:
                        now, held[:] = bucket, []
                    count = sum(len(h[0]) for h in held)
                ids = np.cumsum(np.concatenate([np.frombuffer(docs[:8], "<i8"), np.frombuffer(docs[8:], f"<{'i' if width == 8 else 'u'}{width}").astype(np.int64)]))
                held.append((np.frombuffer(keys, f"<u{KEY}"), ids, np.zeros(len(ids), bool)))
                count += len(ids)
        if held:
            yield compact()

    schema = "sig long, doc_id long, n long, d1 long, d2 long, even long, odd long, band long"
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, which (digest of the set), n, k, shingles: a set in rows of ``CHUNK`` shingles; p0 .. p15 (in the first row): of each
    of 1,024 parts of the domain, whether the set has an odd number of its shingles."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            value, offsets = shingles(batch.column("text"))
            n, size = len(offsets) - 1, np.diff(offsets)
            which, data = digests(value, offsets)[0], value.astype("<u8").tobytes()
            cell = 1024 * np.repeat(np.arange(n), size) + (value >> np.uint64(54)).astype(np.int64)
            odd = np.packbits(np.bincount(cell, minlength=1024 * n).astype(np.uint8) & 1).view("<i8").reshape(n, 16)
            rows = -(-size // CHUNK)
            doc = np.repeat(np.arange(n), rows)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
            a = offsets[doc] + CHUNK * k
            b = np.minimum(a + CHUNK, offsets[doc + 1])
            parts = pa.array([data[8 * x : 8 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            ids = batch.column("doc_id").take(pa.array(doc))
            return pa.RecordBatch.from_arrays([ids, pa.array(which[doc]), pa.array(size[doc]), pa.array(k), parts, *(pa.array(np.ascontiguousarray(c), mask=k > 0) for c in odd[doc].T)], ["doc_id", "which", "n", "k", "shingles", *PARITY])

        return run

    return map_slices(docs, make, "doc_id long, which long, n long, k long, shingles binary, " + ", ".join(f"{p} long" for p in PARITY), limit=SLICE)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """a, b of the ``pairs`` (a, b, hub) that link. A hub's set is sent once to each task that has pairs of it, and sets go in rows of ``CHUNK``
    shingles, so a task holds one hub's set and a batch of rows, whatever the sets' sizes."""
    other = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    pairs = pairs.select("hub", other.alias("other")).withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(SALTS)).cast("int"))
    chunk = ["which", "n", "k", "shingles"]
    own = pairs.select("hub", "salt").distinct().join(sets.select(F.col("doc_id").alias("hub"), *chunk), "hub").select("hub", "salt", F.lit(None).cast("long").alias("other"), *chunk)
    theirs = pairs.join(sets.select(F.col("doc_id").alias("other"), *chunk), "other").select("hub", "salt", "other", *chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, mine, last, both, size = None, {}, None, {}, 0
        found: set[tuple[int, int]] = set()

        def close() -> None:
            if last and any(100 * c >= percent * (len(mine[w]) + size - c) for w, c in both.items()):
                found.add((last[0], last[1]))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("hub", "salt", "other", *chunk))
            for hub, salt, other, which, n, k, data in zip(*columns, strict=True):
                x = np.frombuffer(data, "<u8")
                if other is None:
                    if place != (hub, salt):
                        close()
                        place, mine, last, parts_of = (hub, salt), {}, None, {}
                    parts_of.setdefault(which, {})[k] = x
                    continue
                if last is None:
                    mine = {w: np.concatenate([p[i] for i in sorted(p)]) for w, p in parts_of.items()}
                if last is None or last[:3] != (hub, other, which):
                    close()
                    last, both, size, seen = (hub, other, which), dict.fromkeys(mine, 0), n, -1
                if k > seen:  # a row that repeats has its chunks twice
                    seen = k
                    for w, s in mine.items():
                        both[w] += int((s[np.minimum(np.searchsorted(s, x), len(s) - 1)] == x).sum())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([o for _, o in found], pa.int64())], ["a", "b"])
                found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([o for _, o in found], pa.int64())], ["a", "b"])

    rows = own.unionByName(theirs).repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("other").asc_nulls_first(), "which", "k")
    return rows.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _may_link(differ: str) -> str:
    """What linked sets a and b meet; a set of 0 shingles is a node of several texts, for which sizes say nothing."""
    sizes = f"na = 0 or nb = 0 or (4 * least(na, nb) >= 3 * greatest(na, nb) and 7 * ({differ}) <= na + nb)"
    return f"a != b and ca != cb and not (ua and ub) and least(la, lb) >= greatest(ta, tb) and ({sizes})"


def groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least ``doc_id`` reachable by links of ``percent`` (75 or more).

    A null text is the empty text; texts without words link with nothing. Rows that share a ``doc_id`` are one node, with
    the links of all of them. Rows without a ``doc_id`` link with nothing and have no component. An empty table gives no rows;
    other columns don't matter.
    """
    if percent < 75:
        raise ValueError("the bands and partitions hold for 75 percent or more")
    docs = id_and_text(docs)
    spark = docs.sparkSession
    parts = partitions(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(20, max(4, math.ceil(math.log2(size / 1_000_000 + 1))))
    found, found_at = saved(shared(packed_signatures(docs, bits), parts), "shared")
    info = found.where("sig is null").drop("sig")
    able = info.where("n > 0 and doc_id is not null")
    copies = cut(able.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "copies")
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")
    known = cut(join_small(info, copies, ["n", "d1", "d2"], "left").select("doc_id", "n", "d1", "d2", "even", "odd", "band", rep), "classes")
    several = F.expr("min(d1) != max(d1) or min(d2) != max(d2) or min(n) != max(n)")
    one_of = lambda c, other: F.when(several, other).otherwise(F.min(c)).cast("int").alias(c)
    own = cut(known.where("doc_id = rep and n > 0").groupBy("doc_id").agg(one_of("n", 0), one_of("even", 1), one_of("odd", 1), one_of("band", -1)), "representatives")
    # rows of one id with several sets tie their sets together
    tied = known.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    links = cut(tied.select("a", F.explode("reps").alias("b")).where("a != b"), "ties")
    members = join_small(found.where("sig is not null").select("sig", "doc_id"), own, "doc_id").select("sig", "doc_id", "n", F.when(F.col("sig") % 2 == 0, F.col("even")).otherwise(F.col("odd")).alias("least"), ((F.col("band") >= 0) & (F.col("band") != F.col("sig") % 2)).alias("up"))
    members, members_at = saved(members, "members")
    release(spark, found_at)
    # up: the instance is that of the next band; sets that are all up met in their own
    counts = members.groupBy("sig").agg(F.count("*").cast("int").alias("c"), F.bool_and("up").alias("all_up")).where("c > 1 and not all_up").drop("all_up")
    # left: its signatures in the instance from this one on; the rarest come first
    instance = Window.partitionBy("doc_id", F.col("sig") % 2)
    ranked = members.join(counts, "sig").withColumn("of", F.count("*").over(instance).cast("int"))
    ranked = ranked.withColumn("left", (F.col("of") - F.row_number().over(instance.orderBy("c", "sig")) + 1).cast("int"))
    firm, firm_at = saved(ranked.where("left >= least"), "firm")
    release(spark, members_at)
    # of the signatures of an instance that the same sets keep, the first stays
    sums = (F.bit_xor(F.xxhash64("doc_id")).alias("s1"), F.bit_xor(F.xxhash64("doc_id", F.lit(7))).alias("s2"))
    listed = firm.groupBy("sig").agg(F.min("c").alias("c"), F.count("*").alias("k"), F.bool_and("up").alias("all_up"), *sums).where("k > 1 and not all_up")
    one = cut(listed.groupBy((F.col("sig") % 2).alias("instance"), "k", "s1", "s2").agg(F.min(F.struct("c", "sig")).alias("first")).select("first.sig"), "lists")
    members = cut(join_small(firm, one, "sig", "left_semi").select("sig", "doc_id", "n", "least", "left", "of", "up"), "members")
    release(spark, firm_at)
    candidates = cut(members.select("doc_id").distinct(), "candidates")
    sets = cut(_sets(join_small(docs, candidates, "doc_id", "left_semi")), "shingles")
    # two sets differ in one shingle at least for each part whose parity differs, and linked ones in a seventh of their sizes at most
    parities = cut(sets.where("k = 0").groupBy("doc_id").agg(*(F.min(p).alias(p) for p in PARITY)), "parities")
    members = cut(join_small(members, parities, "doc_id"), "members")
    differ = " + ".join(f"bit_count(a{p} ^ b{p})" for p in PARITY)
    # a signature's first set is the one with most signatures, so that sets meet the same firsts again and again
    figures = {"doc_id": "", "n": "n", "least": "t", "left": "l", "up": "u", "comp": "c", **{p: p for p in PARITY}}
    renamed = lambda x: [F.col(c).alias((x if c == "doc_id" else f"{short}{x}") if c not in PARITY else x + c) for c, short in figures.items()]
    least, tried, pivots = (None if links.isEmpty() else components(links)), None, 1
    while True:
        here = members.withColumn("comp", F.col("doc_id")) if least is None else members.join(least, members.doc_id == least.node, "left").select(*members.columns, F.coalesce("component", "doc_id").alias("comp"))
        if tried is None:
            firsts = here.groupBy("sig").agg(F.min(F.struct((-F.col("of")).alias("of"), *figures)).alias("first")).select("sig", "first.*").select("sig", *renamed("a"))
        else:
            # a signature is open while its sets are in several components and not all of them were firsts
            spread = here.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("k"))
            open_ = spread.where(F.col("low") != F.col("high")).where(F.col("k") > pivots // MORE + 1).select("sig")
            here = cut(here.join(open_, "sig", "left_semi"), "open")
            if here.isEmpty():
                break
            place = F.row_number().over(Window.partitionBy("sig").orderBy(F.col("of").desc(), "doc_id"))
            firsts = here.withColumn("place", place).where(F.col("place") <= pivots).select("sig", *renamed("a"))
        meet = firsts.join(here.select("sig", *renamed("b")), "sig").where(_may_link(differ))
        pairs = meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("hub")).groupBy("a", "b").agg(F.min("hub").alias("hub"))
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        new = cut(_linked(pairs, sets, percent, parts), "links")
        if least is None or not new.isEmpty():
            links = links.unionByName(new)
            least = components(links)
        pivots *= MORE
    out = known.join(least, known.rep == least.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the least of its group; rows without one stay.

    Nulls, empty texts and empty tables as in ``groups``; all columns stay. Rows that repeat the least id stay all.
    """
    drop = cut(groups(docs).where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    return join_small(docs, drop, "doc_id", "left_anti")
