"""Lloyd's rounds over vectors of whole numbers, exact to the last digit.

Squared distances come from the expansion |x|^2 - 2 x.c + |c|^2: one matrix product for each block of vectors, in float64 by BLAS. Every term and
partial sum of it is a whole number of size 64 (M + C)^2 at most (M, C: greatest components of the vector and of the centroids), so while
that stays below 2^53 nothing is rounded, in whatever order BLAS adds. Vectors beyond that bound go to 64-bit integers, and beyond
2^63 to Python's own, row by row. Sums and counts of a block are added up by ``treeAggregate`` in Python's integers.

Only the centroids pass through the driver. The vectors are kept once, as rows of float64 bytes in the shared folder, and read each round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Rows of a block of the matrix product.
BLOCK = 4096
#: Whole numbers below this are exact in float64, and below the second in int64.
EXACT, LONG = 2**53, 2**63

Centroids = list[list[int]]


def _whole(raw: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers, however large; from 2^53 on x is whole by itself."""
    return np.array([[int(x) * scale if abs(x) >= EXACT else int(np.floor(x * scale)) for x in row] for row in raw.tolist()], dtype=object)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def nearest(raw: np.ndarray, centroids: Centroids, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, their vectors in whole numbers, the number of the nearest centroid (of equal ones the smallest), the squared distance.

    ``scale`` is a power of two, so that only numbers above 2^1000 can overflow when they are scaled; those count as beyond all bounds.
    """
    dims = raw.shape[1]
    reach = max((abs(v) for c in centroids for v in c), default=0)
    with np.errstate(over="ignore"):
        top = np.abs(np.floor(raw * scale)).max(axis=1, initial=0.0)
    fast, small = (top <= max(math.isqrt((limit - 1) // dims) - reach, -1) for limit in (EXACT, LONG))
    for kind, chosen in (("float", fast), ("int", small & ~fast), ("big", ~small)):
        rows = np.flatnonzero(chosen)
        for start in range(0, len(rows), BLOCK):
            at = rows[start : start + BLOCK]
            if kind == "big":
                x, c = _whole(raw[at], scale), np.array(centroids, dtype=object)
            else:
                of = np.float64 if kind == "float" else np.int64
                x, c = np.floor(raw[at] * scale).astype(of), np.array(centroids, dtype=of)
            d = _distances(x, c)
            near = np.argmin(d, axis=1)
            yield at, x, near, d[np.arange(len(at)), near]


def _sums(x: np.ndarray) -> list[int]:
    """Exact sums of columns: float64 and int64 hold whole numbers, whose sum over a block may need more than 64 bits."""
    if x.dtype == object:
        return [int(v) for v in x.sum(axis=0)]
    whole = x.astype(np.int64)
    high, low = whole >> 32, whole & 0xFFFFFFFF
    return [(int(h) << 32) + int(v) for h, v in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def _decoded(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("x")
    flat = np.frombuffer(column.buffers()[2], np.float64, len(column) * dims, column.offset * dims * 8) if len(column) else np.empty(0)
    return flat.reshape(-1, dims)


def _totals(kept: DataFrame, centroids: Centroids, dims: int, scale: int) -> dict[int, tuple[int, list[int], int]]:
    """For each centroid that has vectors: their number, their sum, their squared distances' sum."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, near, d in nearest(_decoded(batch, dims), centroids, scale):
                found = np.unique(near)
                own = [near == k for k in found]
                sums = pa.array([list(map(str, _sums(x[rows]))) for rows in own], pa.list_(pa.string()))  # digits: may need over 64 bits
                apart = pa.array([str(_sums(d[rows, None])[0]) for rows in own], pa.string())
                numbers = pa.array([int(rows.sum()) for rows in own], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), numbers, sums, apart], ["cluster", "n", "sums", "apart"])

    def add(total: dict, row) -> dict:
        return merge(total, {row.cluster: (row.n, [int(v) for v in row.sums], int(row.apart))})

    def merge(a: dict, b: dict) -> dict:
        for k, (n, sums, apart) in b.items():
            m, other, rest = a.get(k, (0, [0] * dims, 0))
            a[k] = (m + n, [u + v for u, v in zip(sums, other, strict=True)], apart + rest)
        return a

    parts = kept.select("x").mapInArrow(partial, "cluster int, n long, sums array<string>, apart string")
    return parts.rdd.treeAggregate({}, add, merge)


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return ~bad


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row.

    Kept are vectors of ``dims`` components, none null, NaN or infinite; others, null vectors among them, have no row. The first
    centroids are the ``k`` vectors (or all, if fewer) of smallest sha256 of "seed:id"; a null id has no digits there, and rows of equal ids are
    ordered by their vectors. Repeated rows count each. A distance, inertia or sum of distances beyond a 64-bit integer is null;
    centroids are right even then. An empty table gives no rows. Further columns are not read. ``scale`` is a power of two.
    Rounds end early when no centroid has moved, as later ones would repeat it.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == dims) & _finite(F.col("v")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.ascontiguousarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.float64)
            offsets = pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int32) * (dims * 8))
            x = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), x], ["vec_id", "x"])

    kept, _ = saved(rows.mapInArrow(packed, "vec_id long, x binary"), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(key, "v").limit(k).select("v").collect()
    centroids: Centroids = [_whole(np.array([r.v]), scale)[0].tolist() for r in first]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    for _ in range(rounds):
        totals = _totals(kept, centroids, dims, scale)
        moved = [[s // totals[i][0] for s in totals[i][1]] if i in totals else c for i, c in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    totals = _totals(kept, centroids, dims, scale)

    def held(n: int) -> int | None:
        return n if n < LONG else None

    inertia = held(sum(t[2] for t in totals.values()))
    within = [held(totals[i][2]) if i in totals else 0 for i in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for at, _, near, d in nearest(_decoded(batch, dims), centroids, scale):
                numbers = pa.array(near.astype(np.int32))
                distance = pa.array([held(int(v)) for v in d], pa.int64()) if d.dtype == object else pa.array(d.astype(np.int64))
                whole = pa.array([inertia] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), numbers, distance, pa.array(within, pa.int64()).take(numbers), whole, pa.array(digests).take(numbers)],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return kept.mapInArrow(assigned, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in DuckDB's SQL, a table for each round; for vectors whose sums fit its integers."""

    def near(i: int) -> str:
        return f"""
d{i} as materialized (select r, n, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{i} c using (i) group by r, n),
a{i} as materialized (select r, arg_min(n, (d, n)) as n, min(d) as d from d{i} group by r)"""

    def moved(i: int) -> str:
        return f"""
m{i} as (select a.n, v.i, sum(v.x) as s, count(*) as z from v join a{i} a using (r) group by a.n, v.i),
c{i + 1} as materialized (
  select c.n, c.i, coalesce(cast((m.s - ((m.s % m.z) + m.z) % m.z) // m.z as bigint), c.x) as x
  from c{i} c left join m{i} m using (n, i))"""

    steps = ",".join(f"{near(i)},{moved(i)}" for i in range(rounds))
    return f"""
with kept as materialized (
  select vec_id, embedding::double[] as e, row_number() over (order by sha256('{seed}:' || coalesce(vec_id::varchar, '')), embedding) as r
  from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}),
v as materialized (select r, i, cast(floor({scale} * e[i]) as bigint) as x from kept, range(1, {dims} + 1) t(i)),
c0 as materialized (select cast(r - 1 as integer) as n, i, x from v where r <= {k}),{steps},{near(rounds)},
digests as (select n, sha256(string_agg(x::varchar, ',' order by i)) as digest from c{rounds} group by n),
inertias as (select n, sum(d) as inertia from a{rounds} group by n)
select vec_id, a.n as cluster, cast(a.d as bigint) as distance, cast(w.inertia as bigint) as cluster_inertia,
  cast((select sum(d) from a{rounds}) as bigint) as inertia, g.digest as centroid_sha256
from kept join a{rounds} a using (r) join inertias w using (n) join digests g using (n)
"""


SQL = _sql()
