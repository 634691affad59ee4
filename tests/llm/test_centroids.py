import hashlib
import math
import random

import pytest

from factloom.llm import centroids


def whole(vector, scale=1024):
    return [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in vector]


def plain(rows, k=8, rounds=10, dims=64):
    """Rows of (vec_id, vector) to rows of the result, in Python's integers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    xs = [whole(v) for _, v in kept]
    cs = xs[:k]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cs)) for x in xs]

    for _ in range(rounds):
        near = [n for _, n in assigned()]
        cs = [[sum(col) // near.count(n) for col in zip(*(x for x, m in zip(xs, near, strict=True) if m == n), strict=True)] if n in near else c for n, c in enumerate(cs)]
    found = assigned()

    def held(n):
        return n if n < 2**63 else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((repr((i, n, held(d), held(sum(e for e, m in found if m == n)), held(sum(e for e, _ in found)), digests[n])) for (i, _), (d, n) in zip(kept, found, strict=True)))


def got(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as x", "2 as cluster", "3 as v").repartition(5)
    return sorted(repr(tuple(r)) for r in centroids.cluster(df, **how).collect())


def vectors(n, size, seed):
    random.seed(seed)
    import struct

    return [(i, [struct.unpack("f", struct.pack("f", random.gauss(0, size)))[0] for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize("size", [0.2, 3e4, 1e6, 1e12, 1e30])  # float64, both, 64-bit integers, Python's integers
def test_rounds_equal_plain_ones(spark, size):
    rows = vectors(150, size, 5) + vectors(20, 0.2, 6)
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = vectors(1, 1, 7)[0][1]
    odd = [(None, one), (None, [2 * x for x in one]), (7, None), (8, []), (9, one[:63]), (10, [*one, 1.0]), (11, [None, *one[1:]]), (12, [nan, *one[1:]]), (13, [-inf, *one[1:]])]
    ties = [(20, [0.0] * 64), (21, [0.0] * 64), (21, [0.0] * 64), (22, [-0.0] * 64), (23, [0.5] + [0.0] * 63), (24, [-0.5] + [0.0] * 63)]
    rows = odd + ties + vectors(30, 1, 8)
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:3] + ties[:2]) == plain(rows[:3] + ties[:2])  # fewer than the centroids
    assert got(spark, odd[2:]) == [] and got(spark, []) == []
    large = [(1, [1.7e308] * 64), (2, [-1.7e308] * 64), (3, [1e16 + 2] * 64), (4, [0.1] * 64)]
    assert got(spark, large, kind="double") == plain(large)


def test_other_sizes(spark):
    rows = [(i, v[:3]) for i, v in vectors(60, 2, 9)]
    assert got(spark, rows, k=3, rounds=4, dims=3) == plain(rows, k=3, rounds=4, dims=3)
