import hashlib

import duckdb
import numpy as np
import pytest

from quillframe.llm import centroids as C


def plain(rows, k, rounds, size):
    """cluster, distance, inertias and digest of each kept row by Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    q = [[(n * 64) // d for n, d in map(float.as_integer_ratio, v)] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"1:{kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    c = [q[j] for j in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        own = [nearest(x)[1] for x in q]
        for j in range(len(c)):
            mine = [x for x, o in zip(q, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [nearest(x) for x in q]
    total = {j: sum(d for d, o in found if o == j) for j in range(len(c))}
    cut = lambda x: min(x, C.MOST)
    sums = {j: sum(cut(d) for d, o in found if o == j) for j in total}
    return sorted(((i, j, cut(d), cut(sums[j]), cut(sum(sums.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found, strict=True)), key=repr)


def _odd(size=64):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=size) * r.choice([0.01, 1])]) for i in range(120)]
    rows += [(200, rows[0][1]), (200, rows[1][1]), (3, rows[3][1]), (None, rows[4][1]), (None, rows[5][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [1.0] * 63 + [float("nan")]), (305, [float("-inf")] * 64), (306, [0.0] * 64), (307, [-0.0] * 64), (308, [-1e-30] * 64)]
    return rows


@pytest.mark.parametrize("wide", [False, True])
def test_against_plain_integers(spark, wide):
    rows = _odd()
    if wide:  # products that overflow float32, sums beyond 64 bits
        rows += [(400, [3e38] * 64), (401, [-3e38] * 64), (402, [1e15] * 32 + [-1e15] * 32), (403, [3e5] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, C.cluster(df).collect()), key=repr)
    assert got == plain(rows, 16, 3, 64)


def test_few_rows_and_none(spark):
    rows = [(5, [0.5, -0.5]), (6, [0.5, -0.5]), (7, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, C.cluster(df, size=2).collect()), key=repr) == plain(rows, 16, 3, 2)
    assert C.cluster(df.limit(0), size=2).collect() == []
    assert C.cluster(df, size=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_screen_never_loses_the_nearest():
    r = np.random.default_rng(2)
    for spread in (3, 1000, 10**6, 2**24):
        c = r.integers(-spread, spread, (16, 64))
        c[5] = c[9]
        q = np.concatenate([r.integers(-spread, spread, (300, 64)), (c[:8] + c[8:]) // 2, c])
        d = ((q[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        near = C.screen(q, c)
        want = np.array([min(range(16), key=lambda j: (x[j], j)) for x in d])
        assert near[np.arange(len(q)), want].all()
        assert (C.assign(q, c) == want).all()
    # products of small vectors are nearly exact: most rows need no exact distances
    q, c = r.integers(-60, 60, (2000, 64)), r.integers(-60, 60, (16, 64))
    assert (C.screen(q, c).sum(axis=1) == 1).mean() > 0.95


def test_limbs():
    for x in (0, 1, -1, 2**40, -(2**40) - 7, 2**200 + 3, -(3**90)):
        assert sum(v << (C.LIMB * k) if v >= 0 else -((-v) << (C.LIMB * k)) for k, v in C._limbs(x)) == x


def test_sql(spark):
    c = duckdb.connect()
    c.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    got = sorted(map(tuple, C.cluster(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()))
    assert got and got == sorted(c.execute(C.sql()).fetchall())
