import numpy as np
import pyarrow.parquet as pq
import pytest

from quillframe.llm import forest as C


def plain(rows, asked, nearest=5):
    """query_id, rank, vec_id and score by brute force; rows of one query in place of each other keep their order."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, x) in enumerate(good):
        if asked(i):
            near = sorted((-(x @ y) / np.sqrt((x @ x) * (y @ y)), j) for b, (j, y) in enumerate(good) if a != b and len(y) == len(x))
            out += [(i, k, j, round(-s, 9)) for k, (s, j) in enumerate(near[:nearest], 1)]
    return sorted(out)


def _odd():
    r = np.random.default_rng(1)
    f = lambda x: [float(np.float32(a)) for a in x]
    rows = [(i, f(r.normal(size=64))) for i in range(150)]
    hub = r.normal(size=64)
    rows += [(200 + i, f(hub)) for i in range(120)]  # copies
    rows += [(400 + i, f(hub + 0.05 * r.normal(size=64))) for i in range(60)]
    rows += [(50, rows[0][1]), (100, rows[100][1]), (None, rows[1][1]), (500, None), (550, []), (600, [0.0] * 64), (650, [1.0] * 63 + [None]), (700, [1.0] * 63 + [float("nan")]), (750, [float("inf")] * 64)]
    rows += [(800, [1.0, 2.0]), (801, [2.0, 1.0]), (850, [1.0, 2.0, 3.0])]
    return rows


@pytest.mark.parametrize("part", [400_000, 500])
def test_rows_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(C, "PART", part)
    monkeypatch.setattr(C, "BLOCK", 4096 if part > 500 else 40)
    monkeypatch.setattr(C, "PAIRS", 2_000_000 if part > 500 else 1000)
    rows = _odd()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, node string").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in C.search(df, "vec_id % 50 = 0", wanted=10**6).collect())
    assert got == plain(rows, lambda i: i % 50 == 0)
    # what is found without taking every row, has true scores in order, and is nearly all of it
    some = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in C.search(df, "vec_id % 50 = 0").collect())
    assert len(set(some) & set(got)) >= 0.9 * len(got)
    assert C.search(df.limit(0)).collect() == [] and C.search(df, "vec_id < 0").collect() == []


def test_one_and_two_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert C.search(one).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e200, 1e200])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in C.search(two).collect()] == [(0, 1, 1, round(0.5**0.5, 12))]


def test_strings_share_longer_prefixes_with_nearer_vectors():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 64)).astype(np.float32)
    near, far = x + 0.3 * r.normal(size=x.shape).astype(np.float32), r.normal(size=x.shape).astype(np.float32)
    shared = []
    for y in (near, far):
        n = []
        for t in range(4):
            tree = C.Tree(64, t)
            apart = tree.strings(x) ^ tree.strings(y)
            n.append(np.mean([tree.bits - int(a).bit_length() for a in apart]))
        shared.append(np.mean(n))
    assert shared[0] > 3 * shared[1]
    bits, levels = C.ladder(64)
    assert bits == C.Tree(64, 0).bits == levels[0] <= 62 and levels[-1] == 0 and (np.diff(levels) < 0).all()


def test_recall_of_the_query_on_whole_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}/embeddings.parquet"
        t = pq.read_table(path).to_pydict()
        want = {(i, j): s for i, _, j, s in plain(list(zip(t["vec_id"], t["embedding"], strict=True)), lambda i: i % 50 == 0)}
        got = C.search(spark.read.parquet(path)).collect()
        assert len(got) == len(want)
        assert sum((r.query_id, r.vec_id) in want for r in got) >= 0.97 * len(want)
        assert all(abs(want.get((r.query_id, r.vec_id), r.score) - r.score) < 1e-9 for r in got)
