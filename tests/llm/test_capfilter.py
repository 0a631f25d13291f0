import numpy as np
import pandas as pd
import pyarrow.parquet as pq

from quillframe.llm import capfilter as C


def plain(rows, threshold):
    """n_links and component of each row by brute force."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, comp = {i: 0 for i in range(len(rows))}, {i: rows[i][0] for i in range(len(rows))}
    near = {i: [] for i in good}
    for i in good:
        for j in good:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].append(j)
    for i in good:
        n[i] = len(near[i])
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min(rows[j][0] for j in seen)
    return n, comp


def _fixture():
    r = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        x = r.normal(size=64)
        rows += [x + r.normal(size=64) * r.choice([0, 0.15, 0.25]) for _ in range(r.integers(1, 6))]
    rows = [[float(np.float32(a)) for a in x] for x in rows]
    rows += [rows[0], rows[0], None, [], [0.0] * 64, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [float("inf")] * 64, [1.0, 2.0], [2.0, 4.0]]
    return [(1000 - i, x) for i, x in enumerate(rows)] + [(None, rows[0])]


def test_list_decoding_is_exact():
    r = np.random.default_rng(2)
    for blocks in (1, 2, 3):
        c = C.ProductCode(30, blocks, 7, 0)
        x = r.normal(size=(50, 30))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        row, direction = c.decode(x, 0.3)
        y = x @ c.rotation
        want = set()
        for d in range(7**blocks):
            w, k = [], d
            for _ in range(blocks):
                w.append(k % 7)
                k //= 7
            u = np.concatenate([b[:, i] for b, i in zip(c.books, w[::-1], strict=True)])
            want |= {(int(i), d) for i in np.flatnonzero(y @ u >= 0.3)}
        assert set(zip(row.tolist(), direction.tolist(), strict=True)) == want


def test_recall_at_the_threshold():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    z = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = np.zeros(len(x), bool)
    for k in range(4):
        c = C.ProductCode(64, 2, 256, k)
        a, b = (set(zip(*map(np.ndarray.tolist, c.decode(v, 0.43)), strict=True)) for v in (x, z))
        met[[i for i, _ in a & b]] = True
    assert met.mean() >= 0.98


def test_rows_against_brute_force(spark, monkeypatch):
    rows = _fixture()
    n, comp = plain(rows, 0.95)
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, n_links int")
    for hot in (4096, 3):
        monkeypatch.setattr(C, "HOT", hot)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in C.near_duplicates(df).collect()}
        want = {k: (n[i], comp[i], None if k is None else k == comp[i]) for i, (k, _) in enumerate(rows)}
        assert got == want
    assert C.near_duplicates(df.limit(0)).count() == 0


def test_sketches_stay_within_reach():
    r = np.random.default_rng(4)
    x, y = r.normal(size=(2, 20000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    z = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    planes = np.random.default_rng([4, 64]).normal(size=(64, C.SKETCH))
    assert ((x @ planes > 0) != (z @ planes > 0)).sum(1).max() <= C.reach(0.95) < C.SKETCH / 3


def test_recall_of_the_query_against_all_pairs(spark):
    """All vectors of sf0.1, with one more at a cosine of 0.95 to 0.96 beside each, by brute force over every pair in blocks."""
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    x = np.array([v for v in t["embedding"] if v and all(a is not None and np.isfinite(a) for a in v) and any(v)], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = np.random.default_rng(5)
    y, c = r.normal(size=x.shape), r.uniform(0.95, 0.96, (len(x), 1))
    y -= (x * y).sum(1, keepdims=True) * x
    x = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)])
    n = np.concatenate([(x[at : at + 1024] @ x.T >= 0.95).sum(1) - 1 for at in range(0, len(x), 1024)])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = {k.vec_id: k.n_links for k in C.near_duplicates(df).collect()}
    assert all(got[i] <= k for i, k in enumerate(n.tolist()))
    print("recall", sum(got.values()) / n.sum())
    assert sum(got.values()) >= 0.99 * n.sum() > 0
