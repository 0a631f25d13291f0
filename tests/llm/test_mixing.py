import math
import random
import re

from quillframe.llm import mixing as M

WEIGHTS = (3, 1, 2)


def plain_targets(size, total, most):
    """By the rule's words: share, stop, share the excess again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), total * sum(size.values())
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * w[s]
            if target[s] >= most * size[s]:
                left += target[s] - most * size[s]
                target[s] = most * size[s]
                open_.discard(s)
    return target


def _rows(r, n=900):
    out = [(i, r.choice([None, "", "a", "b", "B", "é", "z"]) if r.random() < 0.6 else "hot", " ".join(["w"] * int(r.paretovariate(0.9) * 3 % 400))) for i in range(n)]
    return [*out, (5000, "void", ""), (5001, "void", None), (None, "a", "x y"), (7, "a", "x y z")]


def test_against_the_rule(spark):
    rows = _rows(random.Random(4))
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, source string, text string, size int")
    got = M.query(df).collect()
    assert len(got) == len(rows)
    again = M.query(df.repartition(3)).collect()
    order = lambda x: (x.doc_id or 0, x.size, x.taken)
    assert sorted(map(order, got)) == sorted(map(order, again))
    size, largest = {}, {}
    for _, s, t in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        size[s] = size.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    want = plain_targets(size, 1.5, 2)
    source = {i: s for i, s, _ in rows if i is not None and i != 7}
    taken = {}
    for x in got:
        assert x.taken <= 2 * x.size and x.copies in (0, 1, 2)
        if x.doc_id in source:
            s = source[x.doc_id]
            assert x.source_size == size[s] and math.isclose(x.target, want[s], rel_tol=1e-9)
            taken[s] = taken.get(s, 0) + x.taken
    for s in taken:
        assert abs(taken[s] - want[s]) <= largest[s] + 8, s


def test_dual_solution(spark):
    rows = _rows(random.Random(5))
    got = M.query(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by = {}
    for x in got:
        if x.size and x.source_size:
            by.setdefault((x.source_size, x.target), []).append(x)
    for (total, target), own in by.items():
        assert abs(sum(x.rate * x.size for x in own) / target - 1) < 1e-6
        free = [math.log(x.rate) / x.size for x in own if x.rate < 2]
        assert not free or max(free) - min(free) < 1e-9 + 1e-6 * abs(free[0])


def test_rows(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (2, None, None), (3, "b", "long " * 50_000)] + [(i, "b", "w w") for i in range(10, 60)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, source string, text string, copies int")
    mixed = M.mix(df).collect()
    assert M.mix(df).columns == df.columns
    taken = {(x.doc_id, x.copies): x.copies for x in M.query(df).collect()}
    assert sum(1 for r in mixed if r.doc_id == 1) == sum(x.copies for x in M.query(df).collect() if x.doc_id == 1)
    assert taken and M.query(df.limit(0)).count() == 0 and M.mix(df.limit(0)).count() == 0


def test_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 10)
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * 5) for i in range(400)], "doc_id long, source string, text string")
    got = M.query(df).collect()
    for s in (0, 1):
        own = [x for x in got if x.doc_id % 2 == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 10
