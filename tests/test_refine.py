"""Refinement operators against plain loops and worked cases."""

import math
import random

import numpy as np
import pytest

from quillframe.operators import refine as R


def plain_merge(text, least=3, share=0.85):
    """Merging over one string of members between control symbols."""
    words = [["|".join(w) for w in line.split()] for line in text.split("\n")]
    while True:
        flat = [w.split("|") for line in words for w in line]
        members = [c for w in flat for c in w]
        options = []
        for b in set(members):
            before = [w[i - 1] for w in flat for i in range(1, len(w)) if w[i] == b and w[i - 1] != b]
            if not before:
                continue
            a = min(set(before), key=lambda x: (-before.count(x), x))
            f = before.count(a)
            if f >= least and f >= share * members.count(a) and f >= share * members.count(b):
                options.append((-members.count(b), b, a))
        if not options:
            return [[c for w in line for c in w.split("|")] for line in words]
        _, b, a = min(options)
        words = [[("|" + w + "|").replace("|", "||").replace(f"|{a}||{b}|", f"|{a}{b}|").replace("||", "|").strip("|") for w in line] for line in words]


@pytest.mark.parametrize("seed", range(60))
def test_merge_rounds(seed):
    r = random.Random(seed)
    parts = ["qu", "rn", "a", "e", "x", "ij", "abc", " ", " ", "\n"]
    text = "".join(r.choice(parts) for _ in range(r.randint(0, 160)))
    assert R.merge_rounds(text) == plain_merge(text)


def test_merge_cases():
    assert R.merge_rounds("qu qu qu u" + " u" * 2) == [["q", "u", "q", "u", "q", "u", "u", "u", "u"]]  # u has too many others
    assert R.merge_rounds("qu qu\nqu") == [["qu", "qu"], ["qu"]]
    assert R.merge_rounds("abc " * 3) == [["abc"] * 3]
    assert R.merge_rounds("q u q u q u") == [["q", "u"] * 3]  # nothing merges across a blank
    assert R.merge_rounds("") == [[]]


def plain_place(a, b):
    """Every offset by loops."""
    best = None
    for c in range(1 - a.shape[1], b.shape[1]):
        for r in range(1 - a.shape[0], b.shape[0]):
            dot = sum(a[i, j] * b[i + r, j + c] for i in range(a.shape[0]) for j in range(a.shape[1]) if 0 <= i + r < b.shape[0] and 0 <= j + c < b.shape[1])
            k = round(abs(dot - a.sum()), 12)
            if best is None or k < best[0]:
                best = (k, r, c, dot)
    return best[1:]


def _images(n=25):
    r = np.random.default_rng(3)
    return [np.round(r.random((r.integers(1, 6), r.integers(1, 6))), 2) for _ in range(n)]


def test_aligned_distances():
    im = _images()
    for a, b in zip(im, im[1:], strict=False):
        r, c, dot = plain_place(a, b)
        got = R.aligned(a, b)
        assert got[:2] == (r, c) and math.isclose(got[2], dot, abs_tol=1e-9)
        if a.shape != b.shape:
            d = math.sqrt(max(0, (a**2).sum() + (b**2).sum() - 2 * dot)) / min(a.size, b.size)
        else:
            d = math.sqrt(((a - b) ** 2).sum()) / a.size
        assert math.isclose(R.conv_euclid(a, b), d, abs_tol=1e-9)
    blank = np.zeros((0, 0))
    assert R.conv_euclid(blank, blank) == 0 and R.conv_euclid(blank, im[0]) == math.inf


@pytest.mark.parametrize("share,mean", [(1.0, False), (0.5, False), (0.7, True)])
def test_soft_hausdorff(share, mean):
    im = [x > 0.5 for x in _images()]
    for a, b in zip(im, im[1:], strict=False):
        if not a.any() or not b.any():
            assert R.soft_hausdorff(a, b) == (0 if a.any() == b.any() else math.inf)
            continue
        r, c, _ = plain_place(a.astype(float), b.astype(float))
        p = [(i + r, j + c) for i, j in np.argwhere(a).tolist()]
        q = [tuple(x) for x in np.argwhere(b).tolist()]
        way = lambda x, y: sorted(min(math.dist(u, v) for v in y) for u in x)[math.ceil(len(x) * share) - 1]
        both = way(p, q), way(q, p)
        assert math.isclose(R.soft_hausdorff(a, b, share, mean), sum(both) / 2 if mean else max(both))


def test_sub_hausdorff():
    r = np.random.default_rng(5)
    for _ in range(20):
        img, sub = r.random((7, 6)) > 0.7, r.random((3, 2)) > 0.5
        want = []
        s = [tuple(x) for x in np.argwhere(sub).tolist()]
        on = [tuple(x) for x in np.argwhere(img).tolist()]
        for y in range(5):
            for x in range(5):
                here = [(i - y, j - x) for i, j in on if y <= i < y + 3 and x <= j < x + 2]
                if here and s:
                    d = max(max(min(math.dist((i + y, j + x), o) for o in on) for i, j in s), max(min(math.dist(h, t) for t in s) for h in here))
                    if d <= 1:
                        want.append((y, x, d))
        assert R.sub_hausdorff(sub, img) == want
    assert R.sub_hausdorff(np.zeros((2, 2), bool), np.ones((3, 3), bool)) == []


def test_boxes(spark):
    b = spark.createDataFrame([(1, 0, 0, 0, 4), (1, 0, 1, 6, 6), (1, 0, 2, 8, 12), (1, 1, 0, 0, 0), (1, 1, 1, 2, 3)], "doc_id long, line int, word long, l int, r int")
    got = {(r.line, r.word): r.owner for r in R.nearest_assigned(b, 4).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 2, (1, 0): 0, (1, 1): 1}
    parts = sorted((r.line, r.word, r.part, r.l, r.r) for r in R.split_boxes(b, 3).collect())
    assert parts == [(0, 0, 0, 0, 2), (0, 0, 1, 3, 4), (0, 1, 0, 6, 6), (0, 2, 0, 8, 10), (0, 2, 1, 11, 12), (1, 0, 0, 0, 0), (1, 1, 0, 2, 3)]


def test_searches_give_what_single_pairs_give(spark):
    from quillframe.functions.stored import stored
    from quillframe.operators import vectors as V

    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in np.where(rng.random(64) < 0.2, rng.random(64), 0)], 0) for i in range(52)]
    rows.append((52, rows[3][1], 0))
    img = stored(V.images(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "images")
    at = {i: np.array(v).reshape(8, 8) for i, v, _ in rows}
    cut = lambda i: R.crop(np.where(at[i] >= 0.2, at[i], 0.0))
    pairs = [(q, i) for q in (0, 50) for i in at if i != q]
    got = {(r.q_id, r.id): r.d for r in R.cropped_search(img, R.conv_euclid, 0.2).collect()}
    assert got == {(q, i): pytest.approx(R.conv_euclid(cut(q), cut(i)), abs=1e-9) for q, i in pairs}
    got = sorted(tuple(r) for r in R.sub_search(img, 0.2, 4, 3.0).collect())
    assert got == sorted((q, i, r, c, round(d, 9)) for q, i in pairs for r, c, d in R.sub_hausdorff(at[q][:4, :4] >= 0.2, at[i] >= 0.2, 3.0))


def test_searches_without_a_query_find_nothing(spark):
    from quillframe.operators import vectors as V

    img = V.images(spark.createDataFrame([(1, [1.0] * 64, 0), (2, [0.5] * 64, 0)], "vec_id long, embedding array<double>, label int"))
    for found in (V.euclid_search(img), V.euclid_search(img, 3), V.hamming_search(img), V.hausdorff_search(img), R.cropped_search(img, R.conv_euclid, 0.2), R.sub_search(img, 0.2, 4, 1.0)):
        assert found.collect() == []
