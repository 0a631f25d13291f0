"""Cluster driver, chains, line discovery and splits against plain loops."""

import random

import numpy as np
import pytest

from quillframe.operators import agglomerate as A
from quillframe.operators import chains, pages, splits


def greedy(v, threshold):
    """Founder of each image, one cluster at a time over all others, in the order of ids."""
    mean = {i: x.copy() for i, x in enumerate(v)}
    n, owner = dict.fromkeys(mean, 1), list(range(len(v)))
    opened, before = set(mean), -1
    while len(mean) != before:
        before, changed = len(mean), set()
        while opened:
            k = min(opened)
            opened.discard(k)
            take = [j for j in mean if j != k and np.linalg.norm(mean[j] - mean[k]) <= threshold]
            if take:
                total = n[k] + sum(n[j] for j in take)
                mean[k] = np.round((mean[k] * n[k] + sum(mean[j] * n[j] for j in take)) / total, 12)
                n[k] = total
                changed.add(k)
                for j in take:
                    del mean[j]
                    opened.discard(j)
                    changed.discard(j)
                    owner = [k if o == j else o for o in owner]
        opened = changed
    return owner


@pytest.mark.parametrize("slab", [2048, 7])
def test_cluster_driver_against_one_at_a_time(spark, monkeypatch, slab):
    monkeypatch.setattr(A, "SLAB", slab)
    r = np.random.default_rng(slab)
    centres = r.normal(size=(25, 6))
    v = np.concatenate([centres[r.integers(0, 25, 290)] + 0.12 * r.normal(size=(290, 6)), np.zeros((10, 6))])  # chains of near groups, and copies
    v = np.round(v[r.permutation(300)], 12)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    members, clusters = A.cluster_images(df, 0.4, 6)
    got = {x.id: x.clust for x in members.collect()}
    want = greedy(v, 0.4)
    assert 20 < len(set(want)) < 200 and [got[i] for i in range(300)] == want
    sizes = {x.clust: x.n for x in clusters.collect()}
    assert sizes == {k: want.count(k) for k in set(want)}
    empty, none = A.cluster_images(df.limit(0), 0.4, 6)
    assert empty.count() == 0 and none.count() == 0


def test_cluster_driver_of_a_dense_chain_takes_few_tables(spark, monkeypatch):
    v = np.round(np.arange(80)[:, None] * [0.35, 0.0] + [0.0, 1.0], 12)  # each within the threshold of the next, and ids run along it
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    made, stored = [], A.stored
    monkeypatch.setattr(A, "stored", lambda x, name: made.append(name) or stored(x, name))
    got = {x.id: x.clust for x in A.cluster_images(df, 0.4, 2)[0].collect()}
    assert [got[i] for i in range(80)] == greedy(v, 0.4)
    assert len(made) < 70  # a round for each cluster of the chain wrote five


@pytest.mark.parametrize("together", [100_000, 20])
def test_cluster_driver_over_slabs_and_large_groups(spark, monkeypatch, together):
    monkeypatch.setattr(A, "TOGETHER", together)
    monkeypatch.setattr(A, "PACK_LEAST", 10)
    monkeypatch.setattr(A, "PACK_MOST", 25)
    r = np.random.default_rng(8)
    centres = 3 * r.normal(size=(15, 20))
    v = np.round(np.concatenate([centres[r.integers(0, 15, 150)] + 0.1 * r.normal(size=(150, 20)), 3 * r.normal(size=(50, 20))]), 12)
    v = v[r.permutation(200)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    members, clusters = A.cluster_images(df, 0.6, 20)
    want = greedy(v, 0.6)
    assert 60 < len(set(want)) < 150
    assert {x.id: x.clust for x in members.collect()} == dict(enumerate(want))
    assert {x.clust: x.n for x in clusters.collect()} == {k: want.count(k) for k in set(want)}


def test_links_of_slabs_join_just_what_lies_near(spark, monkeypatch):
    monkeypatch.setattr(A, "PACK_LEAST", 16)
    monkeypatch.setattr(A, "PACK_MOST", 16)
    r = np.random.default_rng(5)
    v, opened = r.normal(size=(300, 4)), r.random(300) < 0.5
    df = spark.createDataFrame([(i, x.tolist(), bool(o)) for i, (x, o) in enumerate(zip(v, opened, strict=True))], "id long, v array<double>, open boolean")
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    for radius in (0.3, 0.6):
        want = list(range(300))
        for i, j in zip(*np.nonzero((d <= radius) & (opened[:, None] | opened[None])), strict=True):
            a, b = sorted((want[i], want[j]))
            want = [a if x == b else x for x in want]
        got = {x.id: x.least for x in A.loose_groups(A.Slabs(df, 300).links(radius)).collect()}
        assert got == {i: k for i, k in enumerate(want) if want.count(k) > 1}


def test_index_finds_all_within_the_radius(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    index = A.Index(df)
    for radius in (0.0, 0.2, 1.0, 10.0):
        got = {x.id: x.near for x in index.least_near(df, df, radius, True).collect()}
        assert got == {i: int(np.flatnonzero(d[i, :i] <= radius)[0]) for i in range(400) if (d[i, :i] <= radius).any()}


def test_forwarding_and_circles(spark):
    moves = spark.createDataFrame([("a", 5, 4), ("a", 4, 2), ("a", 2, 9), ("b", 4, 1), *[("c", k, k - 1) for k in range(1, 100)]], "g string, old long, new long")
    got = {(x.g, x.old): x.new for x in chains.forwarded(moves, ["g"]).collect()}
    assert got == {("a", 5): 9, ("a", 4): 9, ("a", 2): 9, ("b", 4): 1} | {("c", k): 0 for k in range(1, 100)}
    with pytest.raises(ValueError, match="circle"):
        chains.ROUNDS, rounds = 5, chains.ROUNDS
        try:
            chains.forwarded(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "old long, new long"), [])
        finally:
            chains.ROUNDS = rounds


def test_reading_chains_cut_loops(spark):
    links = [("line", 0, 1, 0), ("line", 1, 2, 3), ("line", 2, None, 9), ("loop", 3, 4, 1), ("loop", 4, 5, 2), ("loop", 5, 4, 3), ("circle", 7, 8, 5), ("circle", 8, 7, 4), ("alone", 1, None, 0), ("self", 1, 1, 0)]
    links += [("missed", 1, 3, 0), ("missed", 2, 3, 1), ("missed", 3, None, 2)]
    links += [("long", k, (k + 1) if k < 299 else 150, k) for k in range(300)]
    df = spark.createDataFrame(links, "g string, node long, next long, l long")
    got = {}
    for x in chains.reading_chains(df, ["g"]).orderBy("g", "pos").collect():
        assert x.pos == len(got.setdefault(x.g, []))
        got[x.g].append(x.node)
    assert got == {"line": [0, 1, 2], "loop": [3, 4, 5], "circle": [8, 7], "alone": [1], "self": [1], "missed": [1, 3], "long": list(range(300))}
    assert chains.reading_chains(df.limit(0), ["g"]).count() == 0


def test_repair_joins_boxes_and_numbers_anew(spark):
    parts = spark.createDataFrame([("p", 10, None, 20, 0, 1), ("p", 20, 10, 30, 2, 3), ("p", 30, 20, 40, 4, 5), ("p", 40, 30, None, 6, 7), ("q", 10, None, None, 0, 0)], "g string, id long, left long, right long, l int, r int")
    moves = spark.createDataFrame([("p", 30, 20), ("p", 20, 10)], "g string, old long, new long")
    got = sorted(map(tuple, chains.repaired(parts, moves, ["g"]).collect()))
    assert got == [("p", 1, None, 2, 0, 5, 3), ("p", 2, 1, None, 6, 7, 1), ("q", 1, None, None, 0, 0, 1)]


def test_four_nearest_against_pixels():
    r = np.random.default_rng(4)
    for _ in range(30):
        box = []
        for _ in range(12):  # boxes that don't overlap
            l, t = r.integers(0, 40, 2)  # noqa: E741
            w, h = r.integers(0, 8, 2)
            if all(l > x[2] or l + w < x[0] or t > x[3] or t + h < x[1] for x in box):
                box.append((l, t, l + w, t + h))
        box = np.array(box)
        page = np.full((60, 60), -1)
        for k, (l, t, right, b) in enumerate(box):  # noqa: E741
            page[t : b + 1, l : right + 1] = k
        near, gaps = pages.four_nearest(box)
        for k, (l, t, right, b) in enumerate(box):  # noqa: E741
            for side, lanes in ((pages.LEFT, [page[y, :l][::-1] for y in range(t, b + 1)]), (pages.RIGHT, [page[y, right + 1 :] for y in range(t, b + 1)]), (pages.TOP, [page[:t, x][::-1] for x in range(l, right + 1)]), (pages.BOTTOM, [page[b + 1 :, x] for x in range(l, right + 1)])):
                found = [(int(np.flatnonzero(x >= 0)[0]) + 1, i) for i, x in enumerate(lanes) if (x >= 0).any()]
                if not found:
                    assert near[k, side] == -1
                else:
                    gap, i = min(found)
                    lane = lanes[i]
                    assert gaps[k, side] == gap and near[k, side] == lane[gap - 1]


def test_lines_of_a_page():
    # two lines whose symbols differ in height, an i's dot above its line, and a far mark that no walk meets
    first = [(0, 2, 4, 9), (6, 4, 9, 9), (11, 4, 14, 12), (16, 2, 17, 9)]
    dot, second, alone = [(7, 1, 8, 2)], [(0, 20, 4, 27), (6, 22, 9, 27), (11, 20, 14, 30)], [(60, 40, 62, 42)]
    box = np.array(first + dot + second + alone)
    line = pages.page_lines(box)
    assert line[:4].tolist() == [line[0]] * 4 and line[5:8].tolist() == [line[5]] * 3 and len({line[0], line[5], line[8]}) == 3
    assert (pages.page_lines(np.zeros((0, 4), int)) == []).all()
    # the second line begins further left than what is above it; a box beyond its end on the same rows joins the nearest line
    box = np.array([(10, 0, 14, 3), (16, 0, 20, 3), (0, 10, 4, 13), (6, 10, 12, 13), (40, 11, 44, 12)])
    assert pages.page_lines(box).tolist() == [0, 0, 1, 1, 1]
    # circles of neighbours end
    assert pages.outermost(np.array([1, 0, 1])).tolist()[2] in (0, 1)


def test_images_of_frames_drop_what_goes_on_beyond_them():
    rows = ["ab cde  f", "", "xyz", "  long_one"]
    assert pages.cut_image(rows, (0, 0, 8, 0)) == ("##.###..#", "ab cde  f")
    assert pages.cut_image(rows, (1, 0, 5, 0)) == ("..###", "  cde")  # ab begins left of the frame
    assert pages.cut_image(rows, (0, 1, 3, 3)) == ("....\n###.\n....", "    \nxyz \n    ")


def plain_split(shape, known, least, cuts):
    if shape in known:
        return [shape]
    if cuts and len(shape) >= 2 * least:
        for w in range(least, len(shape) - least + 1):
            if shape[:w] in known and (rest := plain_split(shape[w:], known, least, cuts - 1)):
                return [shape[:w], *rest]
    return None


@pytest.mark.parametrize("cuts", [0, 1, 2, 4])
def test_splits_against_plain_recursion(spark, cuts):
    r = np.random.default_rng(5)
    word = lambda a, b: "".join(r.choice(list("abc")) for _ in range(r.integers(a, b)))
    known = sorted({word(2, 6) for _ in range(40)})
    shapes = sorted({word(1, 14) for _ in range(400)} | {"".join(r.choice(known) for _ in range(3)) for _ in range(50)})
    got = splits.split_shapes(spark.createDataFrame([(s, 2) for s in shapes], "shape string, n long"), spark.createDataFrame([(k,) for k in known], "shape string"), 2, cuts)
    assert {x.shape: x.pieces for x in got.collect()} == {s: plain_split(s, set(known), 2, cuts) for s in shapes}


@pytest.mark.parametrize("edge", [0, 1, 2])
def test_inner_shapes_are_split_until_none_is_left(spark, edge):
    r = np.random.default_rng(6)
    word = lambda a, b: "".join(r.choice(list("abcd")) for _ in range(r.integers(a, b)))
    counts = {word(2, 9): int(r.integers(1, 50)) for _ in range(300)}
    now = dict(counts)
    while True:
        new, split = {}, False
        for s, n in now.items():
            inside = [(-now[s[i : i + w]], s[i : i + w], i) for w in range(3, len(s)) for i in range(len(s) - w + 1) if s[i : i + w] in now]
            parts = [s]
            if inside:
                _, p, i = min(inside)
                parts, split = [p] + [x for x in (s[:i], s[i + len(p) :]) if len(x) > edge], True
            for x in parts:
                new[x] = new.get(x, 0) + n
        now = new
        if not split:
            break
    got = splits.refine_inner(spark.createDataFrame(list(counts.items()), "shape string, n long"), 3, edge)
    assert {x.shape: x.n for x in got.collect()} == now and len(now) < len(counts)
    assert splits.refine_inner(spark.createDataFrame([], "shape string, n long")).count() == 0


def test_words_are_linked_inside_their_text_as_by_joins(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quillframe.operators import raster, refine

    r = random.Random(9)
    texts = ["\n".join("".join(r.choice("ab  \t") for _ in range(r.randrange(40))) for _ in range(r.randrange(1, 9))) for _ in range(12)]
    docs = spark.createDataFrame([*enumerate(texts), (98, ""), (99, None)], "doc_id long, text string")
    w = raster.words(docs)
    rows = lambda df, *c: sorted(df.select(*c).collect(), key=lambda x: [(v is None, v) for v in x])
    columns = ("doc_id", "line", "word", "left_gap", "right_gap", "above", "below")
    assert rows(raster.neighbours_by_text(docs), *columns) == rows(raster.neighbours(w), *columns)
    assert rows(refine.assigned_by_text(docs, 2), "doc_id", "line", "word", "owner") == rows(refine.nearest_assigned(w, 2), "doc_id", "line", "word", "owner")
    by = Window.partitionBy("doc_id", "line").orderBy("word")
    parts = w.select("doc_id", "line", F.col("word").alias("id"), F.lag("word").over(by).alias("left"), F.lead("word").over(by).alias("right"), "l", "r")
    moves = parts.filter("left is not null and r - l < 2").select("doc_id", "line", F.col("id").alias("old"), F.col("left").alias("new"))
    want = chains.repaired(parts, moves, ["doc_id", "line"])
    docs.write.parquet(folder := f"{chains.stored.__globals__['shared_folder'](spark)}/linked/documents.parquet", mode="overwrite")
    got = chains._repair(spark, folder.removesuffix("/documents.parquet"))
    assert got.columns == want.columns and rows(got, *want.columns) == rows(want, *want.columns)


def test_links_of_a_text():
    with pytest.raises(ValueError):
        chains.resolved(np.array([1, 0]))
    assert chains.resolved(np.array([0, 0, 1, 2, 4])).tolist() == [0, 0, 0, 0, 4]
    assert chains.read_in_text(np.array([2, -1, 3, 2, 5, 4]), np.array([0, 4])).tolist() == [0, 2, 3, 4, 5]


def test_marks_are_joined_inside_their_text_as_by_joins(spark):
    from quillframe.operators import raster

    r = random.Random(12)
    texts = ["\n".join("".join(r.choice("ab   \t") for _ in range(r.randrange(50))) for _ in range(r.randrange(1, 30))) for _ in range(25)]
    docs = spark.createDataFrame([*enumerate(texts), (97, "\n \n"), (98, ""), (99, None)], "doc_id long, text string")
    got = raster.diacritics_by_text(docs)
    rows = lambda df: sorted(map(tuple, df.select(got.columns).collect()))
    assert rows(got) == rows(raster.diacritics(raster.lined(docs))) and any(x.parts > 2 for x in got.collect())
    docs.write.parquet(folder := f"{chains.stored.__globals__['shared_folder'](spark)}/marks/documents.parquet", mode="overwrite")
    plan = raster.QUERIES["diacritic_merge"][0](spark, folder.removesuffix("/documents.parquet"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("span", [2, 64])
def test_boxes_absorb_as_one_by_one(monkeypatch, span):
    from quillframe.operators import raster

    monkeypatch.setattr(raster, "SPAN", span)
    g = np.random.default_rng(span)
    for k in range(60):
        n = int(g.integers(0, 90))
        l, t = g.integers(0, 40, n), g.integers(0, 60, n)  # noqa: E741
        box = np.stack([l, t, l + g.integers(0, 9, n), t + g.integers(0, 5, n)], axis=1)
        box = box[np.argsort(t, kind="stable")] if k % 2 else box
        want, now, left = list(range(n)), box.tolist(), [True] * n
        for i in range(n):
            for j in range(n) if left[i] else ():
                (l, t, r, b), (x, y, z, w) = now[i], now[j]  # noqa: E741
                if j != i and left[j] and ((x >= l and z <= r) or (x <= l and z >= r)) and (abs(w - t) <= 5 or abs(y - b) <= 5 or (y >= t and w <= b) or (y <= t and w >= b)):
                    now[i], left[j] = [min(l, x), min(t, y), max(r, z), max(b, w)], False
                    want = [i if v == j else v for v in want]
                    break
        assert raster.absorbed(box, 5).tolist() == want


def test_components_come_in_small_batches(spark):
    import pyarrow as pa

    from quillframe.functions import rows
    from quillframe.operators import raster

    class Kept:
        schema = {"doc_id": type("F", (), {"dataType": type("T", (), {"simpleString": lambda self: "bigint"})()})()}

        def select(self, *c):
            return self

        def mapInArrow(self, f, schema):
            return list(f([pa.record_batch([pa.array(range(5000)), pa.array(["ab  c\nd"] * 5000)], names=["doc_id", "text"])]))

    got = raster.runs_components(Kept())  # one Arrow batch, which was one pandas frame
    assert sum(b.num_rows for b in got) == 10000 and max(b.num_rows for b in got) <= 2 * rows.TEXTS


def test_lines_of_a_long_page_and_images_that_words_leave():
    import time

    box = np.array([(c, 2 * row, c + 2, 2 * row) for row in range(20_000) for c in (0, 4)])
    began = time.process_time()
    assert (pages.page_lines(box) == np.repeat(np.arange(20_000), 2)).all()
    assert time.process_time() - began < 3  # a pass over all boxes for each line took longer
    r = random.Random(3)
    for _ in range(300):
        rows = ["".join(r.choice("ab \t\ré") for _ in range(r.randrange(14))) for _ in range(3)]
        left = r.randrange(10)
        right = left + r.randrange(8)
        image, truth = [], []
        for row in rows:
            keep = [False] * (right - left + 1)
            for m in pages._INK.finditer(row):
                if m.start() >= left and m.end() - 1 <= right:
                    keep[m.start() - left : m.end() - left] = [True] * len(m[0])
            image.append("".join(".#"[x] for x in keep))
            truth.append("".join(c if x else " " for c, x in zip(row[left : right + 1].ljust(right - left + 1), keep, strict=True)))
        assert pages.cut_image(rows, (left, 0, right, 2)) == ("\n".join(image), "\n".join(truth))


def test_windows_meet_shapes_without_their_symbols(spark):
    shapes = spark.createDataFrame([("xabcdy", 1), ("abcd", 5), ("bcdy", 5), ("abcdabcd", 2), ("aé😀bc", 1), ("é😀b", 9), ("qrstu", 3)], "shape string, n long")
    found = splits.inner_shapes(shapes, 3)
    assert sorted(map(tuple, found.collect())) == [("abcdabcd", "abcd", 1), ("aé😀bc", "é😀b", 2), ("xabcdy", "abcd", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan  # what is shuffled is a hash beside the shape
