import random
import re

import numpy as np
import xxhash

from quillframe.llm import simhash as S


def plain_fingerprint(text, k=4):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_labels(codes, radius):
    n = len(codes)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if bin(int(codes[i]) ^ int(codes[j])).count("1") <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def _codes(r, n):
    out = set()
    while len(out) < n:
        c = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            out.add(c)
            for _ in range(r.randint(1, 6)):
                c ^= 1 << r.randrange(64)
    return np.array(sorted(out), np.uint64)


def test_fingerprints():
    r = random.Random(5)
    for t in ["", " \n", "One two", "É B c d e", *(" ".join(r.choice("abc De\x0bfÉ ") for _ in range(r.randint(1, 90))) for _ in range(60))]:
        assert S.fingerprint(t)[0] == plain_fingerprint(t)
        assert S.fingerprint(t, lanes=3)[0] == plain_fingerprint(t)


def test_tree_against_all_pairs():
    r = random.Random(6)
    for n in (2, 17, 300):
        codes = _codes(r, n)
        codes = codes[np.argsort(S.gray_rank(codes))]
        assert S.join_tree(codes[:, None], 4).tolist() == plain_labels(codes, 4)
    for n in (40, 300):
        codes = np.stack([_codes(r, n)[:n], _codes(r, n)[:n]], axis=1)
        codes[n // 2 :] = codes[: n - n // 2] ^ np.uint64(5)
        codes = codes[S.gray_order(codes)]
        assert S.join_tree(codes, 40).tolist() == plain_labels([int(a) << 64 | int(b) for a, b in codes], 40)


def test_gray_order_is_that_of_the_whole_code():
    r = random.Random(9)
    codes = np.array([[r.getrandbits(64), r.getrandbits(64)] for _ in range(200)], np.uint64)

    def rank(c):
        x, s = int(c[0]) << 64 | int(c[1]), 1
        while s < 128:
            x ^= x >> s
            s *= 2
        return x

    assert [rank(codes[i]) for i in S.gray_order(codes)] == sorted(map(rank, codes))


def test_every_close_pair_shares_an_upper_node():
    r = random.Random(7)
    for radius, count in ((4, 10), (4, 10_000), (4, 10**6), (3, 10**7), (4, 10**9), (4, 10**12)):
        made = S.masks_for(count, radius)
        assert all(m.bit_count() == made[0].bit_count() for m in made) and count / 2 ** made[0].bit_count() <= max(S.NODE[0], count / 2**32)
        for _ in range(500):
            d = sum(1 << b for b in r.sample(range(64), radius))
            assert any(d & m == 0 for m in made)


def test_upper_nodes_are_searched_in_gray_order(spark, monkeypatch):
    """The production query hands groups of some hundred fingerprints to the tree, and the tree prunes pairs of groups."""
    r = random.Random(13)
    codes = _codes(r, 6000)
    sizes, pruned = [], [0, 0]

    class Counted(S.Tree):
        def apart(self, level, i, j):
            out = super().apart(level, i, j)
            pruned[0] += int((out > 4).sum())
            pruned[1] += len(out)
            return out

    monkeypatch.setattr(S, "Tree", Counted)
    signed = codes.view(np.int64)
    for m in S.masks_for(len(codes), 4):
        upper = codes & np.uint64(m)
        for u in np.unique(upper):
            own = codes[upper == u]
            sizes.append(len(own))
            S.join_tree(own[S.gray_order(own[:, None])][:, None], 4)
    assert np.mean(sizes) > 100 and pruned[0] > 0.4 * pruned[1]
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(signed)], "doc_id long, f0 long")
    label = np.arange(len(codes))
    for i in range(len(codes)):
        near = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 4)
        S.merge(label, np.full(len(near), i), near)
    assert {x.f0: x.component_id for x in S.linked(rows).collect()} == dict(zip(signed.tolist(), label.tolist(), strict=True))


def test_rows(spark, monkeypatch):
    r = random.Random(8)
    codes = [int(c) for c in _codes(r, 250)]
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)] + [(900, 0), (901, 0), (None, 0)]
    want = plain_labels(codes + [0], 4)
    for hot in (20_000, 7):
        monkeypatch.setattr(S, "HOT", hot)
        got = {x.f0: x.component_id for x in S.linked(spark.createDataFrame(rows, "doc_id long, f0 long")).collect()}
        smallest = {}
        for i, c in enumerate(codes + [0]):
            smallest.setdefault(want[i], 900 if i == len(codes) else i)
        assert got == {(c - (1 << 64) if c >> 63 else c): smallest[want[i]] for i, c in enumerate(codes + [0])}


def test_texts(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    rows = [(5, base, 1), (3, base.upper(), 2), (3, base.upper(), 2), (9, None, 3), (8, " \t", 4), (None, base, 5), (7, "other words here", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(((x.doc_id is None, x.doc_id, x.component_id) for x in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([(False, 5, 3), (False, 3, 3), (False, 3, 3), (False, 9, 8), (False, 8, 8), (True, None, 3), (False, 7, 7)], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0


def _edited(r, words, share):
    out = list(words)
    for _ in range(int(len(words) * share)):
        out[r.randrange(len(out))] = "new%d" % r.randrange(10**6)
    return out


def test_similar_texts(spark):
    r = random.Random(10)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near = [], 0
    for k in range(60):
        w = ["w%d" % r.randrange(10**6) for _ in range(300)]
        rows.append((10 * k, " ".join(w)))
        for j in range(1, 3):
            e = _edited(r, w, 0.012)
            a, b = shingles(w), shingles(e)
            assert len(a & b) / len(a | b) >= 0.8
            rows.append((10 * k + j, " ".join(e)))
        half = w[:150] + ["w%d" % r.randrange(10**6) for _ in range(150)]
        rows.append((10 * k + 5, " ".join(half)))
    df = spark.createDataFrame([(*x, 1) for x in rows] + [(None, "w", 1)], "doc_id long, text string, f0 int")
    kept = {x.doc_id for x in S.one_each(df).collect()}
    clean = {i for i, _ in rows if i % 10 in (0, 5)}
    assert clean <= kept and None in kept
    assert len(kept - clean - {None}) <= 6  # recall of 0.95 of 120 copies
    assert S.one_each(df.limit(0)).count() == 0
    assert sorted((x.doc_id, x.text) for x in S.one_each(spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "")], "doc_id long, text string")).collect()) == [(1, "a"), (2, None)]


def _similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_families_under_the_similarity_stay(spark):
    r = random.Random(11)
    word = lambda: "w%d" % r.randrange(10**6)
    rows, at = {}, 0
    for new in (0.12, 0.15, 0.18, 0.21, 0.25):  # similarities from 0.6 to 0.79: a shared passage, and a tail of its own
        shared = [word() for _ in range(round(300 * (1 - new)))]
        family = [shared + [word() for _ in range(300 - len(shared))] for _ in range(25)]
        assert 0.59 < _similarity(*family[:2]) < 0.8
        for w in family:
            rows[at] = " ".join(w)
            at += 1
    copy = rows[7].split()
    copy[150] = word()
    assert _similarity(rows[7].split(), copy) >= 0.8
    rows[1000] = " ".join(copy)
    for i in (2000, 2001):  # a repeated line gives equal fingerprints of occurrences, not of sets
        rows[i] = " ".join(["one line that is repeated here"] * 400 + [word() for _ in range(60)])
    df = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    assert {x.doc_id for x in S.one_each(df).collect()} == set(rows) - {1000}


def test_sets_against_all_pairs(spark, monkeypatch):
    r = random.Random(12)
    texts = []
    for _ in range(12):
        w = ["w%d" % r.randrange(10**6) for _ in range(r.choice([4, 6, 60, 120]))]
        texts += [_edited(r, w, r.choice([0, 0.01, 0.03, 0.05])) for _ in range(8)]
    sets = [S.shingles(" ".join(w), 5) for w in texts] + [S.shingles("", 5)]
    n = len(sets)
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(i):
                both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
        if not _:
            first = list(label)
        elif label == first:
            break
        first = list(label)
    same = lambda x: [[a == b for b in x] for a in x]
    assert same(S.join_sets(sets, 0.8).tolist()) == same(label)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for most in (1000, 3):
        monkeypatch.setattr(S, "SETS", most)
        got = {x.doc_id: x.component_id for x in S.similar(df, **S.SIMILAR).collect()}
        assert [got[i] for i in range(n - 1)] == label[:-1]


def test_recall_at_the_similarity(spark):
    """Pairs of a Jaccard similarity of exactly 0.8: nine in ten at least are found."""
    r = random.Random(14)
    word = lambda: "w%d" % r.randrange(10**7)
    rows, pairs = {}, 160
    for k in range(pairs):
        n = r.choice([90, 180, 360, 720])  # shingles of a text; 8 n / 9 shared of 10 n / 9 are 0.8
        w = [word() for _ in range(n + 4)]
        new = n // 9 - 4 if k % 2 else n // 9  # a passage inside, which takes four more shingles with it, or at the end
        at = r.randrange(4, n - new) if k % 2 else n + 4 - new
        e = [*w[:at], *(word() for _ in range(new)), *w[at + new :]]
        assert _similarity(w, e) == 0.8
        rows[2 * k], rows[2 * k + 1] = " ".join(w), " ".join(e)
    kept = {x.doc_id for x in S.one_each(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")).collect()}
    assert set(range(0, 2 * pairs, 2)) <= kept
    assert len(kept) - pairs <= 0.1 * pairs
    meets = lambda count: 1 - (1 - (1 - S.differing(0.8)) ** S.factored_for(count, 4)) ** len(S.drawn_for(count, 4, 0.8))
    assert all(meets(c) >= 0.998 for c in (10, 10**4, 10**6, 10**9))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2, 3, 4), (2, "a b", 1, 2, 3, 4), (2, "a b", 1, 2, 3, 5), (3, "c", 1, 2, 3, 4)], "doc_id long, text string, _n int, _kept int, __kept int, _k int")
    assert sorted(tuple(x) for x in S.one_each(df).collect()) == [(1, "a b", 1, 2, 3, 4), (3, "c", 1, 2, 3, 4)]


def test_rows_that_share_a_key_stay_apart(spark):
    r = random.Random(15)
    a, b = (" ".join("w%d" % r.randrange(10**6) for _ in range(60)) for _ in range(2))
    of = lambda rows: sorted((x.doc_id, x.text) for x in S.one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert of([(7, a), (7, b)]) == sorted([(7, a), (7, b)])
    assert of([(3, a), (7, a), (7, b)]) == [(3, a), (7, b)]
    assert of([(7, a), (7, b), (8, b), (7, a)]) == sorted([(7, a), (7, b)])


def test_chains_under_the_similarity_are_not_fetched(spark, monkeypatch):
    """Texts that each overlap the next by a similarity of 0.6 are one loose component, which finer prints take apart; a copy at its end is found."""
    r = random.Random(16)
    w = ["w%d" % r.randrange(10**7) for _ in range(75 * 404)]
    rows = [(i, " ".join(w[75 * i : 75 * i + 304])) for i in range(400)]
    assert 0.59 < _similarity(rows[0][1].split(), rows[1][1].split()) < 0.61
    rows.append((1000, rows[399][1] + " more"))
    held, real = {}, S.written

    def spy(df, name):
        out = real(df, name)
        held.setdefault(name, out)
        return out

    monkeypatch.setattr(S, "written", spy)
    monkeypatch.setattr(S, "SETS", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in S.similar(df, **S.SIMILAR).collect()}
    assert got == {i: i for i in range(400)} | {1000: 399}
    assert held["sizes"].agg({"count": "max"}).first()[0] > 20
    assert held["asked"].count() < 60
