"""Worked examples, degenerate inputs and invariants of the operators."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import components, decode, evaluate, gaps, lexicon, matching, raster, vectors
from quillframe.sources import tables


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_worked_examples(spark):
    x = spark.createDataFrame([("sassy",), ("aba",)], "w string").select(T.numerized(F.col("w")).alias("s")).collect()
    assert [r.s for r in x] == ["1.2.1.1.3", "1.2.1"]
    c = spark.createDataFrame([("A",), ("g",), (".",), ("a",)], "c string").select(T.symbol_class(F.col("c")).alias("k")).collect()
    assert [r.k for r in c] == [1, 2, 3, 0]
    o = spark.createDataFrame([(5, 9), (0, 5), (-5, 0), (0, 0)], "a int, d int").select(T.offset_class(F.col("a"), F.col("d")).alias("k")).collect()
    assert [r.k for r in o] == [1, 2, 3, 0]
    s = lexicon.symbol_stream(_docs(spark, "a b"), "doc_id").first()
    assert s.stream == "a _ b "
    h = spark.createDataFrame([(i + 1, n) for i, n in enumerate([1, 5, 2, 1, 3, 6, 2, 1])], "gap int, n long")
    assert gaps.second_peak(h).first().width == 5
    assert gaps.second_peak(h.withColumn("n", F.lit(3))).first().width == 9


def test_distances(spark):
    rows = [(0, [1.0, 0.0, 0.0, 1.0], 0), (1, [1.0, 1.0, 0.0, 0.0], 0)]
    p = vectors.searched(vectors.images(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    assert vectors.euclid(p).first().d == pytest.approx(math.sqrt(2) / 4, abs=1e-9)
    assert vectors.hamming(p).first().d == 0.5


def test_degenerate_texts(spark):
    d = _docs(spark, "", "\n\n", "a", "  x  ", "nospaces", "w" * 40, None)
    assert {r.word for r in lexicon.word_counts(d).collect()} == {"a", "x", "nospaces", "w" * 40}
    assert lexicon.ngrams(_docs(spark, "", "a"), 2).count() == 0
    assert components.clusters(d).filter("doc_id = 0").count() == 0
    assert lexicon.word_counts(d.limit(0)).count() == 0
    assert {(r.doc_id, r.kept) for r in tables.capped(d.na.fill(""), 5).collect()} == {(0, 0), (1, 2), (2, 1), (3, 2), (4, 0), (5, 0), (6, 0)}


def test_positions_sum_to_one(spark):
    p = lexicon.position_norm(lexicon.positions(lexicon.word_counts(_docs(spark, "one two three two", "noon moon"))))
    assert all(abs(r.s - 1) < 1e-9 for r in p.groupBy("c", "len").agg(F.sum("p").alias("s")).collect())


def test_scans(spark):
    lines = spark.createDataFrame([("p1", "% note\nclass = text body\npos = 1 2 30 40\nclass = image\npos = 5 6 7 8")], "page string, text string")
    assert [tuple(r) for r in tables.regions(lines, ["te"]).collect()] == [("p1", 1, "text", 1, 2, 30, 40)]
    rep = spark.createDataFrame([(1, "head\n 10 2 80.00% ASCII Lowercase Letters\n x")], "doc_id long, text string")
    assert [tuple(r) for r in tables.accuracy_report(rep).collect()] == [(1, "Lowercase Letters", 10, 2)]
    body = spark.createDataFrame([(1, 1, "x"), (1, 2, "y<BODY>first"), (1, 3, "Reuter 3"), (1, 4, "more"), (1, 5, "end</BODY>"), (1, 6, "z")], "k int, at int, line string")
    assert [r.line for r in tables.body_lines(body, "k", "at", "line").orderBy("at").collect()] == ["first", "more"]
    word = spark.createDataFrame([(1, "a\nb\n 20 words\n 3 wrong\n")], "doc_id long, text string")
    assert tuple(tables.word_report(word).first()) == (1, 20, 3)


def test_reading_stays_in_the_text_s_row(spark):
    """Texts are read where they lie: neither they nor their words are shuffled, and texts without a language or clusters stay."""
    d = spark.createDataFrame([(1, "aab a_\n_ab", "en"), (2, "bba b", "en"), (3, "x_y", None), (4, "\n", "en"), (5, "", "en"), (6, None, "en")], "doc_id long, text string, lang string")
    symbols = {r.lang: r.symbols for r in evaluate.language_symbols(d).collect()}
    assert symbols == {"en": "ab _"}
    got = {r.doc_id: r.decoded for r in evaluate.read_texts(d).collect()}
    assert got == {1: "aab a \n ab", 2: "aab a", 3: "x y", 4: "\n"}
    assert {(r.doc_id, r.total, r.correct) for r in evaluate.read_word_accuracy(d).collect()} == {(1, 3, 1), (2, 2, 0), (3, 1, 0)}
    plan = evaluate.read_word_accuracy(d)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "doc_id#" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)


def test_implied_equalities(spark):
    w = spark.createDataFrame([("1232", 1)], "word string, n long")
    lex = spark.createDataFrame([(x, 1) for x in ("aaaa", "aaba", "abab", "abbb", "abcb", "abcd", "abca")], "word string, n long")
    # all shapes but those whose second and fourth letters differ
    assert matching.implied(w, lex).first().n_matches == sum(x[1] == x[3] for x in ("aaaa", "aaba", "abab", "abbb", "abcb", "abcd", "abca"))


def test_perfect_cipher(spark):
    d = spark.createDataFrame([(1, "aaabbc", "en"), (2, "aaabbc", "en")], "doc_id long, text string, lang string")
    m = evaluate.rank_mapping(d)
    assert {r.acc for r in evaluate.accuracy(m, "doc_id").collect()} == {1.0}
    assert {r.decoded for r in evaluate.decoded(d, m).collect()} == {"aaabbc"}


def test_viterbi_over_spans_is_that_over_all_states():
    r = np.random.default_rng(5)
    narrow = 0
    for k in range(12):
        s, n = 40, int(r.integers(1, 50))
        z = (np.arange(n)[None] + 1 - np.ceil((np.arange(s)[:, None] + 1) * n / s)) / (0.05 * n)
        e, t, i = np.exp(-z * z / 2), r.dirichlet(np.full(s, 0.5), s) + 1e-3, r.dirichlet(np.full(s, 0.5))
        t = np.round(t, 2) + 1e-3 if k % 2 else t  # ties
        obs = r.integers(0, n, 60).tolist()
        lt, le = np.log(t + decode.EPS), np.log(e + decode.EPS)
        narrow += sum(b - a for a, b in decode.spans(lt, le)) < 0.8 * n * s
        v, back = np.log(i + decode.EPS) + le[:, obs[0]], []
        for o in obs[1:]:
            x = v[:, None] + lt
            back.append(x.argmax(axis=0))
            v = x.max(axis=0) + le[:, o]
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert decode.viterbi(obs, t, e, i) == (path[::-1], float(v.max()))
    assert narrow


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    t, e, i = r.random((3, 3)), r.random((3, 4)), r.random(3)
    obs = r.integers(0, 4, 6).tolist()
    best = max(itertools.product(range(3), repeat=6), key=lambda p: np.log(i[p[0]]) + sum(np.log(t[a, b]) for a, b in zip(p, p[1:], strict=False)) + sum(np.log(e[s, o]) for s, o in zip(p, obs, strict=True)))
    assert tuple(decode.viterbi(obs, t, e, i)[0]) == best


def test_pruned_search_is_exhaustive():
    r = np.random.default_rng(2)
    pairs, start = np.log(r.random((6, 6))), np.log(r.random(6))
    seq = r.integers(0, 4, 30).tolist()
    cand = [r.permutation(6)[:3].tolist() for _ in range(4)]
    a, b = decode.bigram_map(seq, cand, start, pairs), decode.bigram_map(seq, cand, start, pairs, prune=False)
    assert a[0] == b[0] and a[1] == pytest.approx(b[1])


def test_lexicon_maps():
    words = ["that", "this", "noon", "on", "tin", "at"]
    lex = decode.Lexicon(words)
    cipher = str.maketrans("thaisno", "qwertyu")
    text = " ".join(w.translate(cipher) for w in words * 2)
    cl, ws = decode.cluster_words(text)
    truth = {c.translate(cipher): c for c in "thaisno"} | {" ": " "}
    order = {c: [truth[c]] for c in cl}
    got = decode.simultaneous_map([c for c in cl if c != " "], ws, order, lex)
    assert all(got[c] == truth[c] for c in got)
    greedy = decode.lookup_map([c for c in cl if c != " "], ws, {c: [truth[c], "z"] for c in cl}, lex)
    assert all(greedy[c] == truth[c] for c in greedy)


def test_line_decoding():
    a, b = np.array([[1, 1], [1, 0]]), np.array([[0, 1, 1], [1, 1, 0]])
    line = np.hstack([a, b, a]).astype(float)
    path, widths, _ = decode.solve_line(line, [a, b], np.full((2, 2), 0.5), ins=0.05, dele=0.05)
    assert path == [0, 1, 0] and widths == [2, 3, 2]
    assert decode.split_matches(np.hstack([a, b]).astype(float), [a, b], 0.01) == [0, 1]


def test_mixture_gradient():
    s, n = np.arange(1.0, 31), np.random.default_rng(3).integers(1, 50, 30).astype(float)
    f, x = gaps.objective(s, n), np.log([4.0, 15.0, 9.0])
    g = f(x)[1]
    for k in range(3):
        e = np.zeros(3)
        e[k] = 1e-5
        assert (f(x + e)[0] - f(x - e)[0]) / 2e-5 == pytest.approx(g[k], rel=1e-4, abs=1e-3)
    assert f(gaps.minimise(f, x))[0] <= f(x)[0]


def test_images():
    img = np.array([[1, 1, 0, 0], [0, 0, 0, 1], [0, 1, 0, 1]])
    assert raster.label(img).max() == 3 and raster.label(img, eight=False).max() == 3
    assert raster.crop(np.pad(img, 2)).shape == (3, 4)
    assert raster.subimage(img.astype(float), np.array([[0.0, 1.0], [0.0, 1.0]]), 0.1) == (1, 2, 0.0)
    x = raster.noise(np.pad(np.ones((10, 10)), 5), 0.1, 0.02, 1)
    assert (x[5:15, 5:15] == 0).sum() == 10 and x.sum() == 100 - 10 + 6


def test_components_against_labels(spark):
    r = random.Random(4)
    texts = ["\n".join("".join(r.choice("x  ") for _ in range(12)) for _ in range(6)) for _ in range(20)]
    got = raster.runs_components(_docs(spark, *texts)).groupBy("doc_id").count().collect()
    want = {i: raster.label(np.array([[c != " " for c in line] for line in t.split("\n")])).max() for i, t in enumerate(texts)}
    assert {x.doc_id: x["count"] for x in got} == {k: v for k, v in want.items() if v}


def test_diacritics(spark):
    def plain(boxes, most):
        live = {i: (list(b), [i]) for i, b in enumerate(boxes)}
        for i in range(len(boxes)):
            if i not in live:
                continue
            (l, t, r, b), own = live[i]
            for j in sorted(live):
                L, T_, R, B = live[j][0]
                wide = l <= L and R <= r or L <= l and r <= R
                high = t <= T_ and B <= b or T_ <= t and b <= B
                if j != i and wide and (high or abs(t - B) <= most or abs(T_ - b) <= most):
                    own += live.pop(j)[1]
                    live[i] = [min(l, L), min(t, T_), max(r, R), max(b, B)], own
                    break
        return {m: i for i, (_, own) in live.items() for m in own}

    r = random.Random(8)
    for n in [0, 1, 2, 7, 30] * 6:
        boxes = [(a, t, a + r.randrange(8), t + r.randrange(6)) for a, t in ((r.randrange(30), r.randrange(40)) for _ in range(n))]
        got = raster.absorbed(np.array(boxes, np.int64).reshape(-1, 4), 3)
        assert dict(enumerate(got.tolist())) == plain(boxes, 3)
    # a dot above a stem, a far symbol, and the same dot in another line
    rows = [(1, 0, 1, 5, 0, 5, 0, 1), (1, 0, 2, 4, 3, 6, 9, 12), (1, 0, 3, 20, 3, 24, 9, 9), (1, 1, 4, 5, 12, 5, 12, 1)]
    c = spark.createDataFrame(rows, "doc_id long, line int, comp int, l int, t int, r int, b int, ink int")
    assert sorted(map(tuple, raster.diacritics(c).collect())) == [(1, 0, 1, 4, 0, 6, 9, 13, 2), (1, 0, 3, 20, 3, 24, 9, 9, 1), (1, 1, 4, 5, 12, 5, 12, 1, 1)]
    assert raster.diacritics(c.limit(0)).count() == 0
    assert [(x.r, x.line) for x in raster.blocks(raster.pixels(_docs(spark, "a\n b\n\n\nc"))).orderBy("r").collect()] == [(0, 0), (1, 0), (4, 1)]


def test_alignment(spark):
    def plain(a, b):
        if not a or not b:
            return max(len(a), len(b)), 0
        same = a[-1] == b[-1]
        d, m = plain(a[:-1], b[:-1])
        ways = [(d + (not same), -(m + same))]
        for x, y in ((a[:-1], b), (a, b[:-1])):
            d, m = plain(x, y)
            ways.append((d + 1, -m))
        d, m = min(ways)
        return d, -m

    r = random.Random(9)
    for _ in range(150):
        a, b = ("".join(r.choice("abé") for _ in range(r.randrange(6))) for _ in range(2))
        assert evaluate.edits(a, b) == plain(a, b)
    rows = [(1, "abc\nde", "ac\ndxe"), (2, "", "x"), (3, None, None), (4, "a\nb", "a"), (5, "same", "same")]
    got = evaluate.aligned_accuracy(spark.createDataFrame(rows, "doc_id long, text string, decoded string")).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == [(1, 5, 5, 2, 4, 0.6), (2, 0, 1, 1, 0, None), (3, 0, 0, 0, 0, None), (4, 2, 1, 1, 1, 0.5), (5, 4, 4, 0, 4, 1.0)]
    assert evaluate.aligned_accuracy(spark.createDataFrame([], "doc_id long, text string, decoded string")).count() == 0
    s = evaluate.squeezed(spark.createDataFrame([(1, " a  b \n  c")], "doc_id long, decoded string")).first()
    assert s.decoded == "a b\nc"


def test_lookup_takes_all_symbols():
    r = random.Random(21)
    words = {"".join(r.choice("abcdeA") for _ in range(r.randint(1, 5))) for _ in range(60)}
    lex, symbols = decode.Lexicon(sorted(words)), list("abcdeABCDE.")
    for _ in range(400):
        w = "".join(r.choice("uvwxy") for _ in range(r.randint(1, 6)))
        mapping = {x: r.choice(symbols) for x in "uvwxy" if r.random() < 0.4}
        c = r.choice(w)
        mapping.pop(c, None)
        assert lex.letters(w, c, mapping) == {s for s in [*symbols, *"xyz"] if lex.known(w, mapping | {c: s})}
    order = decode._order(list("zyx"), symbols)
    assert order["z"] == symbols and order["x"] == list("cbdaeABCDE.")
    assert all(sorted(x) == sorted(symbols) for x in order.values())
    far = list("etaoinshr") + ["q"]  # the only fitting symbol is far from the cluster's rank
    for f in (decode.lookup_map, decode.simultaneous_map):
        assert f(["z"], Counter({"z": 3}), decode._order(["z"], far), decode.Lexicon(["q"])) == {"z": "q"}


def test_hmm_decodes_every_printable_symbol(spark, tmp_path):
    others = [chr(x) for x in range(33, 95) if chr(x) != "Q"]  # each likely behind itself; Q only begins lines
    texts = ["\n".join(["Q"] * 300), *(c * 200 for c in others)]
    _docs(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in decode.QUERIES["hmm_viterbi"][0](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and (got[0].lines, got[0].correct) == (300, 300)


@pytest.mark.parametrize("depth", [None, 3])
def test_branch_and_bound_against_all_maps(depth):
    r = random.Random(22)
    g = np.random.default_rng(22)
    for n in range(30):
        pairs, start = np.log(g.dirichlet(np.full(7, 0.3), 7) + 1e-9), np.log(g.dirichlet(np.ones(7)))
        k = 8 if n < 3 else r.randint(1, 6)
        lines = [[r.randrange(k) for _ in range(r.randint(0, 12))] for _ in range(4)] + [list(range(k))]
        candidates = [sorted(r.sample(range(7), 3)) for _ in range(k)] if n % 2 else None
        mapped = k if depth is None else min(k, depth)

        def score(m):
            first = sum(start[m[x[0]]] if x[0] < len(m) else -3.0 for x in lines if x)
            return first + sum(pairs[m[a], m[b]] if max(a, b) < len(m) else -3.0 for x in lines for a, b in zip(x, x[1:], strict=False))

        search = decode.Assigning(lines, k, start, pairs, depth, -3.0, candidates)
        best = max(map(score, itertools.product(*(candidates or [range(3)] * k)[:mapped]))) if candidates or k < 8 else None
        if not candidates:  # three symbols in all
            search = decode.Assigning(lines, k, start[:3], pairs[:3, :3], depth, -3.0)
            best = max(map(score, itertools.product(range(3), repeat=mapped)))
        m, v, bound = search.best(10**6)
        assert v == pytest.approx(best) and v == pytest.approx(score(m.tolist())) and bound == pytest.approx(v)
        _, early, limit = search.best(2)
        assert early <= best + 1e-9 <= limit + 1e-6  # a search that is cut short says how far it may be off


def test_bnb_map_maps_all_clusters(spark, tmp_path):
    _docs(spark, "abcdefg").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "xxx")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = decode.QUERIES["bnb_map"][0](spark, str(tmp_path)).first()
    assert (r.clusters, r.correct, r.score) == (7, 0, round(math.log(2 / 96) + 6 * math.log(3 / 97), 3))
    assert r.bound >= r.score


def test_short_lists_leave_blank_templates_out(spark):
    pix = lambda *on: [1.0 if i in on else -1.0 for i in range(64)]
    img = spark.createDataFrame([(1, pix(0)), (2, pix(63)), (3, pix())], "id long, v array<double>")
    templates = spark.createDataFrame([(0, pix()), (1, pix(1)), (2, pix(62))], "id long, v array<double>")
    got = sorted((r.id, r["rank"], r.label, r.d) for r in vectors.short_lists(img, templates).collect())
    far = round(math.hypot(7, 6), 9)
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, far), (2, 1, 2, 1.0), (2, 2, 1, far)]


def test_block_searches_give_what_pairs_give(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)], 0) for i in range(60)]
    rows += [(60, rows[0][1], 1), (61, [-1.0] * 63 + [1.0], 1)]
    img = vectors.images(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).cache()
    pairs = vectors.searched(img)
    monkeypatch.setattr(vectors, "BLOCK", 20)  # several blocks of images
    found = lambda df: sorted((r.q_id, r.id, r.d) for r in df.collect())
    assert found(vectors.euclid_search(img)) == found(vectors.euclid(pairs))
    assert found(vectors.hamming_search(img)) == found(vectors.hamming(pairs))
    assert found(vectors.hausdorff_search(img)) == found(vectors.hausdorff(vectors.searched(vectors.transformed(img))))
    assert found(vectors.nearest(vectors.euclid_search(img, 3))) == found(vectors.nearest(vectors.euclid(pairs)))
    odd = vectors.images(spark.createDataFrame([(0, [1.0, 2.0], 0), (1, None, 0), (2, [1.0, None], 0)], "vec_id long, embedding array<float>, label int"))
    assert [(r.id, r.d) for r in vectors.hamming_search(odd).orderBy("id").collect()] == [(1, None), (2, None)]


def test_forms_meet_a_lexicon_as_plain_loops_do(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(60)] + ["ab" * 400]
    lexicon = spark.createDataFrame([(w, k + 1) for k, w in enumerate(sorted(set(words[30:])))], "word string, n long")
    found = matching.met(spark.createDataFrame([(3, "1=2"), (3, "a"), (2, ""), (4, "")], "len int, form string"), lexicon.select(F.length("word").alias("len"), F.transform(F.split("word", ""), F.ascii).alias("t"), "n"), lambda f: {"1=2": [(1, 2)], "a": [(-97, 0)], "": []}[f])
    rows = [(x.word, x.n) for x in lexicon.collect()]
    want = {(3, "1=2"): sum(n for w, n in rows if len(w) == 3 and w[1] == w[2]), (3, "a"): sum(n for w, n in rows if len(w) == 3 and w[0] == "a"), (2, ""): sum(n for w, n in rows if len(w) == 2), (4, ""): sum(n for w, n in rows if len(w) == 4)}
    assert {(x.len, x.form): x.n_matches for x in found.collect()} == want


def test_maps_climb_side_by_side_and_branches_look_ahead_as_one_by_one():
    g = np.random.default_rng(31)
    pairs, start = np.log(g.dirichlet(np.full(40, 0.3), 40) + 1e-6), np.log(g.dirichlet(np.ones(40)))
    search = decode.Assigning([g.integers(0, 12, n).tolist() for n in (0, 1, 30, 60)], 12, start, pairs)
    field = lambda d, m, others: search.alone[d] + sum((search.count[d, e] * pairs[:, m[e]] + search.count[e, d] * pairs[m[e]] for e in others), np.zeros(40))
    starts = (np.arange(12)[None] + np.arange(8)[:, None]) % 40
    for m, found in zip(starts, search.climbed(starts), strict=True):
        m, before = m.tolist(), None
        while m != before:
            before = list(m)
            for d in range(12):
                f = field(d, m, [e for e in range(12) if e != d])
                m[d] = int(f.argmax()) if f.max() > f[m[d]] + 1e-9 else m[d]
        assert found.tolist() == m
    symbols = g.permutation(40)[:37]
    want = [sum((search.alone[e] + search.count[4, e] * pairs[c] + search.count[e, 4] * pairs[:, c]).max() for e in range(5, 12)) for c in symbols]
    assert search.ahead(search.alone, 4, symbols) == pytest.approx(want)


def test_lines_are_aligned_side_by_side(monkeypatch):
    def plain(a, b):
        row = [(j, 0) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            now = [(i, 0)]
            for j, y in enumerate(b, 1):
                (d, m), ways = row[j - 1], [(v[0] + 1, v[1]) for v in (row[j], now[-1])]
                now.append(min([(d + (x != y), m - (x == y)), *ways]))
            row = now
        return row[-1][0], -row[-1][1]

    r = random.Random(17)
    pairs = [tuple("".join(r.choice("abé😀") for _ in range(r.randrange(r.choice([2, 9, 40])))) for _ in range(2)) for _ in range(150)]
    for cells in (1, 50, 32_768):
        monkeypatch.setattr(evaluate, "CELLS", cells)
        distance, matched = evaluate.all_edits(pairs)
        assert list(zip(distance.tolist(), matched.tolist(), strict=True)) == [plain(*p) for p in pairs]
    assert [x.tolist() for x in evaluate.all_edits([])] == [[], []]


def test_postings_are_counted_inside_the_text(spark):
    rows = [(1, "ab ba\n\nab  é"), (1, "a"), (2, ""), (3, None), (4, " \n "), (5, "\ta😀a a\r")]
    df = components.postings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, df.collect())) == sorted([(1, "a", 4), (1, "b", 3), (1, "é", 1), (5, "\t", 1), (5, "a", 2), (5, "😀", 1), (5, "\r", 1)])
    assert "Generate" not in df._jdf.queryExecution().toString()  # no word is exploded and shuffled


def test_symbols_are_counted_and_lines_scored_inside_the_text(spark):
    from quillframe.operators import lexicon, models

    r = random.Random(14)
    texts = ["".join(r.choice("ab \né\t😀~") for _ in range(r.randrange(60))) for _ in range(30)] + ["", None, "\n", "é", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    for n in (2, 3):
        want = Counter(t[i : i + n] for t in texts if t for i in range(len(t) - n + 1) if all(" " <= c <= "~" for c in t[i : i + n]))
        g = lexicon.ngrams(docs, n)
        assert {"".join(x[:-1]): x.n for x in g.collect()} == want
        assert "Generate" not in g._jdf.queryExecution().toString()  # no symbol is exploded
    assert lexicon.ngrams(docs.filter("doc_id > 30"), 2).count() == 0
    firsts, pairs = models.smoothed_firsts(lexicon.line_firsts(docs, 1)), models.smoothed_bigrams(lexicon.ngrams(docs, 2))
    f, p = {x.a: x.p for x in firsts.collect()}, {(x.a, x.b): x.p for x in pairs.collect()}
    want = {}
    for k, t in enumerate(texts):
        for line, x in enumerate((t or "").split("\n")):
            if x := "".join(c for c in x if " " <= c <= "~"):
                want[k, line] = (len(x), math.log(f[x[0]]) + sum(math.log(p[v]) for v in zip(x, x[1:], strict=False)))
    got = models.line_scores(docs, firsts, pairs)
    rows = {(x.doc_id, x.line): (x.n, x.logprob) for x in got.collect()}
    assert rows.keys() == want.keys() and all(rows[k] == (want[k][0], pytest.approx(want[k][1], abs=2e-6)) for k in want)
    assert "aggregate(" not in got._jdf.queryExecution().toString()


def test_ink_inside_regions_is_counted_inside_the_text(spark):
    q = lambda *x: dict(zip("ltrb", x, strict=True))
    text = "ab  é\n\t cd\n\n0123456789"
    rows = [(1, text, None), (2, text, [q(0, 0, 1, 1)]), (3, text, [q(0, 0, 3, 9), q(2, 1, 5, 3)]), (4, text, []), (5, None, None), (None, "x y", [q(0, 0, 0, 0)]), (7, " ", None), (1, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, regions array<struct<l int, t int, r int, b int>>")
    got = raster.ink_inside(df)
    assert {x.doc_id: x.n for x in got.collect()} == {1: 16, 2: 2, 3: 10, None: 1}
    docs = df.select("doc_id", "text")
    plan = raster.ink_inside(raster._regions(docs))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan  # no pixel is exploded
    by_pixels = raster.cropped(raster.pixels(docs.filter("doc_id is not null")), raster._regions(docs).filter("regions is not null").selectExpr("doc_id", "inline(regions)"), ["doc_id"]).groupBy("doc_id").count()
    assert sorted(map(tuple, raster.ink_inside(raster._regions(docs.filter("doc_id is not null"))).collect())) == sorted(map(tuple, by_pixels.collect()))


def _searched_by(spark, folder, name):
    """What a search over vectors finds for two images, whose ids are no multiples of 50."""
    pix = lambda n: [1.0] * n + [-1.0] * (64 - n)
    spark.createDataFrame([(1, pix(1), 0), (2, pix(3), 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return sorted((r.q_id, r.id, r.d) for r in vectors.QUERIES[name][0](spark, str(folder)).collect())


def test_every_image_is_a_query_of_the_euclidean_search(spark, tmp_path):
    d = round(math.sqrt(8) / 64, 9)
    assert _searched_by(spark, tmp_path, "vec_euc_pairs") == [(1, 2, d), (2, 1, d)]


def test_every_image_is_a_query_of_the_hamming_search(spark, tmp_path):
    assert _searched_by(spark, tmp_path, "vec_ham_pairs") == [(1, 2, 2 / 64), (2, 1, 2 / 64)]


def test_every_image_is_a_query_of_the_match_candidates(spark, tmp_path):
    d = round(math.sqrt(8) / 64, 9)
    assert _searched_by(spark, tmp_path, "vec_match_candidates") == [(1, 2, d), (2, 1, d)]


def test_nearest_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(vectors, "BLOCK", 90)
    for made in (rng.normal(size=(200, 64)), rng.integers(0, 2, (200, 64)).astype(float), 1e4 + rng.normal(size=(200, 64)) / 1e3):
        made[20:40], made[60:63] = made[0], made[1] * np.nan if made[0, 0] > 9e3 else made[1]  # copies, and what isn't a number
        img = vectors.images(spark.createDataFrame([(7 * i, x.tolist(), 0) for i, x in enumerate(made)], "vec_id long, embedding array<double>, label int")).cache()
        found = lambda df: sorted((r.q_id, r.id, repr(r.d), r["rank"]) for r in vectors.nearest(df).collect())
        assert found(vectors.euclid_search(img, 3, img)) == found(vectors.euclid_search(img, queries=img))


def test_bnb_map_goes_on_until_its_map_is_proven_best(spark, tmp_path):
    _docs(spark, "she sells sea shells on the sea shore\nand they are quite sure").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog\nwhile the rain in spain stays mainly in the plain")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = decode.QUERIES["bnb_map"][0](spark, str(tmp_path)).first()
    assert r.bound == r.score


def test_texts_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    docs = [chr(97 + k % 7) * (k % 5) + "\nab" for k in range(450)]
    _docs(spark, *docs).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = decode.QUERIES["hmm_viterbi"][0](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 5 and found.count() == 450


def test_viterbi_traces_the_path_that_loops_find():
    g = np.random.default_rng(14)
    for n in (1, 2, 9):
        trans, emit, init = g.dirichlet(np.ones(12), 12), g.dirichlet(np.full(6, 0.2), 12), g.dirichlet(np.ones(12))
        obs = g.integers(0, 6, n).tolist()
        lt, le = np.log(trans + decode.EPS), np.log(emit + decode.EPS)
        v, kept = np.log(init + decode.EPS) + le[:, obs[0]], []
        for o in obs[1:]:
            x = v[:, None] + lt
            kept.append(x.argmax(axis=0))
            v = x.max(axis=0) + le[:, o]
        path = [int(v.argmax())]
        for best in reversed(kept):
            path.append(int(best[path[-1]]))
        assert decode.viterbi(obs, trans, emit, init) == (path[::-1], float(v.max()))
