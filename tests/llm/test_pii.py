import hashlib
import random
import re

from quillframe.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    check = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and check(digits(m.group()))]
    out += [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]
    return out


def test_base_spans():
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice("aé@@..-+ 0123456789()%\n") for _ in range(r.randint(0, 60)))
        assert P.base_spans(t) == plain_base(t), t
    for t in ["4610568901970798", "4610 5689-0197 0798", "a@b.c@d.e", "x@y.z", "1.2.3.4.5.6.7.8", "000000001.2.3.256", "+1 (826) 555-4081"]:
        assert P.base_spans(t) == plain_base(t)


def plain_candidates(t):
    """The definition, over all tokens of a whole text: (token borders, (kind, i, j))."""
    ends = [0, *(m.end() for m in P._TOKEN.finditer(t))]
    out = []
    for i in range(len(ends) - 1):
        for j in range(i + 1, min(len(ends) - 1, i + P.LONGEST) + 1):
            a, b = ends[i], ends[j]
            s = t[a:b]
            if (a and t[a - 1].isalnum()) or t[b : b + 1].isalnum() or "\n" in s:
                continue
            if "@" in s and not re.search(r"\s", s) and s[0].isalnum() and s[-1].isalnum():
                out.append((0, i, j))
            if set(s) <= set("0123456789 ().+-") and sum(c.isdigit() for c in s) >= 4 and s[0] in "+(0123456789" and s[-1].isdigit():
                out += [(k, i, j) for k in (1, 2, 3)]
    return ends, out


def plain_scores(t, ends, found, w):
    return [sum(w.get(f, 0.0) for f in x) for x in P._featured(t, ends, found)]


def plain_best(t, w):
    """The best segmentation of a whole text, over all of its tokens."""
    ends, found = plain_candidates(t)
    turn = lambda x, y: w.get(f"turn{x}{y}", 0.0)
    best = [{} for _ in ends]
    best[0][4] = (0.0, [])
    for j in range(1, len(ends)):
        ways = [(j - 1, 4, 0.0)] + [(i, k, s) for (k, i, e), s in zip(found, plain_scores(t, ends, found, w), strict=True) if e == j]
        for i, k, s in ways:
            for y, (v, path) in best[i].items():
                v += turn(y, k) + s
                if k not in best[j] or v > best[j][k][0]:
                    best[j][k] = (v, path + ([(k, ends[i], ends[j])] if k < 4 else []))
    return max(((v + turn(y, 4), path) for y, (v, path) in best[-1].items()), key=lambda x: x[0])


def _texts(r):
    for _ in range(30):
        yield " ".join(P._sentence(r)[0] for _ in range(r.randint(1, 3)))
    for _ in range(80):
        yield "".join(r.choice(["a", "@", "b.c", "12", "345", "6789", " ", ".", "-", "(", "+", ")", "\n", "  ", "é", "mail ", "tel: ", "٣", "_"]) for _ in range(r.randint(0, 45)))
    yield "x" * 5000 + "@" + "y" * 5000 + ".com 555-123-4567"
    yield "-".join(["12"] * 200) + " mail " + "a." * 50 + "b@c.d"


def test_clusters_are_the_whole_texts_candidates():
    for t in _texts(random.Random(31)):
        ends, found = plain_candidates(t)
        got = [(k, e[i], e[j]) for e, own in P._candidates(t) for k, i, j in own]
        assert sorted(got) == sorted((k, ends[i], ends[j]) for k, i, j in found), t
        spans = [(e[0], e[-1]) for e, _ in P._candidates(t)]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_clusters_give_the_whole_texts_best_segmentation():
    w = P.weights()
    worse = {**w, **{f"turn{x}{y}": 0.7 * (x - y) for x in range(5) for y in range(5) if x * y < 16}}

    def value(t, spans, w):
        ends, found = plain_candidates(t)
        at = {(k, ends[i], ends[j]): s for (k, i, j), s in zip(found, plain_scores(t, ends, found, w), strict=True)}
        path, here = [4], 0
        for k, a, b in spans:
            path += [4] * (ends.index(a) - ends.index(here)) + [k]
            here = b
        path += [4] * (len(ends) - 1 - ends.index(here)) + [4]
        return sum(at[s] for s in spans) + sum(w.get(f"turn{x}{y}", 0.0) for x, y in zip(path, path[1:], strict=False))

    for t in _texts(random.Random(32)):
        for ws in (w, worse):
            best, _ = plain_best(t, ws)
            assert abs(value(t, P.decode(t, ws), ws) - best) < 1e-6, t
    far = "write to our mail " + "word " * 300 + "at 555 123 4567 or 10.0.0.1"
    assert P.decode(far, w) == plain_best(far, w)[1]


def _segmentations(n, found):
    def ways(i):
        if i == n:
            yield []
            return
        for rest in ways(i + 1):
            yield [(4, None), *rest]
        for c, (k, a, b) in enumerate(found):
            if a == i:
                for rest in ways(b):
                    yield [(k, c), *rest]

    yield from ways(0)


def test_expectations_against_all_segmentations():
    r = random.Random(33)
    g = P.np.random.default_rng(5)
    for t in ["a@b.c", "1234-5678", "(12) 34 56", "12.34.56.78 9"]:
        for ends, found in P._candidates(t):
            n = len(ends) - 1
            found = r.sample(found, min(len(found), 9))
            scores, turns = g.normal(size=len(found)), g.normal(size=(5, 5))
            total, chance, count = P.expected(n, found, scores, turns)
            z, c, u = 0.0, P.np.zeros(len(found)), P.np.zeros((5, 5))
            for way in _segmentations(n, found):
                types = [4, *(k for k, _ in way), 4]
                p = P.np.exp(sum(scores[x] for _, x in way if x is not None) + sum(turns[a, b] for a, b in zip(types, types[1:], strict=False)))
                z += p
                for _, x in way:
                    if x is not None:
                        c[x] += p
                for a, b in zip(types, types[1:], strict=False):
                    u[a, b] += p
            assert abs(total - P.np.log(z)) < 1e-9 and P.np.allclose(c / z, chance) and P.np.allclose(u / z, count)


def test_the_likelihood_grows():
    def likelihood(w):
        r, out = random.Random(34), 0.0
        turns = P.np.array([[w.get(f"turn{x}{y}", 0.0) for y in range(5)] for x in range(5)])
        for _ in range(60):
            index = {}
            text, gold = P._sentence(r)
            for n, found, features, is_gold, path in P._lattice(text, set(gold), index):
                names = list(index)
                scores = P.np.array([sum(w.get(names[k], 0.0) for k in f) for f in features])
                out += scores[is_gold].sum() + (path * turns).sum() - P.expected(n, found, scores, turns)[0]
        return out

    assert likelihood({}) < likelihood(P.train(60, epochs=1)) < likelihood(P.weights()) < 0


def test_held_out_sentences():
    r, w = random.Random(123), P.weights()
    hit = miss = wrong = 0
    for _ in range(200):
        t, gold = P._sentence(r)
        found = P.decode(t, w)
        hit += len(set(found) & set(gold))
        miss += len(set(gold) - set(found))
        wrong += len(set(found) - set(gold))
    assert hit / (hit + miss) > 0.95 and hit / (hit + wrong) > 0.95


def test_rows(spark):
    far = "word " * 50_000
    rows = [(1, None, 0), (2, "", 0), (3, far + "a@b.org 10.0.0.1", 7), (3, far + "a@b.org 10.0.0.1", 7), (None, "é +1 826 555 4081 fin", 1), (5, "call (555) 123-4567 now", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = P.find(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[3].n_email, by[3].n_ip, by[3].spans) == (1, 1, "email:250000:250007,ip:250008:250016")
    assert by[None].spans == "phone:2:17" and by[1].spans == by[2].spans == ""
    assert by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[5].n_phone == 0 and by[5].spans == "phone:5:19"
    red = {r.doc_id: r.text for r in P.redact(df).collect()}
    assert red[1] is None and red[3] == far + "<email> <ip>" and red[5] == "call <phone> now"
    assert P.find(df.limit(0)).count() == 0
