import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillframe.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def plain(docs, longest=4, least=30, share=80, first=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= share * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def _odd():
    r = np.random.default_rng(3)
    words = ["Alpha", "beta", "GAMMA", "délta", "İ", "e f", "x y", "\u0000", "日本"]
    docs = []
    for k in range(120):
        text = "".join(str(r.choice(words)) + str(r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "\x0b", "!"])) for _ in range(r.integers(0, 60)))
        docs.append((text, [None, "en", "und", "de"][k % 4]))
    docs += [("a b c d. " * 40, "en"), ("a b c d. " * 40, "en"), (None, "en"), ("", None), (" \t ..\n", "fr"), ("one two " * 3000, "en"), ("tie one. tie two. " * 35, "en")]
    return docs


@pytest.mark.parametrize("words", [600_000, 3])
def test_against_plain_counts(spark, monkeypatch, words):
    monkeypatch.setattr(C, "WORDS", words)  # the smaller one ranks every batch alone
    docs = _odd()
    df = spark.createDataFrame([(7, t, lang, "p", 0) for t, lang in docs], SCHEMA).repartition(5)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.mine(df, least=4).collect())
    want = plain(docs, least=4)
    assert len(want) > 50 and got == want
    few = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.mine(df, first=3, longest=3).collect())
    assert few == plain(docs, first=3, longest=3)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.mine(df).collect() == []
    assert C.mine(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, None)], SCHEMA)).collect() == []


def test_a_piece_is_one_row_however_often_it_occurs(spark):
    import pyarrow as pa

    t = C.pieces(pa.array(["en"] * 3), pa.array(["A  b.a b", "a\tB", "x"]))
    assert sorted(map(tuple, (r.values() for r in t.to_pylist()))) == [("en", "a b", 3), ("en", "x", 1)]


def test_counts_beyond_memory(spark, monkeypatch):
    """duckdb spills where phrases need more than it may hold."""
    monkeypatch.setattr(C, "MEMORY", "24MB")
    r = np.random.default_rng(4)
    docs = [(" ".join(f"wort{x}" for x in r.integers(0, 5000, 800)), "en") for _ in range(120)]
    df = spark.createDataFrame([(1, t, lang, None, None) for t, lang in docs], SCHEMA)
    got = {(x.phrase, x.n) for x in C.counts(df, least=4).collect()}
    f = Counter()
    for t, _ in docs:
        w = t.split()
        for n in range(1, 5):
            f.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    assert got == {(p, n) for p, n in f.items() if n >= 4} | {("", 120 * 800)}


def test_products_beyond_64_bits(spark):
    big = 5 * 10**17
    rows = [("en", "a b", big), ("en", "a", big + 1), ("en", "b", big + 3)]
    got = C.scored(spark.createDataFrame(rows, "lang string, phrase string, n long")).collect()
    assert [(r.phrase, r.l, r.r, r.score) for r in got] == [("a b", big + 1, big + 3, 2_000_000 * big // (2 * big + 4))]


def test_sql(spark):
    c = duckdb.connect()
    c.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    df = C.mine(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = sorted(map(tuple, df.collect()))
    r = c.execute(C.SQL)
    assert [x[0] for x in r.description] == df.columns
    assert got and got == sorted(r.fetchall())
