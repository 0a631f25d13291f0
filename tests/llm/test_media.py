import hashlib
import random
import zlib

import numpy as np
import pytest

from quillframe.llm import media as M

HOW = (64, 6, 400)


def test_gear_and_cuts():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(3000))
    h, got = 0, M.gear(data)
    for i, b in enumerate(data):
        h = ((h << 1) + int(M.GEAR[b])) % 2**64
        assert int(got[i]) == h
    assert M.chunks(b"", *HOW) == [] and M.chunks(b"abc", *HOW) == [b"abc"]
    parts = M.chunks(data, *HOW)
    assert b"".join(parts) == data and all(64 <= len(p) <= 400 for p in parts[:-1]) and len(parts) > 10
    other = M.chunks(data[:700] + b"inserted" + data[700:], *HOW)
    assert len(set(parts) & set(other)) >= len(parts) - 6


def test_payloads():
    for n in (0, 1, 575, 576, 577, 1152):
        p = M.payload(b"x" * n)
        assert len(p) % 576 == 0 and len(p) > 0 and p == b"x" * n + b"\xff" * (len(p) - n) and len(p) - n < 576 + (n == 0)
        assert M.samples(M.medium(p)) == p


def test_round_trip(spark):
    r = random.Random(2)
    word = ["".join(r.choice("abcdé") for _ in range(6)) for _ in range(50)]
    texts = [" ".join(r.choice(word) for _ in range(r.randint(0, 300))) for _ in range(40)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(100, None, 1), (101, "", 1), (102, texts[0], 1), (102, texts[0], 1), (None, texts[1] + "x", 1), (103, "😀" * 100_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, medium int")
    lists, store, d = M.put(df, how=HOW)
    got = {bytes(x.medium): bytes(x.data) for x in M.get(store, d).collect()}
    media = {M.medium(M.payload((t or "").encode())) for _, t, _ in rows}
    assert set(got.values()) == media and all(hashlib.sha256(v).digest() == k for k, v in got.items())
    names = [bytes(x.chunks[k]) for x in store.collect() for k in x.own]
    assert len(names) == len(set(names)) and set(names) == {hashlib.sha256(c).digest()[:16] for m in media for c in M.chunks(m, *HOW)}
    # a second put adds nothing that is there, and its lists are read from the store
    more = spark.createDataFrame([(7, texts[2] + texts[3], 1), (8, texts[4], 1)], "doc_id long, text string, medium int")
    again, both, _ = M.put(df.union(more), how=HOW, store=store, dictionary=d)
    after = [bytes(x.chunks[k]) for x in both.collect() for k in x.own]
    assert len(after) == len(set(after)) and set(names) < set(after) and len(after) < len(names) + 20
    media.add(M.medium(M.payload((texts[2] + texts[3]).encode())))
    assert {bytes(x.data) for x in M.get(both, d).collect()} == media
    with pytest.raises(Exception, match="missing|differ"):
        M.get(store.filter("not whole or hex(medium) > '4'"), d).collect()


def test_most_media_have_many_chunks(spark):
    """On the documents of the test tables the chunker cuts, and near copies and shared passages share chunks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lists, store, _ = M.put(docs)
    row = lists.selectExpr("avg(size(chunks))", "avg(cast(size(chunks) > 1 as int))", "sum(size(chunks))").first()
    names = store.selectExpr("sum(size(own))").first()[0]
    distinct = lists.selectExpr("explode(chunks) n").distinct().count()
    assert row[0] > 1.5 and row[1] > 0.4 and names == distinct < row[2]
    assert store.filter("not whole").count() > 0
    # of the places of distinct media, some 0.5 % hold a chunk that another place owns
    places = store.selectExpr("sum(size(chunks))").first()[0]
    assert 0.002 < 1 - names / places < 0.05


def test_every_medium_is_rebuilt_from_its_list(spark):
    """A wrong name or size, or another order in the list of a medium that owns all its chunks, is noticed."""
    r = random.Random(5)
    df = spark.createDataFrame([(1, "".join(r.choice("abcdefgh \n") for _ in range(4000)))], "doc_id long, text string")
    _, store, d = M.put(df, how=HOW)
    assert store.first().whole and len(store.first().chunks) > 10
    assert M.get(store, d).count() == 1
    for wrong in ("transform(chunks, (x, i) -> if(i = 3, chunks[4], x))", "reverse(chunks)"):
        with pytest.raises(Exception, match="differ"):
            M.get(store.selectExpr("medium", f"{wrong} AS chunks", "own", "sizes", "whole", "lent", "data"), d).collect()
    with pytest.raises(Exception, match="differ"):
        M.get(store.selectExpr("medium", "chunks", "own", "transform(sizes, (x, i) -> if(i = 2, x - 1, x))  AS sizes", "whole", "lent", "data"), d).collect()


def test_rows(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "abc"), (5, "é" * 288), (6, "x" * 700_000)]
    got = {x.doc_id: x for x in M.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        data = (t or "").encode()
        p = M.payload(data)
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (x.media_bytes, x.media_sha256) == (len(M.medium(p)), hashlib.sha256(M.medium(p)).hexdigest())
    assert got[1].feature == got[4].feature and got[2].feature == got[3].feature
    n = np.frombuffer(M.payload(b"abc"), np.uint8)
    assert got[1].feature.startswith(f"{n.mean():.6f};{n.std():.6f};")
    assert M.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
