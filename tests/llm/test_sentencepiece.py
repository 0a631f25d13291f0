import random
import struct

import pyarrow as pa
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from quillframe.llm import sentencepiece as S  # noqa: E402

DATA = S.model_bytes(S.MODEL_PATH)
CASES = ["", " ", "  ", "a", "Hello  world\n tab\t x  ", "Éèpaç 漢字 😀 \x00", "▁▁a ▁", "<s> </s> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaaaaa", "the" * 400]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL_PATH)


def _random(r):
    return "".join(r.choice("ab th er ing\n.,é  漢😀0 1XYZ▁") for _ in range(r.randint(0, 60)))


def test_same_ids_as_the_library(library):
    m, r = S.Model(DATA), random.Random(1)
    for t in CASES + [_random(r) for _ in range(800)]:
        assert m.encode(t) == library.encode(t), t


def test_decoding_is_the_inverse(library):
    m, r = S.Model(DATA), random.Random(2)
    for t in CASES + [_random(r) for _ in range(200)]:
        assert m.decode(m.encode(t)) == t.replace(S.SPACE, " ")
        assert m.decode(m.encode(t)) == library.decode(library.encode(t))


def _pieces(m, text):
    out, at = [], 0
    for k in m.shortest(text):
        out.append(text[at : at + int(m.length[k])])
        at += len(out[-1])
    return out


def test_shortest_path_is_the_only_legal_one():
    m = S.Model(DATA)

    def ways(text, last):
        if not text:
            return [[]]
        return [[text[:i], *rest] for i in range(1, len(text) + 1) if (text[:i] in m.ids or i == 1) and m.transition(last, text[:i]) for rest in ways(text[i:], text[:i])]

    for w in ("▁there", "▁zzqthing", "▁é漢a"):
        assert ways(w, "") == [_pieces(m, w)]


def test_many_inputs_at_once():
    m, r = S.Model(DATA), random.Random(3)
    texts = [m.rewritten(_random(r)) for _ in range(500)] + ["", "\x00", "▁"]
    numbers, ends = m.shortest_of(texts)
    assert [numbers[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [m.shortest(t) for t in texts]


def test_a_small_table_changes_nothing(monkeypatch):
    m, r = S.Model(DATA), random.Random(6)
    texts = [_random(r) for _ in range(200)]
    want = [m.encoded(t) for t in texts]
    monkeypatch.setattr(S, "KEPT", 20)
    monkeypatch.setattr(S, "TEXTS", 7)
    for _ in range(2):
        assert [x for x, _ in m.encoded_all(texts)] == want


def test_few_characters_at_a_time_and_nothing_kept_behind_a_task(spark, monkeypatch):
    m, r = S.Model(DATA), random.Random(7)
    texts = ["", *(_random(r) for _ in range(100)), "ab " * 400, ""]
    want = [m.encoded(t) for t in texts]
    dealt = []
    monkeypatch.setattr(S, "CHARACTERS", 300)
    assert [x for x, _ in m.encoded_all(texts)] == want
    for own in m._dealt(texts):
        assert len(own) == 1 or sum(map(len, own)) <= 300
        dealt += own
    assert dealt == texts

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert S.encode(df, DATA).count() == len(texts)

    def left(it):
        yield from (b for b in it if b is None)
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.kept) + len(x.old) for x in S._COMPILED.values())], pa.int64())], names=["n"])

    assert {x.n for x in spark.range(0, 40, 1, 8).mapInArrow(left, "n long").collect()} == {0}


def _number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def _unigram(scores, squeeze):
    """A unigram model file with byte pieces."""
    rows = [("<unk>", 0.0, S.UNKNOWN), *((f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256)), *((p, s, S.NORMAL) for p, s in scores.items())]
    piece = lambda p, s, k: _field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + _field(3, k)
    return b"".join(_field(1, piece(*x)) for x in rows) + _field(2, _field(3, S.UNIGRAM)) + _field(3, _field(3, 1) + _field(4, int(squeeze)))


def test_unigram_against_all_segmentations():
    scores = {"▁": -2.0, "a": -1.5, "b": -2.25, "ab": -2.5, "ba": -3.125, "▁a": -2.75, "▁ab": -4.0, "aba": -4.5, "bb": -8.0}
    worst, r = 10 - min(scores.values()), random.Random(5)

    def ways(t):
        if not t:
            return [(0.0, [])]
        out = [(worst + c, [t[0], *w]) for c, w in ways(t[1:])] if t[0] not in scores else []
        return out + [(c - scores[t[:i]], [t[:i], *w]) for i in range(1, len(t) + 1) if t[:i] in scores for c, w in ways(t[i:])]

    for squeeze in (False, True):
        m = S.Model(_unigram(scores, squeeze))
        for t in [" ", "", "  a  b ", "é", *("".join(r.choice("aabb é") for _ in range(r.randint(0, 9))) for _ in range(150))]:
            normal = " ".join(t.split(" ")) if not squeeze else " ".join(x for x in t.split(" ") if x)
            normal = "▁" + normal.replace(" ", "▁") if normal else ""
            assert m.rewritten(t) == normal
            cost, best = min(ways(normal))
            got = m.encode(t)
            assert abs(sum(worst if len(p) == 1 and p not in scores else -scores[p] for p in _pieces(m, normal)) - cost) < 1e-9
            assert m.decode(got).encode() == m.lossless(t)
            if len({round(c, 6) for c, _ in ways(normal)}) == len(ways(normal)):
                want = []
                for p in best:
                    want += [m.ids[p]] if p in m.ids else [1 + b for b in p.encode()]
                assert got == want


def test_transitions_by_the_merge_rules():
    m, r = S.Model(DATA), random.Random(4)
    pieces = sorted(m.ids.values())
    for _ in range(3000):
        a, b = r.choice(pieces), r.choice(pieces)
        assert m.joins(a, b) == (m.merged(m.text[a] + m.text[b]) == [m.text[a], m.text[b]])
    short = [i for i in pieces if set(m.text[i]) <= set("aeth▁")]
    for _ in range(3000):
        a, b = r.choice(short), r.choice(short)
        assert m.joins(a, b) == (m.merged(m.text[a] + m.text[b]) == [m.text[a], m.text[b]])


def test_rows(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y"), (4, "word " * 60_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = S.encode(df, DATA).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == sorted((i or 0, len(library.encode(t or ""))) for i, t, _ in rows)
    assert all(r.round_trip for r in out)
    assert {r.text for r in S.decode(S.encode(df, DATA), DATA).collect()} == {t or "" for _, t, _ in rows}
    assert S.encode(df.limit(0), DATA).count() == 0
