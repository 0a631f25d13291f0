import hashlib
import random

from quillframe.llm import chat as C


def _text(r, n=30):
    return "".join(r.choice(["a", "word ", "\\", "<", "|", "\n", "é ", *C.CONTROL]) for _ in range(r.randint(0, n)))


def test_escapes():
    r = random.Random(1)
    for _ in range(3000):
        t = _text(r)
        e = C.escape(t)
        assert C.unescape(e) == t
        assert not any(c in e for c in C.CONTROL)


def test_windows():
    r = random.Random(2)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "assistant", "system", "", "to\nol\\"]), _text(r, 60)) for _ in range(r.randint(1, 25))]
        w = C.Windows(120, 40)
        out = [x for t in turns for x in w.push(*t)] + list(w.finish())
        assert [t for x in out for t in C.read(x.text, x.repeats)] == turns
        loss = "".join(C.unescape(x.text[a:b]) for x in out for a, b in x.spans)
        assert loss == "".join(t for role, t in turns if role == "assistant")
        system = next((t for t in turns if t[0] == "system"), None)
        seen = False
        for x in out:
            whole = C.read(x.text, 0)
            new = whole[x.repeats :]
            if seen:
                assert whole[0] == system
            seen |= system in new
            cost = [C.tokens(t) for _, t in whole]
            assert sum(cost) <= 120 or len(new) == 1
            past = cost[: x.repeats][1 if seen and system not in new else 0 :]
            assert sum(past) <= 40


def test_rows(spark):
    r = random.Random(3)
    rows = [(c, k, role, _text(r, 80)) for c in range(12) for k, role in enumerate(["system", "user", "assistant", "user", "assistant"] * 3)]
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (None, 2, "user", "x"), (None, None, "assistant", "y"), (60, 1, "user", "same"), (60, 1, "user", "same"), (60, 1, "assistant", None)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, window string")
    got = {x.conv_id: x for x in C.query(df.repartition(3)).collect()}
    by = {}
    for c, k, role, t in rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by.setdefault(c, []).append((k is not None, k or 0, role is not None, role or "", t is not None, t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{t[3]}\n{t[5]}\n" for t in turns)
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x.formatted_chars >= len(said)
    assert C.format_windows(df.limit(0)).count() == 0


def test_a_long_conversation_is_streamed(spark):
    df = spark.range(0, 20_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text")
    assert C.format_windows(df).selectExpr("max(length(formatted)) < 20000 as ok").first().ok
    assert {x.conv_id: x.n_turns for x in C.query(df).collect()} == {7: 20_000, -1: 2}
