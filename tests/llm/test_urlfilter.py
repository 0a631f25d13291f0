import random
import re

from quillframe.llm import urlfilter as U


def _regex(glob, host):
    out = ""
    for t in U._tokens(glob):
        out += {U._RUN: "[^\0]*", U._ANY_RUN: r"(?s:.)*", U._ONE: "[^\0]"}.get(t) or re.escape(chr(t))
    return out


def _fits(rule, host, path):
    return re.fullmatch(_regex(rule.host, True) + "\0" + _regex(rule.path, False), f".{host}\0{path}", re.S) is not None


def test_automaton_against_regular_expressions():
    r = random.Random(3)
    word = lambda k: "".join(r.choice("ab.é/") for _ in range(r.randint(0, k)))
    glob = lambda: "".join(r.choice(["a", "b", ".", "*", "**", "?", "é"]) for _ in range(r.randint(0, 6)))
    rules = [U.Rule(glob(), glob(), "block", "x" * r.randint(1, 9), r.random() < 0.5) for _ in range(60)]
    a = U.Automaton(rules)
    assert a.words > 1
    hosts, paths = [word(9) for _ in range(300)], [word(9) for _ in range(300)]
    state = a.states(hosts, paths)
    for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        for i, rule in enumerate(rules):
            word_, bit = divmod(a.accepts[i], 64)
            assert bool(int(state[k, word_]) >> bit & 1) == _fits(rule, h, p), (rule, h, p)
        fit = [i for i, rule in enumerate(rules) if _fits(rule, h, p)]
        want = max(fit, key=lambda i: (rules[i].ranked, len(rules[i].name), -i), default=-1)
        assert a.best([h], [p])[0] == want


def test_rows(spark):
    urls = [None, "", "no-scheme.org/x", "https://A.Example.ORG/es/1?x=1", "http://example.org/en/17#a", "http://example.org", "http://x.com/fr/", "http://spam-a.net/", "http://xorg/a", "http://a.com/de/" + "x" * 5000, "http://a.com?/de/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path[:8], r.rule, r.verdict) for r in U.judge(df.union(df), U.RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("a.example.org", "/es/1", "example.org/es/", "block"), 4: ("example.org", "/en/17", "example.org/en/1", "block"),
        5: ("example.org", "", None, "allow"), 6: ("x.com", "/fr/", "com/fr/", "allow"), 7: ("spam-a.net", "/", None, "block"),
        8: ("xorg", "/a", None, "allow"), 9: ("a.com", "/de/xxxx", "com/de/", "block"), 10: ("a.com", "", None, "allow"),
    }
    assert U.judge(df.limit(0), U.RULES).count() == 0
