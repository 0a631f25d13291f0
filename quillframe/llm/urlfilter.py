"""URL filters: one bit-parallel automaton simulates every glob rule over each canonical URL.

A rule is a glob over the host and a glob over the path. All rules are packed bit by bit into
machine words: a rule of m symbols takes m + 1 neighbouring bits, the first of them its start
state. A step over one symbol is the Shift-And step, for all rules and a whole batch of URLs
at once::

    state = ((state << 1) & fits[symbol]) | (state & stays[symbol])

``fits`` has a bit for each position whose symbol fits, ``stays`` one for each position with a
wildcard loop, and the shift carries from word to word. The alphabet is compressed to the
symbols that the rules name, so tables are small for any number of URLs.

Globs: ``*`` any run inside the host or inside the path, ``**`` any run, ``?`` one symbol, and
a backslash before a symbol takes it literally.

Defined results: a null URL, or one without ``://``, has an empty host and path, and only
rules that fit those fit it. Repeated rows get repeated results. Of fitting rules of one rank
the longest wins, then the first listed. Other columns are left out of the result, so names
can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, strings

#: The symbol between host and path; no character has this number.
BORDER = 0x110000
_RUN, _ANY_RUN, _ONE = -1, -2, -3


@dataclass(frozen=True)
class Rule:
    """verdict for URLs whose host, behind a dot, fits ``host`` and whose path fits ``path``. Rules outrank defaults (``ranked``)."""

    host: str
    path: str
    verdict: str
    name: str
    ranked: bool = True


def prefix_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, _, path = text.partition("/")
    quote = lambda s: "".join(f"\\{c}" if c in "*?\\" else c for c in s)
    return Rule(f"*.{quote(host)}", f"/{quote(path)}*", verdict, text)


def _tokens(glob: str) -> list[int]:
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            out.append(ord(glob[i + 1]))
            i += 2
        elif glob.startswith("**", i):
            out.append(_ANY_RUN)
            i += 2
        else:
            out.append({"*": _RUN, "?": _ONE}.get(glob[i], ord(glob[i])))
            i += 1
    return out


class Automaton:
    """The rules' bit masks. At most some hundred thousand rules: memory is symbols x words."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        symbols = [[*_tokens(r.host), BORDER, *_tokens(r.path)] for r in rules]
        named = sorted({t for s in symbols for t in s if t >= 0})
        #: Class 0 stands for every symbol that no rule names.
        self.named = np.array(named, np.uint32)
        bits = sum(1 + sum(t not in (_RUN, _ANY_RUN) for t in s) for s in symbols)
        self.words = max(1, -(-bits // 64))
        kinds = len(named) + 1
        border = named.index(BORDER) + 1 if named else 0
        fits, stays = np.zeros((kinds, self.words * 64), bool), np.zeros((kinds, self.words * 64), bool)
        start, self.accepts, at = np.zeros(self.words * 64, bool), [], 0
        for s in symbols:
            start[at] = True
            for t in s:
                if t in (_RUN, _ANY_RUN):
                    stays[:, at] = True
                    if t == _RUN:
                        stays[border, at] = False
                else:
                    at += 1
                    if t == _ONE:
                        fits[:, at] = True
                        fits[border, at] = False
                    else:
                        fits[named.index(t) + 1, at] = True
            self.accepts.append(at)
            at += 1
        self.fits, self.stays, self.start = map(self._packed, (fits, stays, start))
        # better rules come later
        self.order = sorted(range(len(rules)), key=lambda i: (rules[i].ranked, len(rules[i].name), -i))

    def _packed(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x, axis=-1, bitorder="little").view("<u8")

    def states(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The states after each whole canonical URL."""
        texts = [f".{h}\0{p}" for h, p in zip(hosts, paths, strict=True)]
        n = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-n, kind="stable")
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        begins = np.concatenate([[0], np.cumsum(n)[:-1]])
        points[begins + np.array([len(h) for h in hosts], np.int64) + 1] = BORDER
        at = np.searchsorted(self.named, points)
        at[at == len(self.named)] = 0
        kind = np.where(self.named[at] == points, at + 1, 0) if len(self.named) else np.zeros(len(points), np.int64)
        state = np.tile(self.start, (len(texts), 1))
        begins, left = begins[order], n[order]
        active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
        for t, k in enumerate(active):
            c, s = kind[begins[:k] + t], state[:k]
            shifted = s << np.uint64(1)
            shifted[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:k] = (shifted & self.fits[c]) | (s & self.stays[c])
        out = np.empty_like(state)
        out[order] = state
        return out

    def best(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The number of each URL's best rule, -1 where none fits."""
        state, best = self.states(hosts, paths), np.full(len(hosts), -1)
        for i in self.order:
            word, bit = divmod(self.accepts[i], 64)
            best[(state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1] = i
        return best


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


def judge(df: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule (its name, null where no ranked rule fits), verdict and pattern (the name of whatever decided, null: the default)."""
    bounded_batches(df.sparkSession, 10_000)
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string())])
    made: list[Automaton] = []

    def judged(b: pa.RecordBatch):
        if not made:
            made.append(Automaton(rules))
        parts = [split_url(u) for u in strings(b.column(1))]
        hosts, paths = [h for h, _ in parts], [p for _, p in parts]
        won = [rules[i] if i >= 0 else None for i in made[0].best(hosts, paths)]
        return b.column(0), hosts, paths, [r.name if r and r.ranked else None for r in won], [r.verdict if r else default for r in won], [r.name if r else None for r in won]

    kind = df.schema[key].dataType
    src = df.select(F.col(key), F.col(url))
    out = f"`{key}` {kind.simpleString()}, host string, path string, rule string, verdict string, pattern string"

    def over(it):
        first = True
        f = None
        for b in it:
            if first:
                f, first = batches(pa.schema([(key, b.schema.types[0]), *schema]), judged), False
            yield from f(iter([b]))

    return src.mapInArrow(over, out)


#: The production rules, and the host globs that decide where no rule fits.
RULES = [
    prefix_rule("org/", "allow"),
    prefix_rule("example.org/es/", "block"),
    prefix_rule("example.org/en/1", "block"),
    prefix_rule("com/fr/", "allow"),
    prefix_rule("com/de/", "block"),
    Rule("*.spam-*", "**", "block", "*.spam-*", False),
    Rule("*.casino-*", "**", "block", "*.casino-*", False),
    Rule("*.*-bets.*", "**", "block", "*.*-bets.*", False),
    Rule("*.ads-*", "**", "block", "*.ads-*", False),
]

SQL = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), s AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path
  FROM s
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule,
    CASE WHEN ('.' || host) LIKE '%.casino-%' THEN '*.casino-*'
         WHEN ('.' || host) LIKE '%.%-bets.%' THEN '*.*-bets.*'
         WHEN ('.' || host) LIKE '%.spam-%' THEN '*.spam-*'
         WHEN ('.' || host) LIKE '%.ads-%' THEN '*.ads-*' END AS other
  FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN other IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(rule, other) AS pattern
FROM r
"""
