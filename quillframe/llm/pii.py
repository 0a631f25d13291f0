"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field gives a probability to every segmentation of a text's tokens into entities and single
tokens of no type. Its exponent sums, over segments, weights of features of the whole span (its
digits, separators and grouping, checksum, part ranges, at-signs and domain, the symbols on both
sides, the nearest cue word in the CUE_TOKENS before) and a weight of the previous segment's type
and this one's. Candidates for entities are spans of up to LONGEST tokens within a line that no letter or digit
touches: with an at-sign, without white space, between two letters or digits (email); or of
digits, spaces and ``().+-`` alone, with four digits or more (the other kinds).

Weights maximise the likelihood of TRAINING sentences made by rule from a seed, less an L2 term:
gradients are observed less expected features, and the expectations come from forward and
backward sums over all segmentations. Any run on any machine has the same model.

``decode`` finds the best segmentation by dynamic programming over (token border, previous
type), which chooses boundaries and types jointly. Away from candidates all tokens are of no type,
so the program runs over clusters of candidates that lie on each other or side by side; between
clusters lies a token of no type, so the clusters' best paths are the whole text's.

Base spans, leftmost and not overlapping per kind, always stay; the field's spans are added
where they overlap no base span.

Defined results: a null text is an empty one and has no spans. Positions are code points, ends
exclusive. Whole texts of any length are read. Repeated rows get repeated results. Only the
named columns are used, so names can't clash.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, strings, trimmed

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most, tokens before it that are searched for a cue, and made sentences to train on.
LONGEST, CUE_TOKENS, TRAINING = 16, 8, 450

_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TRIGGER = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The spans of local@domain, found from their at-signs: a local part is the longest run that ends there."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() <= 37 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# -- the field ---------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
#: Words that announce a kind.
CUES = {"mail": 0, "email": 0, "contact": 0, "ip": 1, "host": 1, "address": 1, "card": 2, "visa": 2, "credit": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3}


_NUMERIC = frozenset("0123456789 ().+-")
NONE = len(KINDS)


def _kind_of(c: str) -> str:
    """A symbol's class; tokens are runs of letters, digits or white space, or single others."""
    if "0" <= c <= "9":
        return "digit"
    if c.isspace():
        return "space"
    return "letter" if c.isalnum() and not c.isdecimal() else ""


def _before(text: str, at: int) -> int:
    """The begin of the token that ends at a border."""
    kind, a = _kind_of(text[at - 1]), at - 1
    while kind and a and _kind_of(text[a - 1]) == kind:
        a -= 1
    return a


def _cue(text: str, at: int) -> int | None:
    """The kind that the nearest cue word before a border announces."""
    for _ in range(CUE_TOKENS):
        if not at:
            return None
        a = _before(text, at)
        if (found := CUES.get(text[a:at].lower())) is not None:
            return found
        at = a
    return None


def _regions(text: str) -> list[list[int]]:
    """Token borders of the stretches that candidates can lie in: LONGEST tokens around digits and at-signs, to the ends of the line."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() < out[-1][-1] and (m.end() <= out[-1][-1]):
            begin = out[-1]
        else:
            floor, at, left = out[-1][-1] if out else 0, m.start(), [m.start()]
            for _ in range(LONGEST - 1):
                if at <= floor:
                    break
                at = _before(text, at)
                if "\n" in text[at : left[-1]]:
                    break
                left.append(at)
            if out and left[-1] <= floor:
                begin = out[-1]
                begin += [x for x in left[::-1] if x > floor]
            else:
                out.append(begin := left[::-1])
        # up to LONGEST - 1 tokens behind the trigger's last one
        at, n = begin[-1], 0
        if at < m.end():
            for t in _TOKEN.finditer(text, at):
                if "\n" in t.group() or n == LONGEST - 1 and t.start() >= m.end():
                    break
                begin.append(t.end())
                n += t.start() >= m.end()
        else:
            n = sum(1 for x in begin if x > m.end())
            for t in _TOKEN.finditer(text, at):
                if "\n" in t.group() or n >= LONGEST - 1:
                    break
                begin.append(t.end())
                n += 1
    return out


def _candidates(text: str) -> list[tuple[list[int], list[tuple[int, int, int]]]]:
    """The clusters of candidates: token borders, and candidates (kind, first border's number, last one's)."""
    out: list[tuple[list[int], list[tuple[int, int, int]]]] = []
    for ends in _regions(text):
        found: list[tuple[int, int, int]] = []
        for i in range(len(ends) - 1):
            first = text[ends[i]]
            if ends[i] and text[ends[i] - 1].isalnum():
                continue
            if first.isalnum():  # an email's begin, perhaps
                sign = False
                for j in range(i + 1, min(len(ends) - 1, i + LONGEST) + 1):
                    t = text[ends[j - 1]]
                    if t.isspace():
                        break
                    sign |= t == "@"
                    if sign and t.isalnum() and not text[ends[j] : ends[j] + 1].isalnum():
                        found.append((0, i, j))
            if first in "+(" or "0" <= first <= "9":
                digits = 0
                for j in range(i + 1, min(len(ends) - 1, i + LONGEST) + 1):
                    t = text[ends[j - 1] : ends[j]]
                    if not _NUMERIC.issuperset(t):
                        break
                    if "0" <= t[0] <= "9":
                        digits += len(t)
                        if digits >= 4 and not text[ends[j] : ends[j] + 1].isalnum():
                            found += [(k, i, j) for k in (1, 2, 3)]
        last, at = -1, 0
        for kind, i, j in sorted(found, key=lambda x: x[1]):
            if i > last:
                out.append((ends, []))
                at = i
            last = max(last, j)
            out[-1][1].append((kind, i, j))
    clusters = []
    for ends, found in out:
        at, last = min(i for _, i, _ in found), max(j for *_, j in found)
        clusters.append((ends[at : last + 1], [(k, i - at, j - at) for k, i, j in found]))
    return clusters


def _span_features(kind: int, s: str, before: str, after: str, cue: int | None) -> list[str]:
    """Features of the whole span s as the kind; before and after: the symbols beside it."""
    d = _digits(s)
    k = KINDS[kind]
    other = {c for c in s if not c.isdigit() and not c.isalpha()}
    f = [f"{k}:bias", f"{k}:digits{min(len(d), 20)}", f"{k}:edge{int(before.isalnum())}{int(after.isalnum())}", f"{k}:sign{int(before in '$€£#%=:/' and before != '')}{int(after in '%€$°')}"]
    if cue is not None:
        f.append(f"{k}:cue{int(cue == kind)}")
    letters = any(c.isalpha() for c in s)
    f.append(f"{k}:letters{int(letters)}")
    f.append(f"{k}:ends{int(s[0].isalnum() or s[0] in '+(')}{int(s[-1].isalnum())}")
    if kind == 0:
        local, at, domain = s.partition("@")
        f.append(f"{k}:at{s.count('@')}{int(bool(local))}{int('.' in domain.strip('.'))}{int(' ' in s)}")
        f.append(f"{k}:top{int(domain.rpartition('.')[2].isalpha() and len(domain.rpartition('.')[2]) >= 2)}")
    elif kind == 1:
        parts = s.split(".")
        f.append(f"{k}:parts{min(len(parts), 6)}{int(all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts))}")
    elif kind == 2:
        f.append(f"{k}:luhn{int(len(d) >= 13 and luhn(d))}{int(other <= {' ', '-'})}{int(len(other) <= 1)}")
        groups = [len(g) for g in re.split(r"[ -]", s)]
        f.append(f"{k}:groups{int(groups in ([4, 6, 5], [4, 4, 4, 4], [4, 4, 4, 1], [len(s)]))}")
    else:
        groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
        f.append(f"{k}:form{int('(' in s)}{int(s.count('(') == s.count(')'))}{min(len(groups), 6)}{int(other <= set(' ().-+'))}{int('+' in s[1:])}")
        f.append(f"{k}:last{min(groups[-1], 6) if groups else 0}:first{min(groups[0], 6) if groups else 0}")
        f.append(f"{k}:luhn{int(len(d) >= 13 and luhn(d))}")
    return f


def _featured(text: str, ends: list[int], found: list[tuple[int, int, int]]) -> list[list[str]]:
    """Each candidate's features."""
    cues: dict[int, int | None] = {}
    out = []
    for kind, i, j in found:
        a, b = ends[i], ends[j]
        if i not in cues:
            cues[i] = _cue(text, a)
        out.append(_span_features(kind, text[a:b], text[a - 1] if a else "", text[b] if b < len(text) else "", cues[i]))
    return out


def _turn(before: int, after: int) -> str:
    """The feature of two neighbouring segments' types; two of no type have none."""
    return f"turn{before}{after}"


def decode(text: str, w: dict[str, float]) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (kind, start, end) of a whole text."""
    turns = [[w.get(_turn(x, y), 0.0) for y in range(NONE + 1)] for x in range(NONE + 1)]
    out = []
    for ends, found in _candidates(text):
        n = len(ends) - 1
        ending: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for (kind, i, j), f in zip(found, _featured(text, ends, found), strict=True):
            ending[j].append((i, kind, sum([w.get(x, 0.0) for x in f])))
        low = float("-inf")
        best = [[low] * (NONE + 1) for _ in range(n + 1)]
        back: list[list[tuple[int, int]]] = [[(0, NONE)] * (NONE + 1) for _ in range(n + 1)]
        best[0][NONE] = 0.0
        for j in range(1, n + 1):
            for i, kind, score in [(j - 1, NONE, 0.0), *ending[j]]:
                for y, here in enumerate(best[i]):
                    if here > low and here + turns[y][kind] + score > best[j][kind]:
                        best[j][kind], back[j][kind] = here + turns[y][kind] + score, (i, y)
        y = max(range(NONE + 1), key=lambda y: best[n][y] + turns[y][NONE])
        j, own = n, []
        while j:
            i, x = back[j][y]
            if y != NONE:
                own.append((y, ends[i], ends[j]))
            j, y = i, x
        out += own[::-1]
    return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of a sum of exponentials; some of them may be 0."""
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def expected(n: int, found: list[tuple[int, int, int]], scores: np.ndarray, turns: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log of the sum over all segmentations, each candidate's probability, expected turns) of a cluster of n tokens."""
    with np.errstate(divide="ignore"):
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (_, i, j) in enumerate(found):
            ending[j].append(c)
            starting[i].append(c)
        alpha, into = np.full((n + 1, NONE + 1), -np.inf), np.empty((n + 1, NONE + 1))
        alpha[0, NONE] = 0.0
        for j in range(n + 1):
            if j:
                alpha[j, NONE] = into[j - 1, NONE]
                for c in ending[j]:
                    kind, i, _ = found[c]
                    alpha[j, kind] = np.logaddexp(alpha[j, kind], scores[c] + into[i, kind])
            into[j] = _sum(alpha[j][:, None] + turns, 0)
        total = into[n, NONE]
        beta, chance = np.empty((n + 1, NONE + 1)), np.zeros(len(found))
        beta[n] = turns[:, NONE]
        count = np.exp(alpha[n] + turns[:, NONE] - total)[:, None] * np.eye(NONE + 1)[NONE]
        for i in range(n - 1, -1, -1):
            ways = np.full(NONE + 1, -np.inf)  # by the next segment's type: all that follows
            ways[NONE] = beta[i + 1, NONE]
            for c in starting[i]:
                kind, _, j = found[c]
                w = scores[c] + beta[j, kind]
                ways[kind] = np.logaddexp(ways[kind], w)
                chance[c] = np.exp(into[i, kind] + w - total)
            both = turns + ways[None, :]
            beta[i] = _sum(both, 1)
            count += np.exp(alpha[i][:, None] + both - total)
    return float(total), chance, count


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made sentence and its entities, among numbers that are none."""
    num = lambda k: str(r.randint(1, 9)) + "".join(r.choice("0123456789") for _ in range(k - 1))
    word = lambda: "".join(r.choice(["an", "er", "tion", "le", "ou", "ch", "di", "ra"]) for _ in range(r.randint(1, 4)))

    def card(n):
        d = num(n - 1)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def grouped(d, sizes, sep):
        out, i = [], 0
        for k in sizes:
            out.append(d[i : i + k])
            i += k
        return sep.join(out)

    def entity():
        kind = r.choice((0, 0, 1, 2, 2, 3, 3, 3))
        if kind == 0:
            return kind, f"{word()}{r.choice(['', '.', '_', '+'])}{r.choice(['', word(), num(2)])}1@{word()}{r.choice(['', num(1)])}.{r.choice(['com', 'org', 'example.net', 'de'])}".replace("1@", "@")
        if kind == 1:
            return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            if r.random() < 0.3:
                return kind, grouped(card(15), (4, 6, 5), r.choice(["", " ", "-"]))
            return kind, grouped(card(16), (4, 4, 4, 4), r.choice(["", " ", "-"]))
        return kind, r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(2)} {num(3)} {num(4)}{num(2)}", f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}"])

    def plain():
        return r.choice([
            num(r.randint(1, 12)), f"{num(2)}.{num(2)}", f"{num(1)},{num(3)}.{num(2)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            f"{r.randint(10, 23)}:{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(1)}", f"{num(3)}%", f"${num(4)}", f"{num(16)[:15]}{num(3)}{num(4)}", f"id{num(8)}", f"{word()}{num(3)}",
            f"{num(3)} {num(3)}", f"{num(4)}-{num(4)}", f"{num(2)}/{num(2)}/{num(4)}", f"@{word()}", f"a @ {num(1)}", f"{word()}@{word()}", f"300.{num(3)}.400.{num(3)}", f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}",
            f"{num(3)}, {num(3)}, {num(4)}", f"{num(5)} {num(2)} {num(1)} {num(6)}", f"({num(2)})", f"{num(2)}-{num(2)}-{num(2)}-{num(2)}-{num(2)}-{num(2)}",
            '"' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice((24, 32, 40)))) + '"', "".join(r.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(16, 44))),
            "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 24, 32, 40)))),
        ])

    text, spans = "", []
    for _ in range(r.randint(1, 4)):
        text += " ".join(r.choice([word(), word(), r.choice(list(CUES))]) for _ in range(r.randint(1, 5))) + r.choice([" ", " ", ": "])
        if r.random() < 0.5:
            kind, s = entity()
            spans.append((kind, len(text), len(text) + len(s)))
        else:
            s = plain()
        text += s + r.choice([" ", ". ", ", ", "\n"])
    return text, spans


def _lattice(text: str, gold, index: dict[str, int]):
    """A text's clusters for training: (n, candidates, their features' numbers, which are gold, gold's turns)."""
    out = []
    for ends, found in _candidates(text):
        number = lambda f: index.setdefault(f, len(index))
        features = [np.array([number(x) for x in f]) for f in _featured(text, ends, found)]
        spans = [(k, ends[i], ends[j]) for k, i, j in found]
        is_gold = np.array([x in gold for x in spans])
        path, at = [NONE], 0
        for (k, i, j), g in sorted(zip(found, is_gold, strict=True), key=lambda x: x[0][1]):
            if g:
                path += [NONE] * (i - at) + [k]
                at = j
        path += [NONE] * (len(ends) - 1 - at) + [NONE]
        turns = np.zeros((NONE + 1, NONE + 1))
        np.add.at(turns, (path[:-1], path[1:]), 1)
        out.append((len(ends) - 1, found, features, is_gold, turns))
    return out


def train(n: int = TRAINING, seed: int = 11, epochs: int = 8, rate: float = 0.5, penalty: float = 0.02) -> dict[str, float]:
    """Weights of the greatest penalised likelihood of made sentences, by adaptive gradient steps."""
    r = random.Random(seed)
    index: dict[str, int] = {}
    data = [x for text, gold in (_sentence(r) for _ in range(n)) for x in _lattice(text, set(gold), index)]
    w, past = np.zeros(len(index)), np.full(len(index), 1e-2)
    turns, turns_past = np.zeros((NONE + 1, NONE + 1)), np.full((NONE + 1, NONE + 1), 1e-2)
    order = list(range(len(data)))
    for _ in range(epochs):
        r.shuffle(order)
        for k in order:
            size, found, features, gold, path = data[k]
            _, chance, count = expected(size, found, np.array([w[f].sum() for f in features]), turns)
            g = np.zeros(len(index))
            for f, p, y in zip(features, chance, gold, strict=True):
                g[f] += p - y
            g += penalty / len(data) * w
            past += g * g
            w -= rate * g / np.sqrt(past)
            g = count - path + penalty / len(data) * turns
            g[NONE, NONE] = 0.0
            turns_past += g * g
            turns -= rate * g / np.sqrt(turns_past)
    out = {f: float(w[k]) for f, k in index.items()}
    return out | {_turn(x, y): float(turns[x, y]) for x in range(NONE + 1) for y in range(NONE + 1) if (x, y) != (NONE, NONE)}


_WEIGHTS: list[dict[str, float]] = []


def weights() -> dict[str, float]:
    """The trained weights; trained once in a process."""
    if not _WEIGHTS:
        _WEIGHTS.append(train())
    return _WEIGHTS[0]


def all_spans(text: str, w: dict[str, float]) -> tuple[list, list]:
    """Base spans, and base and added spans, both as (kind, start, end) by kind, then start."""
    if _TRIGGER.search(text) is None:
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    furthest = list(accumulate((b for _, b in taken), max))
    added = []
    for kind, a, b in decode(text, w):
        k = bisect(taken, (a, b))  # taken spans of different kinds may overlap, so begins and ends are kept apart
        if (k == len(taken) or taken[k][0] >= b) and (not k or furthest[k - 1] <= a):
            added.append((kind, a, b))
    return base, sorted(base + added)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts and digest of the base spans, and all spans."""
    spark = df.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(weights())  # some hundred numbers

    def over(it):
        for b in it:
            if b.num_rows:
                found = [all_spans(t, shipped.value) for t in strings(b.column(1))]
                counts = [pa.array([sum(k == kind for k, *_ in base) for base, _ in found], pa.int64()) for kind in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x, _ in found]), pa.array([_joined(x) for _, x in found])], names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return df.select(F.col(key), F.col(text)).mapInArrow(over, f"`{key}` {df.schema[key].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(df: DataFrame, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """df with each span replaced by its kind in angle brackets, and the length column brought up to date; a null text stays null."""
    spark = df.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(weights())
    names = df.columns

    def hidden(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for a, b, kind in sorted((a, b, k) for k, a, b in all_spans(t, shipped.value)[1]):
            if b <= at:
                continue
            out += [t[at : max(a, at)], f"<{KINDS[kind]}>"]
            at = b
        return "".join([*out, t[at:]]) if out else t

    def over(it):
        for b in it:
            if b.num_rows:
                new = [hidden(t) for t in b.column(names.index(text)).to_pylist()]
                cols = {text: pa.array(new, pa.string())}
                if length in names:
                    cols[length] = pa.array([None if t is None else len(t) for t in new], b.schema.field(length).type)
                yield pa.RecordBatch.from_arrays([cols.get(n, b.column(i)) for i, n in enumerate(names)], names=names)

    return df.mapInArrow(trimmed(over), df.schema)
