"""Secret scans: fixed patterns, and a randomness test battery that adds spans. DataFrame functions only.

Candidates are runs of 20 or more symbols of the base-64 alphabets. The narrowest alphabet that
holds a candidate is its encoding (hex, base-32, lower- or upper-case alphanumerics, base-62, base-64 of either
kind; runs of decimal digits alone are numbers, not candidates). Three tests ask how far it is from clean
identifiers of that encoding (words put together in the usual styles), towards random symbols:

* the chi-squared statistic of uniformity over the alphabet, per symbol;
* runs of lower case, upper case and digits: the share of places where the class changes (signs left out);
* lag-1 serial correlation of symbol values.

Each statistic x of n symbols has a null mean a + b / n and deviation s / sqrt(n), fitted per encoding on some 70,000 clean
identifiers of 20 to 48 symbols (base-62: a ninth of them of words of two to five letters with capitals, which change class most), and a weight (the linear discriminant against random strings of the encoding, over
the tests' joint covariances, scaled so that the weighted sum has deviation 1 on clean identifiers). The sum is the
candidate's score. A document's candidates are judged together: Benjamini-Hochberg at a
false-discovery rate of RATE, with p-values weighted by candidate length, for longer runs carry
more evidence. Judging is per document, so nothing is shuffled.

Base spans, leftmost and not overlapping per kind, always stay; found spans are added, as kind
``random``, where they overlap no base span.

Defined results: a null text is an empty one and has no spans. Positions are code points, ends
exclusive. Whole texts of any length are read. Repeated rows get repeated results. Only the
named columns are used, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
RATE = 7.5e-3

#: Fixed patterns. A shorter match of access or hex is dropped whole, so their least lengths can stand in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"

#: Of each encoding: its pattern and number of symbols; of each test (uniformity, runs, serial correlation) a, b and s; the tests' weights.
ENCODINGS = (
    ("^(?:[0-9a-f]+|[0-9A-F]+)$", 16, ((1.2146, 20.4351, 5.3083), (0.1075, -0.0990, 0.2317), (0.7416, -2.1871, 0.6646)), (-0.670, 0.447, -0.454)),
    ("^[A-Z2-7]+$", 32, ((1.6204, 28.7379, 3.3642), (0.0432, -0.2623, 0.2839), (-0.0625, -1.0178, 0.9836)), (-0.797, 0.407, 0.119)),
    ("^(?:[a-z0-9]+|[A-Z0-9]+)$", 36, ((1.6598, 31.9407, 4.1157), (0.0448, -0.0949, 0.2579), (0.2563, -3.2193, 1.7608)), (-0.827, 0.626, -0.545)),
    ("^[A-Za-z0-9]+$", 62, ((2.8370, 57.2660, 6.1767), (0.2631, -0.6732, 0.5243), (0.1642, -3.2873, 1.7776)), (-0.657, 0.693, 0.013)),
    ("", 64, ((3.6448, 52.7148, 6.5618), (0.0447, -0.0299, 0.4393), (0.0230, -1.6641, 1.3531)), (-0.321, 0.797, 0.038)),
)
ORDER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"
BLOCK = 128

_SPAN = "array<struct<start:int,end:int,s:string>>"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _placed(name: str) -> str:
    """The matches {name}_m between the pieces {name}_p of the text, with their places.

    Ends are running sums on two levels, blocks of BLOCK matches and matches of a block, so many matches
    of one text take neither a growing array nor a sum over all before each.
    """
    m, p = f"{name}_m", f"{name}_p"
    end = f"z + aggregate(slice(l, b * {BLOCK} + 1, i + 1), 0, (a, y) -> a + y)"
    span = _let(end, "e", f"named_struct('start', e - length({m}[b * {BLOCK} + i]), 'end', e, 's', {m}[b * {BLOCK} + i])")
    block = _let("aggregate(slice(s, 1, b), 0, (a, y) -> a + y)", "z", f"transform(slice(l, b * {BLOCK} + 1, {BLOCK}), (x, i) -> {span})")
    sums = f"transform(sequence(0, int((size(l) - 1) / {BLOCK})), b -> aggregate(slice(l, b * {BLOCK} + 1, {BLOCK}), 0, (a, y) -> a + y))"
    spans = _let(_let(p, "q", f"transform({m}, (x, i) -> length(q[i]) + length(x))"), "l", _let(sums, "s", f"flatten(transform(sequence(0, size(s) - 1), b -> {block}))"))
    return f"CASE WHEN size({m}) = 0 THEN cast(array() AS {_SPAN}) ELSE {spans} END"


def _encoding() -> str:
    """The place of the candidate c.s in ENCODINGS."""
    return "CASE " + " ".join(f"WHEN c.s RLIKE {_sql(e[0])} THEN {k}" for k, e in enumerate(ENCODINGS[:-1])) + f" ELSE {len(ENCODINGS) - 1} END"


def _of(values) -> str:
    """The value of the candidate's encoding c.e."""
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")[c.e]"


def _score(tests: tuple[str, str, str]) -> str:
    """The weighted sum of the standardised tests of a candidate c of c.n symbols."""
    z = [f"{_of(e[3][k] for e in ENCODINGS)} * ({x} - {_of(e[2][k][0] for e in ENCODINGS)} - {_of(e[2][k][1] for e in ENCODINGS)} / c.n) * sqrt(c.n) / {_of(e[2][k][2] for e in ENCODINGS)}" for k, x in enumerate(tests)]
    return " + ".join(z)


def _tail(z: str) -> str:
    """P(normal > z) for z >= 0, to 7 digits."""
    t = f"(1 / (1 + 0.2316419D * {z}))"
    return f"exp(-{z} * {z} / 2) * 0.3989422804014327D * {t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"


def find(df: DataFrame, *, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """key, counts and digest of the base spans, and all spans."""
    t = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    patterns = {"a": ASSIGN, "k": ACCESS, "h": HEX, "c": CANDIDATE}
    t = t.selectExpr("_key", "t", *[f"regexp_extract_all(t, {_sql(p)}, 0) AS {n}_m" for n, p in patterns.items()])
    t = t.selectExpr("_key", *[f"{n}_m" for n in patterns], *[f"CASE WHEN size({n}_m) > 0 THEN split(t, {_sql(p)}, -1) END AS {n}_p" for n, p in patterns.items()])
    t = t.selectExpr("_key", *[f"{_placed(n)} AS {n}" for n in patterns])
    t = t.selectExpr(
        "_key",
        f"transform(filter(a, x -> length(regexp_extract(x.s, {_sql(ASSIGN)}, 1)) >= 6), x -> named_struct('start', x.start, 'kind', 0, 'end', x.end)) AS a",
        "transform(k, x -> named_struct('start', x.start, 'kind', 1, 'end', x.end)) AS k",
        "transform(h, x -> named_struct('start', x.start, 'kind', 2, 'end', x.end)) AS h",
        "filter(c, x -> NOT x.s RLIKE '^[0-9]+$') AS c",
    )
    t = t.selectExpr("_key", "size(a) AS n_a", "size(k) AS n_k", "size(h) AS n_h", "array_sort(concat(a, k, h)) AS base", "c")
    # the battery, on the few rows with candidates
    t = t.selectExpr(
        "_key", "n_a", "n_k", "n_h", "base",
        f"""transform(c, c -> named_struct('start', c.start, 'end', c.end, 'n', double(length(c.s)), 'e', {_encoding()},
          'squares', aggregate(array_distinct(split(c.s, '')), 0D, (a, x) -> a + pow(length(c.s) - length(replace(c.s, x, '')), 2)),
          'runs', length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c.s, '[+/_-]+', ''), '[a-z]+', 'a'), '[A-Z]+', 'A'), '[0-9]+', '0')),
          'v', transform(split(c.s, ''), x -> double(instr('{ORDER}', x))))) AS c""",
    )
    t = t.selectExpr("_key", "n_a", "n_k", "n_h", "base", "transform(c, c -> named_struct('start', c.start, 'end', c.end, 'n', c.n, 'e', c.e, 'squares', c.squares, 'runs', c.runs, 'v', c.v, 'm', aggregate(c.v, 0D, (a, x) -> a + x) / c.n)) AS c")
    serial = """coalesce(try_divide(aggregate(zip_with(slice(c.v, 1, size(c.v) - 1), slice(c.v, 2, size(c.v) - 1), (x, y) -> (x - c.m) * (y - c.m)), 0D, (a, x) -> a + x),
                 aggregate(c.v, 0D, (a, x) -> a + (x - c.m) * (x - c.m))), 1D)"""
    tests = (f"(({_of(e[1] for e in ENCODINGS)} * c.squares / c.n - c.n) / c.n)", "(greatest(c.runs - 1, 0) / (c.n - 1))", serial)
    t = t.selectExpr(
        "_key", "n_a", "n_k", "n_h", "base",
        f"transform(c, c -> named_struct('start', c.start, 'end', c.end, 'n', c.n, 'z', {_score(tests)})) AS c",
        "aggregate(c, 0D, (a, x) -> a + x.n) / greatest(size(c), 1) AS mean",
    )
    t = t.selectExpr("_key", "n_a", "n_k", "n_h", "base", f"array_sort(transform(c, c -> named_struct('p', CASE WHEN c.z >= 0 THEN {_tail('c.z')} ELSE 1 - ({_tail('(-c.z)')}) END * mean / c.n, 'start', c.start, 'end', c.end))) AS c")
    t = t.selectExpr("_key", "n_a", "n_k", "n_h", "base", f"CASE WHEN size(c) = 0 THEN c ELSE slice(c, 1, aggregate(sequence(1, size(c)), 0, (a, k) -> CASE WHEN c[k - 1].p <= {rate!r}D * k / size(c) THEN k ELSE a END)) END AS c")
    t = t.selectExpr("_key", "n_a", "n_k", "n_h", "base", "array_sort(concat(base, transform(filter(c, x -> NOT exists(base, b -> x.start < b.end AND b.start < x.end)), x -> named_struct('start', x.start, 'kind', 3, 'end', x.end)))) AS spans")
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = f"array_join(transform({{}}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"
    return t.selectExpr(f"_key AS `{key}`", "bigint(n_a) AS n_assign", "bigint(n_k) AS n_access", "bigint(n_h) AS n_hex", f"sha2({joined.format('base')}, 256) AS base_sha256", f"{joined.format('spans')} AS spans")


def query(docs: DataFrame) -> DataFrame:
    return find(docs)
