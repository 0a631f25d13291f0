"""Words of unknown symbols against a lexicon: by pattern, by implied equalities, by partial decoding, and votes.

Lexicons are aggregated by pattern before anything is joined, so a join's rows grow with
patterns, not with pairs of words. Patterns and partly decoded words meet a length's whole lexicon at once
in numpy: each condition (two places are equal, or a place has a letter) is one column of truth values over it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .lexicon import patterns, word_counts

#: Marks that may end a word.
MARKS = ".,:;!?"


def words_by(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, word, n: the printable-ASCII words of each group."""
    w = docs.select(by, F.explode(T.tokens(F.col(text))).alias("word"))
    return w.filter("word rlike '^[!-~]+$'").groupBy(by, "word").agg(F.count("*").alias("n"))


def extended(lexicon: DataFrame) -> DataFrame:
    """The lexicon, its words with a capital first letter, and its words without an end mark with each mark behind: distinct."""
    cap = lexicon.filter("word rlike '^[a-z]'").select(F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)")).alias("word"), "n")
    base = lexicon.union(cap)
    marked = base.filter("word not rlike '[.,:;!?]$'").select("word", "n", F.explode(F.array(*[F.lit(m) for m in MARKS])).alias("m")).select(F.concat("word", "m").alias("word"), "n")
    return base.union(marked).groupBy("word").agg(F.max("n").alias("n"))


def isomorphs(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word and n_matches, n_tokens of the lexicon words of its length and exact pattern."""
    lex = patterns(lexicon).groupBy("len", "sig").agg(F.count("*").alias("n_matches"), F.sum("n").alias("n_tokens"))
    return patterns(words).select("word", "len", "sig").join(lex, ["len", "sig"]).select("word", "len", "sig", "n_matches", "n_tokens")


def implied(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """sig, len, n_words, n_matches: lexicon words that are equal wherever a pattern repeats; other letters may coincide."""
    sig = patterns(words).groupBy("len", "sig").agg(F.count("*").alias("n_words"))
    lex = patterns(lexicon).groupBy("len", "sig").agg(F.count("*").alias("n"))

    def needs(sig: str) -> list[tuple[int, int]]:
        first: dict[str, int] = {}
        return [(j, i) for i, x in enumerate(sig.split(".")) if (j := first.setdefault(x, i)) < i]

    found = met(sig.withColumnRenamed("sig", "form"), lex.select("len", F.split("sig", "\\.").cast("array<int>").alias("t"), "n"), needs)
    return sig.join(found.withColumnRenamed("form", "sig"), ["len", "sig"], "left").select("len", "sig", "n_words", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


#: Slabs that the forms of a length are dealt into, parts that they are spread over, and lexicon rows that conditions are held for at once.
SLABS, PARTS, ROWS = 32, 256, 1 << 15


def met(forms: DataFrame, lexicon: DataFrame, needs: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """len, form and n_matches: the summed n of a length's lexicon rows (len, t: symbols as numbers, n) that meet all needs of a form (distinct).

    A need (j, i) asks that places j and i are equal, (-x, i) that place i has symbol x (x > 0).
    """
    slab = F.pmod(F.xxhash64("form"), F.lit(SLABS)).cast("int").alias("slab")
    left = forms.select("len", slab, "form")
    right = lexicon.join(left.select("len").distinct(), "len", "left_semi").select("len", F.explode(F.sequence(F.lit(0), F.lit(SLABS - 1))).alias("slab"), "t", F.col("n").cast("long").alias("n"))

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        asked = [needs(x) for x in a.column("form").to_pylist()]
        total = np.zeros(len(asked), np.int64)
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            t = np.ascontiguousarray(part.column("t").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).T)
            columns: dict[tuple[int, int], np.ndarray] = {}  # eight rows a byte
            n = np.pad(part.column("n").to_numpy(), (0, -part.num_rows % 8)).reshape(-1, 8)
            all_ = np.packbits(np.ones(part.num_rows, bool))
            for k, own in enumerate(asked):
                ok = all_
                for need in own:
                    if need not in columns:
                        if len(columns) * part.num_rows > 1 << 29:
                            columns.clear()
                        columns[need] = np.packbits(t[need[1]] == (t[need[0]] if need[0] >= 0 else -need[0]))
                    ok = ok & columns[need]
                some = np.flatnonzero(ok)
                if len(some):
                    total[k] += (n[some] * np.unpackbits(ok[some]).reshape(-1, 8)).sum()
        return pa.table({"len": a.column("len"), "form": a.column("form"), "n_matches": pa.array(total)})

    left, right = (x.repartition(PARTS, "len", "slab") for x in (left, right))
    return left.groupBy("len", "slab").cogroup(right.groupBy("len", "slab")).applyInArrow(count, "len int, form string, n_matches long")


def votes(words: DataFrame, lexicon: DataFrame, by: str) -> DataFrame:
    """by, c, letter, votes: for each occurrence of a word with cluster c, the share of each letter at c's first place among the lexicon words of the word's pattern."""
    lex = patterns(lexicon).select("len", "sig", "n", F.posexplode(F.split("word", "")).alias("pos", "letter"))
    lex = lex.groupBy("len", "sig", "pos", "letter").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("len", "sig", "pos"))
    lex = lex.select("len", "sig", "pos", "letter", share.alias("share"))
    w = words.select(by, "word", "n", F.length("word").alias("len"), T.numerized(F.col("word")).alias("sig"), F.split("word", "").alias("s"))
    w = w.select(by, "len", "sig", "n", F.explode(F.transform(F.array_distinct("s"), lambda c: F.struct(c.alias("c"), (F.array_position("s", c) - 1).cast("int").alias("pos")))).alias("x"))
    w = w.groupBy(by, "len", "sig", F.col("x.c").alias("c"), F.col("x.pos").alias("pos")).agg(F.sum("n").alias("n"))
    return w.join(lex, ["len", "sig", "pos"]).groupBy(by, "c", "letter").agg(F.sum(F.col("n") * F.col("share")).alias("votes"))


def vote_ranking(found: DataFrame, by: str, best: int = 3) -> DataFrame:
    """The best letters of each cluster by votes, ties by letter; dist is 1 over the votes."""
    v = found.withColumn("votes", F.round("votes", 6))
    v = v.withColumn("rank", F.row_number().over(Window.partitionBy(by, "c").orderBy(F.desc("votes"), "letter")))
    return v.filter(F.col("rank") <= best).select(by, "c", "rank", "letter", "votes", F.round(F.when(F.col("votes") > 0, 1 / F.col("votes")).otherwise(1 / 2.220446049250313e-16), 9).alias("dist"))


def masked(words: DataFrame, by: str, known: int) -> DataFrame:
    """words with mask: their symbols that are among the group's `known` most frequent ones, others as null places with their pattern."""
    s = words.select(by, "n", F.explode(F.split("word", "")).alias("c")).groupBy(by, "c").agg(F.sum("n").alias("k"))
    top = s.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("k"), "c"))).filter(F.col("r") <= known)
    key = top.groupBy(by).agg(F.collect_set("c").alias("key"))  # `known` symbols
    x = words.join(key, by).withColumn("s", F.split("word", ""))
    return x.withColumn("mask", F.transform("s", lambda c: F.when(F.array_contains("key", c), c)))


def vp_matches(words: DataFrame, lexicon: DataFrame, by: str, known: int = 12) -> DataFrame:
    """by, word, n, matched: whether a lexicon word of the word's length has its known letters in place and repeats letters where unknown symbols repeat."""
    m = masked(words, by, known).withColumn("len", F.size("s"))
    sym = "concat_ws(' ', transform(s, (x, i) -> coalesce(mask[i], concat('?', array_position(s, x)))))"
    m = m.withColumn("form", F.expr(sym))
    lex = lexicon.select("word").distinct().withColumn("t", F.transform(F.split("word", ""), F.ascii))
    lex = lex.select(F.size("t").alias("len"), "t", F.lit(1).alias("n"))

    def needs(form: str) -> list[tuple[int, int]]:
        parts = enumerate(form.split(" "))
        return [need for i, x in parts if (need := (int(x[1:]) - 1, i) if len(x) > 1 else (-ord(x), i))[0] != i]

    hit = met(m.select("len", "form").distinct(), lex, needs).filter("n_matches > 0").select("form")
    return m.join(hit.withColumn("hit", F.lit(1)), "form", "left").select(by, "word", "n", F.col("hit").isNotNull().alias("matched"), "s")


def vp_ratio(matches: DataFrame, by: str) -> DataFrame:
    """by, c, n_words, n_matched, ratio over the words that hold cluster c, each occurrence once."""
    x = matches.select(by, "n", "matched", F.explode(F.array_distinct("s")).alias("c"))
    g = x.groupBy(by, "c").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("matched"), F.col("n")).otherwise(0)).alias("n_matched"))
    return g.withColumn("ratio", F.round(F.col("n_matched") / F.col("n_words"), 9))


_docs = lambda s, d: table(s, d, "documents")
_ascii = lambda df: df.filter("word rlike '^[!-~]+$'")
_lex = lambda s, d: _ascii(word_counts(table(s, d, "conversations")))
_word = lambda s, d: _ascii(word_counts(_docs(s, d)))


def _tok(name: str, src: str, extra: str = "") -> str:
    return rf"{name}0 AS (SELECT {extra}unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS word FROM {src}), {name} AS (SELECT {extra}word, count(*)::BIGINT AS n FROM {name}0 WHERE regexp_matches(word, '^[!-~]+$') GROUP BY ALL)"


def _sig(name: str) -> str:
    return f"""{name}s AS (SELECT word, n, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM (SELECT word, sum(n)::BIGINT AS n FROM {name} GROUP BY 1)),
      {name}f AS (SELECT *, min(i) OVER (PARTITION BY word, c) AS f FROM {name}s), {name}g AS (SELECT *, dense_rank() OVER (PARTITION BY word ORDER BY f) AS r FROM {name}f),
      {name}p AS (SELECT word, n, length(word)::INT AS len, string_agg(r::VARCHAR, '.' ORDER BY i) AS sig, list(r ORDER BY i) AS rs FROM {name}g GROUP BY word, n)"""


BASE = f"WITH {_tok('w', 'documents')}, {_tok('x', 'conversations')}, {_sig('w')}, {_sig('x')}"
EXT = f"WITH {_tok('y', 'conversations')}, cap AS (SELECT word, n FROM y UNION ALL SELECT upper(word[1]) || word[2:], n FROM y WHERE regexp_matches(word, '^[a-z]')), x AS (SELECT word, max(n)::BIGINT AS n FROM (SELECT word, n FROM cap UNION ALL SELECT word || m, n FROM cap, (VALUES ('.'), (','), (':'), (';'), ('!'), ('?')) v(m) WHERE NOT regexp_matches(word, '[.,:;!?]$')) GROUP BY 1)"
VOTE = """, lp AS (SELECT len, sig, i, c AS letter, sum(n) AS n FROM (SELECT p.len, p.sig, s.i, s.c, p.n FROM xp p JOIN xs s USING (word)) GROUP BY ALL),
  lw AS (SELECT len, sig, i, letter, n / sum(n) OVER (PARTITION BY len, sig, i) AS share FROM lp),
  vl AS (SELECT lang, word, n, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM ql),
  vf AS (SELECT lang, word, n, c, min(i) AS i FROM vl GROUP BY ALL), v AS (SELECT lang, vf.c, letter, round(sum(vf.n * share), 6) AS votes FROM vf JOIN wp USING (word) JOIN lw ON lw.len = wp.len AND lw.sig = wp.sig AND lw.i = vf.i GROUP BY ALL),
  k AS (SELECT *, (row_number() OVER (PARTITION BY lang, c ORDER BY votes DESC, letter))::INT AS rank FROM v)
  SELECT lang, c, rank, letter, votes, round(CASE WHEN votes > 0 THEN 1 / votes ELSE 1 / 2.220446049250313e-16 END, 9) AS dist FROM k WHERE rank <= 3"""

IMPLIED = """, a AS (SELECT len, sig, any_value(rs) AS rs, count(*)::BIGINT AS n_words FROM wp GROUP BY ALL), b AS (SELECT len, sig, any_value(rs) AS rs, count(*) AS m FROM xp GROUP BY ALL)
      SELECT a.len, a.sig, n_words, coalesce(sum(m) FILTER (WHERE len(list_filter(range(1, a.len + 1), lambda i: b.rs[i] <> b.rs[list_position(a.rs, a.rs[i])])) = 0), 0)::BIGINT AS n_matches
      FROM a LEFT JOIN b ON a.len = b.len GROUP BY ALL"""

QUERIES = {
    "isomorph_join": (lambda s, d: isomorphs(_word(s, d), _lex(s, d)), BASE + ", l AS (SELECT len, sig, count(*)::BIGINT AS n_matches, sum(n)::BIGINT AS n_tokens FROM xp GROUP BY ALL) SELECT word, len, sig, n_matches, n_tokens FROM wp JOIN l USING (len, sig)"),
    "implied_equality_join": (lambda s, d: implied(_word(s, d), _lex(s, d)), BASE + IMPLIED),
    "simul_step0": (lambda s, d: implied(_word(s, d), extended(_lex(s, d))), EXT + f", {_tok('w', 'documents')}, {_sig('w')}, {_sig('x')}" + IMPLIED),
    "lexicon_extended": (lambda s, d: extended(_lex(s, d)), EXT + " SELECT word, n FROM x"),
    "vote_scores": (lambda s, d: vote_ranking(votes(words_by(_docs(s, d), "lang"), _lex(s, d), "lang"), "lang"), f"WITH {_tok('ql', 'documents', 'lang, ')}, w AS (SELECT word, n FROM ql), {_tok('x', 'conversations')}, {_sig('w')}, {_sig('x')}" + VOTE),
    "vote_scores_ext": (lambda s, d: vote_ranking(votes(words_by(_docs(s, d), "lang"), extended(_lex(s, d)), "lang"), "lang"), EXT + f", {_tok('ql', 'documents', 'lang, ')}, w AS (SELECT word, n FROM ql), {_sig('w')}, {_sig('x')}" + VOTE),
    "vp_ratio": (lambda s, d: vp_ratio(vp_matches(words_by(_docs(s, d), "lang"), _lex(s, d), "lang"), "lang"), f"""WITH {_tok('wg', 'documents', 'lang, ')}, {_tok('x', 'conversations')},
      cs AS (SELECT lang, n, word, unnest(string_split(word, '')) AS c FROM wg), top AS (SELECT lang, c FROM (SELECT lang, c, sum(n) AS k FROM cs GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k DESC, c) <= 12),
      ky AS (SELECT lang, list(c) AS key FROM top GROUP BY 1), wm AS (SELECT lang, word, n, string_split(word, '') AS s, length(word) AS len, list_transform(string_split(word, ''), lambda c: CASE WHEN list_contains(key, c) THEN c END) AS mask FROM wg JOIN ky USING (lang)),
      fm AS (SELECT DISTINCT len, list_transform(range(1, len + 1), lambda i: coalesce(mask[i], '?' || list_position(s, s[i]))) AS form, mask, list_transform(s, lambda c: list_position(s, c)) AS f,
             coalesce(list_aggregate(list_filter(mask, lambda c: c IS NOT NULL), 'first'), '') AS l1 FROM wm),
      lx AS (SELECT DISTINCT string_split(word, '') AS t, length(word) AS len FROM x),
      ft AS (SELECT len, form, any_value(mask) AS mask, any_value(list_transform(form, lambda y: CASE WHEN y LIKE '?_%' THEN substr(y, 2)::INT ELSE 0 END)) AS f FROM fm GROUP BY ALL),
      hit AS (SELECT DISTINCT ft.form FROM ft JOIN lx ON ft.len = lx.len WHERE len(list_filter(range(1, ft.len + 1), lambda i: CASE WHEN mask[i] IS NOT NULL THEN lx.t[i] <> mask[i] ELSE lx.t[i] <> lx.t[f[i]] END)) = 0),
      r AS (SELECT lang, n, unnest(list_distinct(s)) AS c, hit.form IS NOT NULL AS m FROM wm LEFT JOIN hit ON hit.form = list_transform(range(1, len + 1), lambda i: coalesce(mask[i], '?' || list_position(s, s[i]))))
      SELECT lang, c, sum(n)::BIGINT AS n_words, coalesce(sum(n) FILTER (WHERE m), 0)::BIGINT AS n_matched, round(coalesce(sum(n) FILTER (WHERE m), 0) / sum(n), 9) AS ratio FROM r GROUP BY ALL"""),
}
