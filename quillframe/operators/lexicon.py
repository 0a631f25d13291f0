"""Words, symbols, positions, n-grams and patterns of a corpus.

Counts are taken of distinct words first and expanded afterwards, so what is exploded is the
vocabulary, not the corpus. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import TEXTS
from ..sources.tables import capped, markup_body, table

LONGEST = 15


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(T.tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_lengths(words: DataFrame) -> DataFrame:
    return words.groupBy(F.length("word").alias("len")).agg(F.count("*").alias("n_words"), F.sum("n").alias("n_tokens"))


def symbol_counts(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    c = docs.select(*by, F.explode(T.symbols(F.col(text))).alias("c"))
    return c.filter(T.printable(F.col("c"))).groupBy(*by, "c").agg(F.count("*").alias("n"))


def positions(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """c, len, pos, n: how often symbol c stands at pos in words of length len."""
    w = words.filter(F.length("word") <= longest).select(F.length("word").alias("len"), "n", F.posexplode(T.symbols(F.col("word"))).alias("pos", "c"))
    w = w.filter(T.printable(F.col("c")))
    return w.groupBy("c", "len", (F.col("pos") + 1).alias("pos")).agg(F.sum("n").alias("n"))


def position_share(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("c", "len", "pos", F.round(F.col("n") / F.col("total"), 12).alias("share"))


def position_norm(counts: DataFrame, *by: str) -> DataFrame:
    """p: the share of a symbol's count over the positions of its length; norm: that count."""
    total = counts.groupBy(*by, "c", "len").agg(F.sum("n").alias("norm"))
    return counts.join(total, [*by, "c", "len"]).select(*by, "c", "len", "pos", F.col("norm"), F.round(F.col("n") / F.col("norm"), 12).alias("p"))


def ngrams(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Counts of n (2 or 3) neighbouring symbols of the stream, line ends included, all of them printable. A task counts in one array of 95^n cells."""
    names = ["a", "b", "c"][:n]
    size = T.LAST - T.FIRST + 1

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size**n, np.int64)
        for b in it:
            for at in range(0, b.num_rows, TEXTS):
                # bytes of other symbols aren't printable, and a line end parts texts
                x = np.frombuffer("\n".join(t for t in b.column(0).slice(at, TEXTS).to_pylist() if t).encode(), np.uint8)
                seen, x = (x >= T.FIRST) & (x <= T.LAST), x.astype(np.int32) - T.FIRST
                m = max(len(x) - n + 1, 0)
                key, whole = np.zeros(m, np.int32), np.ones(m, bool)
                for j in range(n):
                    key = key * size + x[j : j + m]
                    whole &= seen[j : j + m]
                counts += np.bincount(key[whole], minlength=size**n)
        at = np.flatnonzero(counts)
        symbols = pa.array([chr(c) for c in range(T.FIRST, T.LAST + 1)])
        yield pa.RecordBatch.from_arrays([*(symbols.take(pa.array(at // size ** (n - j - 1) % size)) for j in range(n)), pa.array(counts[at])], names=[*names, "n"])

    g = docs.select(text).mapInArrow(over, ", ".join([*(f"{x} string" for x in names), "n long"]))
    return g.groupBy(*names).agg(F.sum("n").alias("n"))


def line_firsts(docs: DataFrame, n: int = 1, text: str = "text") -> DataFrame:
    """Counts of the first symbol, or first two, of each line that has them."""
    line = docs.select(F.explode(F.split(text, "\\n")).alias("l")).filter(F.length("l") >= n)
    names = ["a", "b"][:n]
    g = line.select(*[F.substring("l", k + 1, 1).alias(x) for k, x in enumerate(names)])
    for x in names:
        g = g.filter(T.printable(F.col(x)))
    return g.groupBy(*names).agg(F.count("*").alias("n"))


def patterns(words: DataFrame) -> DataFrame:
    return words.select("word", F.length("word").alias("len"), T.numerized(F.col("word")).alias("sig"), "n")


def symbol_stream(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Symbols with a blank behind each, spaces as underscores; line by line within a text."""
    return df.select(*keep, F.regexp_replace(F.translate(text, " ", "_"), "([^\\n])", "$1 ").alias("stream"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10, most: int = 95) -> DataFrame:
    """Sentences of least to most symbols: split behind .?! and before a capital, white space squeezed, other than printable symbols left out."""
    flat = F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " ")
    marked = F.regexp_replace(flat, "([.?!]) ([A-Z])", "$1\u0001$2")
    s = docs.select(key, F.posexplode(F.split(marked, "\u0001")).alias("at", "s"))
    s = s.withColumn("s", F.regexp_replace("s", "[^ -~]", ""))
    return s.filter(F.length("s").between(least, most)).select(key, "at", F.col("s").alias("sentence"))


def source_groups(docs: DataFrame, column: str = "source", pattern: str = "([A-Za-z]*)([0-9]*)", to: str = "$2") -> DataFrame:
    """The document group that a pattern makes of a name, with its documents."""
    return docs.groupBy(F.regexp_replace(column, pattern, to).alias("grp")).agg(F.count("*").alias("n"))


_docs = lambda spark, d: table(spark, d, "documents")
_words = lambda spark, d: word_counts(_docs(spark, d))

TOK = r"tok AS (SELECT unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS word FROM documents), words AS (SELECT word, count(*)::BIGINT AS n FROM tok WHERE word <> '' GROUP BY 1)"
CH = "ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> '')"
POS = TOK + ", wc AS (SELECT length(word) AS len, n, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS pos FROM words WHERE length(word) <= 15), pc AS (SELECT c, len::INT AS len, pos::INT AS pos, sum(n)::BIGINT AS n FROM wc WHERE ascii(c) BETWEEN 32 AND 126 GROUP BY ALL)"
LINES = r"ln AS (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)"
BI = CH + ", bi AS (SELECT c AS a, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM ch), bg AS (SELECT a, b, count(*)::BIGINT AS n FROM bi WHERE ascii(a) BETWEEN 32 AND 126 AND b IS NOT NULL AND ascii(b) BETWEEN 32 AND 126 GROUP BY ALL)"
SIG = """, ws AS (SELECT word, n, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM words),
  f AS (SELECT word, n, c, i, min(i) OVER (PARTITION BY word, c) AS f FROM ws),
  g AS (SELECT word, n, i, dense_rank() OVER (PARTITION BY word ORDER BY f) AS r FROM f),
  sig AS (SELECT word, n, length(word)::INT AS len, string_agg(r::VARCHAR, '.' ORDER BY i) AS sig FROM g GROUP BY word, n)"""

QUERIES = {
    "word_counts": (lambda s, d: _words(s, d), f"WITH {TOK} SELECT * FROM words"),
    "word_len_hist": (lambda s, d: word_lengths(_words(s, d)), f"WITH {TOK} SELECT length(word)::INT AS len, count(*)::BIGINT AS n_words, sum(n)::BIGINT AS n_tokens FROM words GROUP BY 1"),
    "char_counts": (lambda s, d: symbol_counts(_docs(s, d)), f"WITH {CH} SELECT c, count(*)::BIGINT AS n FROM ch WHERE ascii(c) BETWEEN 32 AND 126 GROUP BY 1"),
    "pos_count": (lambda s, d: positions(_words(s, d)), f"WITH {POS} SELECT * FROM pc"),
    "pos_count_share": (lambda s, d: position_share(positions(_words(s, d))), f"WITH {POS} SELECT c, len, pos, round(n / (SELECT sum(n) FROM pc), 12) AS share FROM pc"),
    "pos_count_norm": (lambda s, d: position_norm(positions(_words(s, d))), f"WITH {POS} SELECT c, len, pos, (sum(n) OVER (PARTITION BY c, len))::BIGINT AS norm, round(n / sum(n) OVER (PARTITION BY c, len), 12) AS p FROM pc"),
    "char_bigram": (lambda s, d: ngrams(_docs(s, d), 2), f"WITH {BI} SELECT * FROM bg"),
    "char_trigram": (lambda s, d: ngrams(_docs(s, d), 3), f"WITH {CH}, t AS (SELECT c AS a, lead(c) OVER w AS b, lead(c, 2) OVER w AS c FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT a, b, c, count(*)::BIGINT AS n FROM t WHERE c IS NOT NULL AND ascii(a) BETWEEN 32 AND 126 AND ascii(b) BETWEEN 32 AND 126 AND ascii(c) BETWEEN 32 AND 126 GROUP BY ALL"),
    "line_first_char": (lambda s, d: line_firsts(_docs(s, d), 1), f"WITH {LINES} SELECT l[1] AS a, count(*)::BIGINT AS n FROM ln WHERE l <> '' AND ascii(l[1]) BETWEEN 32 AND 126 GROUP BY 1"),
    "line_first_bigram": (lambda s, d: line_firsts(_docs(s, d), 2), f"WITH {LINES} SELECT l[1] AS a, l[2] AS b, count(*)::BIGINT AS n FROM ln WHERE length(l) >= 2 AND ascii(l[1]) BETWEEN 32 AND 126 AND ascii(l[2]) BETWEEN 32 AND 126 GROUP BY ALL"),
    "numerize_patterns": (lambda s, d: patterns(_words(s, d)), f"WITH {TOK}{SIG} SELECT word, len, sig, n FROM sig"),
    "pattern_groups": (lambda s, d: patterns(_words(s, d)).groupBy("len", "sig").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_tokens"), F.min("word").alias("first_word")), f"WITH {TOK}{SIG} SELECT len, sig, count(*)::BIGINT AS n_words, sum(n)::BIGINT AS n_tokens, min(word) AS first_word FROM sig GROUP BY ALL"),
    "srilm_stream": (lambda s, d: symbol_stream(table(s, d, "conversations"), "conv_id", "turn"), r"SELECT conv_id, turn, regexp_replace(replace(text, ' ', '_'), '([^\n])', '\1 ', 'g') AS stream FROM conversations"),
    "sgml_body": (lambda s, d: markup_body(table(s, d, "pages")), r"SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), '(?is)</body.*$', ''), chr(10)), lambda x: NOT regexp_matches(x, '(?i)^reuter')), chr(10)) AS body FROM pages"),
    "sentence_split": (lambda s, d: sentences(_docs(s, d)), r"""WITH x AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), '([.?!]) ([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents),
      y AS (SELECT doc_id, unnest(p) AS s, (generate_subscripts(p, 1) - 1)::INT AS "at" FROM x), z AS (SELECT doc_id, "at", regexp_replace(s, '[^ -~]', '', 'g') AS sentence FROM y)
      SELECT * FROM z WHERE length(sentence) BETWEEN 10 AND 95"""),
    "doc_groups": (lambda s, d: source_groups(_docs(s, d)), r"SELECT regexp_replace(source, '([A-Za-z]*)([0-9]*)', '\2') AS grp, count(*)::BIGINT AS n FROM documents GROUP BY 1"),
    "corpus_cap": (lambda s, d: capped(_docs(s, d), 1_000_000).select("doc_id", "kept"), "WITH x AS (SELECT doc_id, length(text)::BIGINT AS n, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS b FROM documents) SELECT doc_id, least(n, greatest(0, 1000000 - b))::BIGINT AS kept FROM x"),
}
