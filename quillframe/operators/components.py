"""Texts as component tables: one row per symbol occurrence, clusters of equal symbols, words of clusters."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import per_text
from ..sources.tables import table
from .lexicon import LONGEST


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, pos, c, left and right: neighbours on the line, null at its ends."""
    line = docs.select(key, F.posexplode(F.split(text, "\\n")).alias("line", "l")).withColumn("s", T.symbols(F.col("l")))
    n = F.size("s")
    left = F.concat(F.array(F.lit(None).cast("string")), F.slice("s", 1, n - 1))
    right = F.concat(F.slice("s", 2, n - 1), F.array(F.lit(None).cast("string")))
    x = line.filter(n > 0).select(key, "line", F.posexplode(F.arrays_zip(F.col("s").alias("c"), left.alias("left"), right.alias("right"))).alias("pos", "x"))
    return x.select(key, "line", "pos", "x.c", "x.left", "x.right")


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, clust (1 the largest; equal sizes by first place), c, n and class: each text's distinct symbols, line ends left out."""
    fields = [("clust", "int", pa.int32()), ("c", "string", pa.string()), ("n", "long", pa.int64())]
    return per_text(docs, key, text, fields, _ranked).select("*", T.symbol_class(F.col("c")).alias("class"))


def _ranked(text: str) -> tuple[list, ...]:
    n = Counter(text)  # in order of first places, which the sort keeps
    n.pop("\n", None)
    c = sorted(n, key=n.__getitem__, reverse=True)
    return list(range(1, len(c) + 1)), c, [n[x] for x in c]


def cluster_bigrams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a, b, n, p over seen neighbours on a line: one is added to each of the text's cells, rows sum to 1."""
    pair = components(docs, key, text).filter("right is not null").groupBy(key, F.col("c").alias("a"), F.col("right").alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    size = clusters(docs, key, text).groupBy(key).agg(F.count("*").alias("k"))
    p = (F.col("n") + 1) / (F.sum("n").over(w.partitionBy(key, "a")) + F.col("k"))
    return pair.join(size, key).select(key, "a", "b", "n", F.round(p, 12).alias("p"))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word and n: words of clusters between spaces and line ends, repeated delimiters ignored."""
    w = docs.select(key, F.explode(F.split(text, "[ \\n]+")).alias("word")).filter("word <> ''")
    return w.groupBy(key, "word").agg(F.count("*").alias("n"))


def word_sequence(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word_id (from 1, in reading order), len and the word as cluster numbers."""
    ids = clusters(docs, key, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("c", "clust"))).alias("m"))  # an alphabet per text
    w = docs.select(key, F.posexplode(F.filter(F.split(text, "[ \\n]+"), lambda x: x != "")).alias("at", "word"))
    return w.join(ids, key).select(key, (F.col("at") + 1).alias("word_id"), F.length("word").alias("len"), F.array_join(F.transform(F.split("word", ""), lambda c: F.element_at("m", c).cast("string")), " ").alias("w"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, c, n_words: words that hold the cluster, each occurrence of a word once. They are counted inside the text's row; what is shuffled is a row a cluster."""
    x = per_text(docs, key, text, [("c", "string", pa.string()), ("n", "long", pa.int64())], _held)
    return x.groupBy(key, "c").agg(F.sum("n").alias("n_words"))


def _held(text: str) -> tuple[np.ndarray, ...]:
    """A text's symbols and how many of its words hold each."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = (x == 32) | (x == 10)
    word = np.cumsum(gap)[~gap]  # a word's number is that of the gaps before it
    c, code = np.unique(x[~gap], return_inverse=True)
    key = np.sort(code * (len(x) + 1) + word)
    n = np.bincount(key[np.diff(key, prepend=-1) > 0] // (len(x) + 1), minlength=len(c))
    return c, n


def positions(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """key, c, len, pos, n, norm, p: positional counts of clusters, as shares of their symbol and length."""
    fields = [("c", "string", pa.string()), ("len", "int", pa.int32()), ("pos", "int", pa.int32()), ("n", "long", pa.int64()), ("norm", "long", pa.int64())]
    x = per_text(docs, key, text, fields, lambda t: _placed(t, longest))
    return x.select("*", F.round(F.col("n") / F.col("norm"), 12).alias("p"))


def _placed(text: str, longest: int) -> tuple[np.ndarray, ...]:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    gaps = np.flatnonzero(np.concatenate([[True], (x == 32) | (x == 10), [True]]))
    size = np.diff(gaps) - 1
    kept = (size > 0) & (size <= longest)
    begin, size = gaps[:-1][kept], size[kept]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    key, n = np.unique(x[np.repeat(begin, size) + at] << 32 | np.repeat(size, size) << 16 | at + 1, return_counts=True)
    group = key >> 16
    first = np.flatnonzero(np.diff(group, prepend=-1))
    norm = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(key)))) if len(key) else n
    return key >> 32, group & 0xFFFF, key & 0xFFFF, n, norm


def merge_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, share: float = 0.85) -> DataFrame:
    """Cluster pairs to merge: a's most frequent left neighbour m, met at least `least` times and in `share` of both clusters."""
    size = clusters(docs, key, text).select(key, "c", F.col("n").alias("size"))
    pair = components(docs, key, text).filter("left is not null").groupBy(key, "c", "left").agg(F.count("*").alias("f"))
    best = pair.withColumn("k", F.row_number().over(Window.partitionBy(key, "c").orderBy(F.desc("f"), "left"))).filter("k = 1 and left <> c")
    best = best.filter(F.col("f") >= least).join(size, [key, "c"]).join(size.select(key, F.col("c").alias("left"), F.col("size").alias("left_size")), [key, "left"])
    return best.filter((F.col("size") >= least) & (F.col("f") >= share * F.col("size")) & (F.col("f") >= share * F.col("left_size"))).select(key, "c", "left", "f", "size", "left_size")


_docs = lambda s, d: table(s, d, "documents")
CL = "c0 AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''), c1 AS (SELECT doc_id, c, count(*)::BIGINT AS n, min(i) AS f FROM c0 WHERE c <> chr(10) GROUP BY ALL), cl AS (SELECT doc_id, c, n, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f))::INT AS clust FROM c1)"
CP = "lp AS (SELECT doc_id, c, lag(c) OVER w AS l, lead(c) OVER w AS r FROM c0 WINDOW w AS (PARTITION BY doc_id ORDER BY i))"
W = r"w0 AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS p FROM documents), w1 AS (SELECT doc_id, unnest(p) AS word, generate_subscripts(p, 1)::INT AS word_id FROM w0)"

from .models import CLASS  # noqa: E402

QUERIES = {
    "text_clusters": (lambda s, d: clusters(_docs(s, d)), f"WITH {CL} SELECT doc_id, clust, c, n, ({CLASS})::INT AS class FROM cl"),
    "cluster_bigram": (lambda s, d: cluster_bigrams(_docs(s, d)), f"WITH {CL}, {CP}, q AS (SELECT doc_id, c AS a, r AS b, count(*)::BIGINT AS n FROM lp WHERE c <> chr(10) AND r <> chr(10) GROUP BY ALL), k AS (SELECT doc_id, count(*) AS k FROM cl GROUP BY 1) SELECT doc_id, a, b, n, round((n + 1) / (sum(n) OVER (PARTITION BY doc_id, a) + k), 12) AS p FROM q JOIN k USING (doc_id)"),
    "cluster_words": (lambda s, d: word_sequence(_docs(s, d)), f"WITH {CL}, {W}, x AS (SELECT doc_id, word_id, length(word)::INT AS len, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM w1) SELECT doc_id, word_id, len, string_agg(clust::VARCHAR, ' ' ORDER BY i) AS w FROM x JOIN cl USING (doc_id, c) GROUP BY ALL"),
    "cluster_postings": (lambda s, d: postings(_docs(s, d)), f"WITH {W}, x AS (SELECT doc_id, word_id, unnest(list_distinct(string_split(word, ''))) AS c FROM w1) SELECT doc_id, c, count(*)::BIGINT AS n_words FROM x GROUP BY ALL"),
    "cluster_pos_norm": (lambda s, d: positions(_docs(s, d)), f"WITH {W}, x AS (SELECT doc_id, length(word)::INT AS len, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1)::INT AS pos FROM w1 WHERE length(word) <= 15), q AS (SELECT doc_id, c, len, pos, count(*)::BIGINT AS n FROM x GROUP BY ALL) SELECT *, (sum(n) OVER w)::BIGINT AS norm, round(n / sum(n) OVER w, 12) AS p FROM q WINDOW w AS (PARTITION BY doc_id, c, len)"),
    "neighbour_merge_candidates": (lambda s, d: merge_candidates(_docs(s, d)), f"WITH {CL}, {CP}, q AS (SELECT doc_id, c, l AS \"left\", count(*)::BIGINT AS f FROM lp WHERE c <> chr(10) AND l <> chr(10) GROUP BY ALL), b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY doc_id, c ORDER BY f DESC, \"left\") = 1) SELECT b.doc_id, b.c, b.\"left\", b.f, x.n AS size, y.n AS left_size FROM b JOIN cl x ON x.doc_id = b.doc_id AND x.c = b.c JOIN cl y ON y.doc_id = b.doc_id AND y.c = b.\"left\" WHERE b.c <> b.\"left\" AND f >= 3 AND x.n >= 3 AND f >= 0.85 * x.n AND f >= 0.85 * y.n"),
    "cluster_sizes": (lambda s, d: clusters(_docs(s, d)).groupBy("clust").agg(F.count("*").alias("docs"), F.sum("n").alias("n")), f"WITH {CL} SELECT clust, count(*)::BIGINT AS docs, sum(n)::BIGINT AS n FROM cl GROUP BY 1"),
}
