"""Reports and what is selected, merged, renumbered and reordered for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import accuracy_report, running_before, squeezed_lines, table, word_report
from .evaluate import ACC, KIND, MAP, WACC, accuracy, kind, rank_mapping, read_word_accuracy
from .lexicon import symbol_counts
from .matching import VOTE, _lex, _sig, _tok, vote_ranking, votes, words_by
from .models import CLASS
from .raster import WD, words

#: Fixed value: the symbol of what a report leaves out.
DELETED = "~"


def included(mapping: DataFrame, threshold: float, key: str = "doc_id") -> DataFrame:
    """The mapping with DELETED for clusters under the threshold: 0 keeps all, from 1 on it counts members, between it is a share of the text's symbols."""
    if not threshold:
        return mapping
    least = F.lit(float(threshold)) * F.sum("n").over(Window.partitionBy(key)) if threshold < 1 else F.lit(float(threshold))
    return mapping.withColumn("sym", F.when(F.col("n") >= least, F.col("sym")).otherwise(DELETED))


def best_fraction(reports: DataFrame, by: str, score: str, fraction: float, key: str = "doc_id") -> DataFrame:
    """The best reports of each group: floor(fraction * their number), ties by key."""
    w = Window.partitionBy(by)
    x = reports.withColumn("place", F.row_number().over(w.orderBy(F.desc(score), key))).withColumn("of", F.count("*").over(w))
    return x.filter(F.col("place") <= F.floor(F.lit(float(fraction)) * F.col("of"))).drop("of")


def with_ids(counts: DataFrame, alphabet: DataFrame, c: str = "c") -> DataFrame:
    """counts with sym_id from an alphabet (sym_id, val): of several ids the first wins; a symbol without one raises an error."""
    ids = alphabet.groupBy(F.col("val").alias(c)).agg(F.min("sym_id").alias("sym_id"))
    lost = F.raise_error(F.concat(F.lit("no id of symbol "), F.col(c)))
    return counts.join(ids, c, "left").withColumn("sym_id", F.coalesce("sym_id", lost.cast("int")))


def unknown_symbols(counts: DataFrame, alphabet: DataFrame, c: str = "c") -> DataFrame:
    return counts.join(alphabet.select(F.col("val").alias(c)), c, "left_anti")


def same_class(candidates: DataFrame, c: str = "c", letter: str = "letter") -> DataFrame:
    """Candidates whose symbol is of the cluster's class."""
    return candidates.filter(T.symbol_class(F.col(c)) == T.symbol_class(F.col(letter)))


def merged(reports: DataFrame, *by: str) -> DataFrame:
    """Reports of regions as one for each group: totals add up."""
    g = reports.groupBy(*by).agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    return g.select(*by, "total", "correct", F.round(F.col("correct") / F.col("total"), 9).alias("acc"))


def report_text(reports: DataFrame, by: str, name: str = "kind") -> DataFrame:
    """by and text: a report of a line for each class, in order of names."""
    pct = 100.0 * F.col("correct") / F.col("total")
    line = F.format_string("%d %d %.2f%% ASCII %s", F.col("total"), F.col("total") - F.col("correct"), pct, F.col(name))
    rows = F.array_sort(F.collect_list(F.struct(F.col(name), line.alias("line"))))  # a line a class
    return reports.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def pair_report(pairs: DataFrame, by: str, truth: str = "c", read: str = "sym", fold: bool = False) -> DataFrame:
    """by and text: a report of the symbols of n occurrences each, read as another: totals, errors and their share, then a line for each confusion (most errors first, then by symbol). fold: case is ignored."""
    t, r = (F.lower(c) if fold else F.col(c) for c in (truth, read))
    x = pairs.select(by, t.alias("t"), r.alias("r"), "n").groupBy(by, "t", "r").agg(F.sum("n").alias("n"))
    wrong = F.when(F.col("t") != F.col("r"), F.col("n"))
    line = F.when(F.col("t") != F.col("r"), F.struct((-F.col("n")).alias("n"), F.col("t"), F.col("r")))
    g = x.groupBy(by).agg(F.sum("n").alias("total"), F.coalesce(F.sum(wrong), F.lit(0)).alias("errors"), F.array_sort(F.collect_list(line)).alias("lines"))  # pairs of symbols
    head = F.format_string("%d characters\n%d errors\n%.2f%% accuracy", F.col("total"), F.col("errors"), 100.0 * (F.col("total") - F.col("errors")) / F.col("total"))
    rows = F.transform("lines", lambda v: F.concat((-v["n"]).cast("string"), F.lit(" {"), v["t"], F.lit("}-{"), v["r"], F.lit("}")))
    return g.select(by, F.array_join(F.concat(F.array(head), rows), "\n").alias("text"))


def cluster_report(mapping: DataFrame, by: str = "doc_id") -> DataFrame:
    """by and text: a line for each cluster in order: its number, members, truth, reading and whether they agree."""
    line = F.concat_ws(" ", F.col("clust").cast("string"), F.col("n").cast("string"), "c", "sym", F.when(F.col("c") == F.col("sym"), "right").otherwise("wrong"))
    return mapping.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clust", line.alias("line")))), lambda v: v["line"]), "\n").alias("text"))  # an alphabet a text


def word_report_text(words: DataFrame, by: str = "doc_id") -> DataFrame:
    """by and text of word accuracies (total, correct): two heading lines, then words and misrecognized words, which the word report scan reads."""
    return words.select(by, F.format_string("Word Accuracy Report\n--------------------\n%8d   Words\n%8d   Misrecognized", F.col("total"), F.col("total") - F.col("correct")).alias("text"))


def reading_order(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """boxes with seq: from 1 along each text's lines, left to right."""
    return boxes.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("line", "l", "word")))


def inside(boxes: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Boxes of the lines and columns of a region; a side of 0 is open."""
    out = boxes
    for side, fits in ((left, F.col("l") >= left), (top, F.col("line") >= top), (right, F.col("r") <= right), (bottom, F.col("line") <= bottom)):
        out = out.filter(fits) if side else out
    return out


def modal_scale(boxes: DataFrame, size: Column, key: str = "doc_id") -> DataFrame:
    """boxes with size, the text's most frequent one (equal counts: the smallest) and the factor that brings a box to it."""
    x = boxes.withColumn("size", size)
    mode = x.groupBy(key, "size").agg(F.count("*").alias("n")).groupBy(key).agg(F.min_by("size", F.struct(-F.col("n"), "size")).alias("modal"))
    return x.join(mode, key).withColumn("scale", F.round(F.col("modal") / F.col("size"), 9))


def overlap(left: Column, right: Column) -> Column:
    """Both strings in one, without left's last symbol where right begins with it."""
    meet = (F.length(left) > 0) & (F.substring(left, -1, 1) == F.substring(right, 1, 1))
    return F.when(meet, F.concat(F.expr("''"), F.substring(left, F.lit(1), F.length(left) - 1), right)).otherwise(F.concat(left, right))


def renumbered(df: DataFrame, key: str, to: str = "new_id") -> DataFrame:
    """df with dense ids from 1 in order of key, by running counts over ranges of keys; foreign keys follow by a join on key."""
    return running_before(df.withColumn("_one", F.lit(1).cast("long")), key, "_one", to).withColumn(to, F.col(to) + 1).drop("_one")


def reference_symbols(docs: DataFrame, share: float = 0.33, key: str = "doc_id", text: str = "text") -> DataFrame:
    """c and n over the first texts: floor(share * their number), in order of key."""
    n = docs.agg(F.count("*").alias("_n"))  # one row
    first = renumbered(docs.select(key, text), key, "_at").crossJoin(F.broadcast(n)).filter(F.col("_at") <= F.floor(F.lit(float(share)) * F.col("_n")))
    return symbol_counts(first.select(key, text), text=text)


def side_by_side(images: DataFrame, by: Column, key: str, vector: str, width: int, height: int) -> DataFrame:
    """grp, width, height and image (row by row): each group's images of one size in a row, in order of key. Groups are some images."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(vector).alias("v")))), lambda x: x["v"])
    g = images.groupBy(by.alias("grp")).agg(cells.alias("cells"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.flatten(F.transform("cells", lambda v: F.slice(v, r * width + 1, width))))
    return g.select("grp", (F.size("cells") * width).alias("width"), F.lit(height).alias("height"), F.flatten(rows).alias("image"))


def running_means(images: DataFrame, by: str, key: str, vector: str) -> DataFrame:
    """by, key, at and mean: each pixel's mean over the group's members up to this one, in order of key."""
    x = images.select(by, key, F.posexplode(vector).alias("at", "x"))
    w = Window.partitionBy(by, "at").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return x.select(by, key, "at", F.round(F.avg(F.col("x").cast("double")).over(w), 9).alias("mean"))


_docs = lambda s, d: table(s, d, "documents")
_map = lambda s, d: rank_mapping(_docs(s, d))
_emb = lambda s, d: table(s, d, "embeddings")
_alphabet = lambda s: s.range(T.FIRST, T.LAST + 1).select((F.col("id") - T.FIRST + 1).cast("int").alias("sym_id"), F.chr("id").alias("val"))
_kinds = lambda s, d, *by: accuracy(_map(s, d).withColumn("kind", kind(F.col("c"))), *by, "kind")


def _read_back(s, d):
    x = accuracy_report(report_text(_kinds(s, d, "lang"), "lang"), "lang")
    return x.select("lang", "class", "total", "wrong")


def _kept_labels(s, d):
    kept = renumbered(_docs(s, d).filter("text <> ''").select("doc_id"), "doc_id")
    return table(s, d, "labels").select("doc_id", "toxic").join(kept, "doc_id").select("new_id", "doc_id", "toxic")


def _acc(sym: str) -> str:
    return ACC.replace("c = sym", f"c = {sym}")


CLASSED = VOTE.replace("v AS (SELECT lang, vf.c", "v0 AS (SELECT lang, vf.c").replace(", k AS", "").replace("k AS (SELECT *,", f"v AS (SELECT * FROM v0 WHERE {CLASS} = {CLASS.replace(', c)', ', letter)')}), k AS (SELECT *,")

QUERIES = {
    "confusion_report": (
        lambda s, d: pair_report(_map(s, d), "lang", fold=True),
        f"""{MAP}, x AS (SELECT lang, lower(c) AS t, lower(sym) AS r, sum(n) AS n FROM mp GROUP BY ALL),
      g AS (SELECT lang, sum(n) AS total, coalesce(sum(n) FILTER (WHERE t <> r), 0) AS errors, string_agg(n || ' {{' || t || '}}-{{' || r || '}}', chr(10) ORDER BY n DESC, t, r) FILTER (WHERE t <> r) AS rows FROM x GROUP BY 1)
      SELECT lang, concat_ws(chr(10), total || ' characters', errors || ' errors', printf('%.2f', (100.0 * (total - errors) / total)::DOUBLE) || '% accuracy', rows) AS text FROM g""",
    ),
    "cluster_report": (
        lambda s, d: cluster_report(_map(s, d)),
        f"{MAP} SELECT doc_id, string_agg(clust || ' ' || n || ' ' || c || ' ' || sym || ' ' || CASE WHEN c = sym THEN 'right' ELSE 'wrong' END, chr(10) ORDER BY clust) AS text FROM mp GROUP BY 1",
    ),
    "word_report_round_trip": (
        lambda s, d: word_report(word_report_text(read_word_accuracy(_docs(s, d)))),
        f"{WACC} SELECT doc_id, count(*)::BIGINT AS total, (count(*) FILTER (WHERE NOT ok))::BIGINT AS wrong FROM wa GROUP BY 1",
    ),
    "included_accuracy": (lambda s, d: accuracy(included(_map(s, d), 0.01), "doc_id"), f"{MAP}, i AS (SELECT doc_id, c, n, CASE WHEN n >= 0.01::DOUBLE * sum(n) OVER (PARTITION BY doc_id) THEN sym ELSE '~' END AS sym FROM mp) SELECT doc_id, {ACC} FROM i GROUP BY 1"),
    "included_count_accuracy": (lambda s, d: accuracy(included(_map(s, d), 5), "lang"), f"{MAP} SELECT lang, {_acc('CASE WHEN n >= 5 THEN sym ELSE chr(126) END')} FROM mp GROUP BY 1"),
    "best_fraction": (lambda s, d: best_fraction(accuracy(_map(s, d), "lang", "doc_id"), "lang", "acc", 0.3), f"{MAP}, a AS (SELECT lang, doc_id, {ACC} FROM mp GROUP BY ALL), b AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY acc DESC, doc_id))::INT AS place, count(*) OVER (PARTITION BY lang) AS k FROM a) SELECT lang, doc_id, total, correct, acc, place FROM b WHERE place <= floor(0.3::DOUBLE * k)"),
    "alphabet_ids": (lambda s, d: with_ids(symbol_counts(_docs(s, d)), _alphabet(s)), "WITH x AS (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') SELECT c, count(*)::BIGINT AS n, (ascii(c) - 31)::INT AS sym_id FROM x WHERE ascii(c) BETWEEN 32 AND 126 GROUP BY c"),
    "unknown_symbols": (lambda s, d: unknown_symbols(_docs(s, d).select(F.explode(T.symbols(F.col("text"))).alias("c")).groupBy("c").agg(F.count("*").alias("n")), _alphabet(s)), "WITH x AS (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') SELECT c, count(*)::BIGINT AS n FROM x WHERE NOT ascii(c) BETWEEN 32 AND 126 GROUP BY c"),
    "vote_scores_class": (lambda s, d: vote_ranking(same_class(votes(words_by(_docs(s, d), "lang"), _lex(s, d), "lang")), "lang"), f"WITH {_tok('ql', 'documents', 'lang, ')}, w AS (SELECT word, n FROM ql), {_tok('x', 'conversations')}, {_sig('w')}, {_sig('x')}" + CLASSED),
    "merged_reports": (lambda s, d: merged(_kinds(s, d, "doc_id"), "kind"), f"{MAP} SELECT {KIND} AS kind, {ACC} FROM mp GROUP BY 1"),
    "report_round_trip": (_read_back, f"{MAP} SELECT lang, {KIND} AS class, sum(n)::BIGINT AS total, (sum(n) - coalesce(sum(n) FILTER (WHERE c = sym), 0))::BIGINT AS wrong FROM mp WHERE lang IS NOT NULL GROUP BY ALL"),
    "listing_lines": (lambda s, d: squeezed_lines(_docs(s, d)).groupBy("line").agg(F.count("*").alias("n")), "WITH x AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(*)::BIGINT AS n FROM x WHERE line <> '' GROUP BY 1"),
    "reading_order": (lambda s, d: reading_order(words(_docs(s, d))).select("doc_id", "line", "word", "seq"), f"WITH {WD} SELECT doc_id, line, word, (row_number() OVER (PARTITION BY doc_id ORDER BY line, l))::INT AS seq FROM wd"),
    "line_roi": (lambda s, d: inside(words(_docs(s, d)), 5, 0, 60, 6), f"WITH {WD} SELECT doc_id, line, word, l, r FROM wd WHERE l >= 5 AND r <= 60 AND line <= 6"),
    "modal_scale": (lambda s, d: modal_scale(words(_docs(s, d)), F.col("r") - F.col("l") + 1).select("doc_id", "line", "word", "size", "modal", "scale"), f"WITH {WD}, z AS (SELECT *, (r - l + 1)::INT AS size FROM wd), m AS (SELECT doc_id, size AS modal FROM (SELECT doc_id, size, count(*) AS n FROM z GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) = 1) SELECT doc_id, line, word, size, modal, round(modal / size, 9) AS scale FROM z JOIN m USING (doc_id)"),
    "name_overlap": (lambda s, d: table(s, d, "region").join(table(s, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", overlap(F.col("r_name"), F.col("n_name")).alias("name")), "SELECT n_nationkey, CASE WHEN right(r_name, 1) = left(n_name, 1) THEN left(r_name, length(r_name) - 1) ELSE r_name END || n_name AS name FROM region JOIN nation ON r_regionkey = n_regionkey"),
    "renumbered_labels": (_kept_labels, "WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS new_id FROM documents WHERE text <> '') SELECT new_id, doc_id, toxic FROM labels JOIN k USING (doc_id)"),
    "reference_symbols": (lambda s, d: reference_symbols(_docs(s, d)), "WITH k AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS m FROM documents), x AS (SELECT unnest(string_split(text, '')) AS c FROM k WHERE i <= floor(0.33::DOUBLE * m) AND text <> '') SELECT c, count(*)::BIGINT AS n FROM x WHERE ascii(c) BETWEEN 32 AND 126 GROUP BY c"),
    "image_rows": (lambda s, d: side_by_side(_emb(s, d).filter("size(embedding) = 64"), F.floor(F.col("vec_id") / 4), "vec_id", "embedding", 8, 8).select("grp", "width", "height", F.posexplode("image").alias("at", "x")).select("grp", "width", "height", "at", F.col("x").cast("double").alias("x")), """WITH m AS (SELECT vec_id // 4 AS grp, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY vec_id // 4) AS w, embedding FROM embeddings WHERE len(embedding) = 64)
      SELECT grp::BIGINT AS grp, (8 * w)::INT AS width, 8 AS height, ((i - 1) // 8 * 8 * w + k * 8 + (i - 1) % 8)::INT AS "at", embedding[i]::DOUBLE AS x FROM m, range(1, 65) t(i)"""),
    "vec_running_mean": (lambda s, d: running_means(_emb(s, d), "label", "vec_id", "embedding"), "WITH x AS (SELECT label, vec_id, (i - 1)::INT AS \"at\", embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)) SELECT label, vec_id, \"at\", round(avg(x) OVER (PARTITION BY label, \"at\" ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 9) AS mean FROM x"),
}
