"""Splitting of touching shapes into known ones: a shape that isn't known itself is cut into up to `splits` + 1 known parts.

A shape is the string of its columns. The whole shape is tried first; else the leftmost cut, from `least` columns on,
whose left part is known and whose rest splits by the same rule with one cut less. That is the least of
all its splits when each is written as the list of its cuts with 0 behind the last. So splits are searched breadth first,
a round a part: open rests are joined with the known shapes that begin them (a shape's beginnings are looked up by
equality, of the lengths that known shapes have), and the least list wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored
from ..sources.tables import table
from .lexicon import word_counts


def split_shapes(shapes: DataFrame, known: DataFrame, least: int = 2, splits: int = 2) -> DataFrame:
    """shape, n and pieces (known shapes from left to right; null where there is no split) of distinct shapes (shape, n).

    known: shape, distinct. A shape that is known is its own only piece. Only shapes of 2 x least columns or more are cut,
    and both parts keep `least` columns.
    """
    lengths = known.select(F.length("shape").alias("w")).distinct().agg(F.array_sort(F.collect_list("w")).alias("lengths"))  # one row: the lengths that known shapes have
    # a path: the rest that is still open, the cuts so far, their pieces
    opened = shapes.select("shape", F.col("shape").alias("rest"), F.expr("cast(array() as array<int>)").alias("cuts"), F.expr("cast(array() as array<string>)").alias("pieces"))
    have = known.select(F.col("shape").alias("part"))
    ends = []
    for k in range(splits + 1):
        whole = opened.join(have, F.col("rest") == F.col("part")).select("shape", F.expr("concat(cuts, array(0))").alias("cuts"), F.expr("concat(pieces, array(rest))").alias("pieces"))
        ends.append(whole)
        if k == splits:
            break
        cut = opened.filter(F.length("rest") >= 2 * least).crossJoin(F.broadcast(lengths))
        cut = cut.withColumn("w", F.explode(F.expr(f"filter(lengths, w -> w >= {int(least)} and w <= length(rest) - {int(least)})"))).withColumn("part", F.expr("substring(rest, 1, w)"))
        cut = cut.join(have, "part")
        opened = stored(cut.select("shape", F.expr("substring(rest, w + 1)").alias("rest"), F.expr("concat(cuts, array(w))").alias("cuts"), F.expr("concat(pieces, array(part))").alias("pieces")), "rests")
    found = ends[0]
    for e in ends[1:]:
        found = found.union(e)
    found = found.groupBy("shape").agg(F.min(F.struct("cuts", "pieces")).alias("best"))
    return shapes.join(found, "shape", "left").select("shape", "n", F.col("best.pieces").alias("pieces"))


def grown(split: DataFrame, known: DataFrame) -> DataFrame:
    """shape, own and taken: known shapes (shape, n) with the occurrences that split shapes add to them, for those that gain some."""
    parts = split.filter("size(pieces) > 1").select(F.explode("pieces").alias("shape"), "n").groupBy("shape").agg(F.sum("n").alias("taken"))
    return known.join(parts, "shape").select("shape", F.col("n").alias("own"), "taken")


def inner_shapes(shapes: DataFrame, least: int) -> DataFrame:
    """shape, part and at (from 1) for shapes that hold another one of `least` columns or more: the one with the most occurrences (equal ones: the least), at its first place.

    A shape's windows, of the lengths that shapes have, meet the shapes by a hash and are compared then, so a window's row holds its shape and place, not its own symbols.
    """
    lengths = shapes.select(F.length("shape").alias("w")).filter(F.col("w") >= least).distinct().agg(F.array_sort(F.collect_list("w")).alias("lengths"))  # one row
    x = shapes.filter(F.length("shape") > least).select("shape").crossJoin(F.broadcast(lengths))
    x = x.select("shape", F.explode(F.expr("filter(lengths, w -> w < length(shape))")).alias("w"))
    x = x.select("shape", "w", F.explode(F.expr("sequence(1, length(shape) - w + 1)")).alias("at"))
    x = x.select("shape", "at", F.expr("xxhash64(substring(shape, at, w))").alias("h"))
    found = x.join(shapes.filter(F.length("shape") >= least).select(F.xxhash64("shape").alias("h"), F.col("shape").alias("part"), F.col("n").alias("often")), "h")
    found = found.filter("part = substring(shape, at, length(part)) and length(part) < length(shape)")
    best = found.groupBy("shape").agg(F.min(F.struct(-F.col("often"), F.col("part"), F.col("at"))).alias("b"))
    return best.select("shape", "b.part", "b.at")


def refine_inner(shapes: DataFrame, least: int = 4, edge: int = 1) -> DataFrame:
    """shape and n once no shape holds another: in each round every shape that holds one (see inner_shapes) becomes that one and what is left and right of it, with its occurrences.

    What is left over of `edge` columns or fewer counts as covered by the match. All shapes of a round are judged
    by the same table; rounds are written tables, and shapes only get shorter, so rounds end.
    """
    now = stored(shapes.select("shape", "n"), "shapes")
    while True:
        hit = stored(inner_shapes(now, least), "inner")
        if hit.isEmpty():
            return now
        x = now.join(hit, "shape", "left")
        parts = F.when(F.col("part").isNull(), F.array("shape")).otherwise(F.filter(F.array("part", F.expr("substring(shape, 1, at - 1)"), F.expr("substring(shape, at + length(part))")), lambda p: (p == F.col("part")) | (F.length(p) > edge)))
        now = stored(x.select("n", F.explode(parts).alias("shape")).groupBy("shape").agg(F.sum("n").alias("n")), "shapes")


# -- queries -----------------------------------------------------------------------------


def _tables(s, d) -> tuple[DataFrame, DataFrame]:
    """The words of documents as shapes; those of three columns or more that occur five times or more are known."""
    words = stored(word_counts(table(s, d, "documents")).select(F.col("word").alias("shape"), "n"), "shapes")
    return words, words.filter("n >= 5 and length(shape) >= 3")


def _split(s, d) -> DataFrame:
    words, known = _tables(s, d)
    rare = words.join(known.select("shape"), "shape", "left_anti")
    return split_shapes(rare, known, 3).filter("pieces is not null").select("shape", "n", F.array_join("pieces", "+").alias("pieces"))


def _grown(s, d) -> DataFrame:
    words, known = _tables(s, d)
    return grown(split_shapes(words.join(known.select("shape"), "shape", "left_anti"), known, 3), known)


_SQL = r"""WITH RECURSIVE x AS (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS shape FROM documents), q AS (SELECT shape, count(*) AS n FROM x WHERE shape <> '' GROUP BY 1),
      k AS (SELECT shape, n FROM q WHERE n >= 5 AND length(shape) >= 3), lens AS (SELECT DISTINCT length(shape) AS w FROM k),
      o(shape, rest, cuts, pieces) AS (SELECT shape, shape, []::INT[], []::VARCHAR[] FROM q WHERE shape NOT IN (SELECT shape FROM k)
        UNION ALL SELECT o.shape, substr(o.rest, lens.w::INT + 1), list_append(o.cuts, lens.w::INT), list_append(o.pieces, substr(o.rest, 1, lens.w::INT))
        FROM o JOIN lens ON lens.w BETWEEN 3 AND length(o.rest) - 3 JOIN k ON k.shape = substr(o.rest, 1, lens.w::INT) WHERE len(o.cuts) < 2),
      e AS (SELECT o.shape, min({'cuts': list_append(cuts, 0), 'pieces': list_append(pieces, rest)}) AS best FROM o JOIN k ON k.shape = o.rest GROUP BY o.shape)"""

QUERIES = {
    "subimage_refine": (lambda s, d: refine_inner(word_counts(table(s, d, "documents")).select(F.col("word").alias("shape"), "n")), None),
    "split_refine": (_split, f"{_SQL} SELECT e.shape, q.n, array_to_string(best.pieces, '+') AS pieces FROM e JOIN q USING (shape)"),
    "split_counts": (_grown, f"{_SQL}, p AS (SELECT unnest(best.pieces) AS shape, q.n FROM e JOIN q USING (shape)) SELECT p.shape, k.n AS own, sum(p.n)::BIGINT AS taken FROM p JOIN k ON k.shape = p.shape GROUP BY ALL"),
}
