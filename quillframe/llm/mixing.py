"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all document rates r in [0, cap] that meet
the targets, entropy balancing takes those nearest to 1 in relative entropy. Its convex dual
has one multiplier per source, and its solution tilts rates exponentially in a document's
share of words::

    r = min(cap, exp(lambda[source] * size / mean size of the source))

The multipliers come from distributed Newton iterations: each round aggregates the words that
the rates take, and their slope, per source; steps are kept inside a bracket that shrinks
round by round. Documents of one source and size have one rate, so rounds run over counts by
(source, size), which no hot source can swell. Multipliers are rounded to 9 digits, so reruns
agree whatever order sums were taken in.

Rates become copies, 0 to cap, by systematic rounding along each source's sizes: the running
sum of fractional rates is rounded, so words taken stay within one document's size of the
target. Which documents of a (source, size) get the further copy is settled by a hash of the
id, in salted buckets of some BUCKET rows.

Sources are ranked by code point, null last. Targets share ``total`` of all words by weight;
a source takes ``most`` times its words at most, and what is above is shared again by weight.

Defined results: a null text has size 0; documents of size 0 have rate 1, one copy, and take no
words. Repeated rows are further documents. An empty table gives an empty result. Only the
named columns are used, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

BUCKET = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, source, sk (sorts like the source, null last, and is never null) and size."""
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sk = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    return docs.select(F.col(key).alias("id"), sk.alias("sk"), n.alias("size"))


def targets(cells: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """sk, source_size, docs and target per source, from cells (sk, size, n); one row per source throughout."""
    s = cells.groupBy("sk").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    rank = F.row_number().over(Window.orderBy("sk"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("top", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("top") / F.col("w"), "sk")
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # the water level once the sources before this one have all stopped at their tops
    level = (F.lit(float(total)) * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(by))
    fits = F.when(F.col("top") / F.col("w") >= F.col("level"), F.struct("place", "level"))
    s = s.withColumn("level", F.min(fits).over(every)["level"])
    return s.select("sk", "source_size", "docs", F.least(F.col("top"), F.coalesce(F.col("w") * F.col("level"), F.col("top"))).alias("target"))


def multipliers(cells: DataFrame, sources: DataFrame, cap: int, rounds: int = 60) -> DataFrame:
    """sk, source_size, docs, target and lam per source."""
    at = sources.withColumn("mean", F.col("source_size") / F.col("docs"))
    full = (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)) | (F.col("source_size") == 0)
    at = at.select("*", F.when(full, 0.0).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), full.alias("full"))
    for _ in range(rounds):
        at = written(at, "multipliers")
        x = F.col("size") / F.col("mean")
        e = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        now = cells.filter("size > 0").join(at.filter("not full"), "sk").groupBy("sk").agg(F.sum(words * F.least(e, F.lit(float(cap)))).alias("f"), F.sum(F.when(e < cap, words * x * e).otherwise(0.0)).alias("d"))
        step = at.join(now, "sk", "left").withColumn("miss", F.col("f") / F.col("target") - 1)
        worst = step.agg(F.max(F.abs("miss"))).first()[0]
        if worst is None or worst < 1e-10:
            break
        low = F.when(F.col("miss") < 0, F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(F.col("miss") > 0, F.least("high", "lam")).otherwise(F.col("high"))
        newton = F.when(F.col("d") > 0, F.col("lam") + F.log(F.col("target") / F.col("f")) * F.col("f") / F.col("d"))
        free = F.greatest(F.least(F.coalesce(newton, F.col("lam") - F.signum("miss")), F.col("lam") + 4), F.col("lam") - 4)
        mid = F.when((F.col("low") > -1e8) & (F.col("high") < 1e8), (F.col("low") + F.col("high")) / 2).otherwise(free)
        moved = F.when(F.col("miss").isNull() | (F.col("miss") == 0), F.col("lam")).when((free > F.col("low")) & (free < F.col("high")), free).otherwise(mid)
        at = step.withColumns({"low": low, "high": high}).withColumn("lam", moved).drop("f", "d", "miss")
    return at.withColumn("lam", F.round("lam", 9))


def copies(rows: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, cap: int = 2) -> DataFrame:
    """rows (id, sk, size and any others) with source_size, target, rate and copies (0 to cap)."""
    cells = written(rows.groupBy("sk", "size").agg(F.count("*").alias("n")), "cells")
    at = multipliers(cells, targets(cells, weights, total, cap), cap)
    rate = F.when(F.col("full") & (F.col("size") > 0), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    plan = cells.join(at, "sk").withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate))
    plan = plan.withColumn("base", F.floor("rate").cast("int"))
    by = Window.partitionBy("sk").orderBy(F.col("size").desc())
    run = F.sum(F.col("n") * (F.col("rate") - F.col("base"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    plan = plan.withColumn("run", F.floor(F.round(run, 6) + 0.5)).withColumn("more", (F.col("run") - F.coalesce(F.lag("run").over(by), F.lit(0))).cast("long"))
    plan = plan.withColumn("more", F.greatest(F.lit(0), F.least("more", "n"))).withColumn("buckets", F.ceil(F.col("n") / BUCKET).cast("int"))
    plan = written(plan.select("sk", "size", "n", "source_size", "target", "rate", "base", "more", "buckets"), "plan")
    rows = rows.join(plan, ["sk", "size"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")))
    # a cell's further copies are dealt to its buckets in proportion to their rows
    held = rows.groupBy("sk", "size", "bucket").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("more").alias("more"))
    upto = F.sum("m").over(Window.partitionBy("sk", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda c: F.expr(f"({c}) * more div n")
    held = held.withColumn("upto", upto).select("sk", "size", "bucket", (share("upto") - share("upto - m")).alias("quota"))
    place = F.row_number().over(Window.partitionBy("sk", "size", "bucket").orderBy(F.xxhash64("id", F.lit(1)), "id"))
    rows = rows.withColumn("place", place).join(held, ["sk", "size", "bucket"])
    return rows.withColumn("copies", F.col("base") + (F.col("place") <= F.col("quota")).cast("int")).drop("n", "base", "more", "buckets", "bucket", "place", "quota")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs with each row repeated as often as the mix takes it."""
    found = written(copies(sizes(docs, key, text, source), **how).select("id", "sk", "size", "copies"), "copies").hint("merge")  # grows with docs: never broadcast
    twice = not found.groupBy("id").count().filter("count > 1").isEmpty()
    id_, size_, sk_, k_, f_id, f_size, f_sk, f_k, n_, each_ = fresh(docs.columns, "id", "size", "sk", "k", "f_id", "f_size", "f_sk", "f_k", "copies", "each")
    rows = docs.withColumn(id_, F.col(key))
    if not twice:
        out = rows.join(found.select(F.col("id").alias(f_id), F.col("copies").alias(n_)), F.col(id_).eqNullSafe(F.col(f_id)))
    else:  # rows that share an id are told apart by their order within it
        n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
        sk = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
        rows = rows.withColumns({size_: n, sk_: sk})
        rows = rows.withColumn(k_, F.row_number().over(Window.partitionBy(id_, sk_, size_).orderBy(text)))
        own = found.withColumn(f_k, F.row_number().over(Window.partitionBy("id", "sk", "size").orderBy("copies"))).select(F.col("id").alias(f_id), F.col("sk").alias(f_sk), F.col("size").alias(f_size), f_k, F.col("copies").alias(n_))
        out = rows.join(own, F.col(id_).eqNullSafe(F.col(f_id)) & (F.col(sk_) == F.col(f_sk)) & (F.col(size_) == F.col(f_size)) & (F.col(k_) == F.col(f_k)))
    return out.filter(F.col(n_) > 0).withColumn(each_, F.explode(F.sequence(F.lit(1), F.col(n_)))).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    rows = written(sizes(docs), "sizes")
    out = copies(rows, weights=(3, 1, 2), total=1.5, cap=2)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
