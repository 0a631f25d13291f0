"""Scans: tables by name, text files, alphabets, region files, accuracy reports and markup bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stored import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_corpus(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """doc and text of whole files under a path; pattern picks file names."""
    r = spark.read.option("wholetext", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return r.text(path).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def alphabet(spark: SparkSession, path: str) -> DataFrame:
    """sym_id (the line's order from 1) and val; white space counts. An alphabet file is one small file."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split(F.regexp_replace("value", "\\n$", ""), "\\n")))
    return lines.select((F.col("pos") + 1).alias("sym_id"), F.col("col").alias("val"))


def running_before(df: DataFrame, key: str, amount: str, to: str) -> DataFrame:
    """df with the sum of amount over all rows before this one in order of key (unique, of any type that sorts).

    Keys are dealt into ranges of about equal numbers of rows, which are written with their number, so gaps
    between keys don't matter: sums inside a range, and a running sum over the ranges, one row each.
    """
    d = stored(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranges")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = d.groupBy("_part").agg(F.sum(amount).alias("_m")).select("_part", before("_m", Window.orderBy("_part")).alias("_b"))
    return d.join(F.broadcast(parts), "_part").withColumn(to, F.col("_b") + before(amount, Window.partitionBy("_part").orderBy(key))).drop("_part", "_b")


def capped(docs: DataFrame, cap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts in order of key up to cap symbols in all: the last one is cut, those behind get none."""
    d = running_before(docs.select(key, F.length(text).cast("long").alias("n")), key, "n", "before")
    d = d.withColumn("left", F.greatest(F.lit(0), cap - F.col("before"))).select(key, "left", "n")
    return docs.select(key, text).join(d, key).select(key, F.expr(f"substring({text}, 1, int(least(left, n)))").alias("text"), F.least("left", "n").alias("kept"))


def regions(lines: DataFrame, classes: list[str], page: str = "page", text: str = "text") -> DataFrame:
    """page, region, class, l, t, r, b of region files' texts: ``class = x`` and ``pos = l t r b`` paired by order, % comments out; classes that begin like one of classes are kept."""
    x = lines.select(page, F.posexplode(F.split(text, "\\n")).alias("at", "line")).filter("line not rlike '^\\\\s*%'")
    kind = F.regexp_extract("line", "^\\s*class\\s*=\\s*(\\S+)", 1)
    pos = F.regexp_extract("line", "^\\s*pos\\s*=\\s*(\\d+\\s+\\d+\\s+\\d+\\s+\\d+)", 1)
    w = Window.partitionBy(page).orderBy("at")
    k = x.filter(kind != "").select(page, kind.alias("class"), F.row_number().over(w).alias("region"))
    p = x.filter(pos != "").select(page, F.split(pos, "\\s+").alias("p"), F.row_number().over(w).alias("region"))
    out = k.join(p, [page, "region"])
    keep = F.lit(False)
    for c in classes:
        keep = keep | F.startswith("class", F.lit(c))
    return out.filter(keep).select(page, "region", "class", *[F.col("p")[i].cast("int").alias(n) for i, n in enumerate("ltrb")])


def accuracy_report(reports: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class, total, wrong from report texts with rows ``total wrong pct ASCII class``."""
    x = reports.select(key, F.explode(F.split(text, "\\n")).alias("line"))
    pat = "^\\s*(\\d+)\\s+(\\d+)\\s+([0-9.]+)%?\\s+ASCII\\s+(.+?)\\s*$"
    return x.filter(F.col("line").rlike(pat)).select(key, F.regexp_extract("line", pat, 4).alias("class"), F.regexp_extract("line", pat, 1).cast("long").alias("total"), F.regexp_extract("line", pat, 2).cast("long").alias("wrong"))


def word_report(reports: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, total and wrong of word reports: the third and fourth line of their first 175 bytes."""
    line = F.split(F.substring(text, 1, 175), "\\n")
    num = lambda i: F.regexp_extract(F.try_element_at(line, F.lit(i)), "(\\d+)", 1).cast("long")
    return reports.select(key, num(3).alias("total"), num(4).alias("wrong"))


def squeezed_lines(listing: DataFrame, text: str = "text") -> DataFrame:
    """The non-empty lines of a listing."""
    return listing.select(F.explode(F.filter(F.split(text, "\\n"), lambda x: x != "")).alias("line"))


def markup_body(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The text of each page's body, to the page's end where it isn't closed; lines of it that begin with reuter (any case) are dropped."""
    rest = F.regexp_extract(html, "(?is)<body[^>]*>(.*)$", 1)
    body = F.regexp_replace(rest, "(?is)</body.*$", "")
    kept = F.filter(F.split(body, "\\n"), lambda x: ~x.rlike("^(?i)reuter"))
    return pages.select(key, F.array_join(kept, "\n").alias("body"))


def body_lines(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """The line-wise filter: what follows an opening tag and the lines up to a closing one, which goes whole; an opening is tested first."""
    opens = F.col(line).contains("<BODY>")
    mark = F.when(opens, 1).when(F.col(line).contains("</BODY>"), 0)
    w = Window.partitionBy(key).orderBy(order)
    state = F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0))
    out = lines.withColumn("_s", state).withColumn("_o", opens).filter("_s = 1")
    out = out.withColumn(line, F.when(F.col("_o"), F.regexp_replace(line, "^.*?<BODY>", "")).otherwise(F.col(line)))
    return out.filter(~F.col(line).rlike("^(?i)reuter")).drop("_s", "_o")
