"""Connected components of a distributed edge list, and the splitting of hot groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, written


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the sets of i and j in place; a label is the smallest position of its set."""
    while len(i):
        a, b = labels[i], labels[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        if not len(i):
            return
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            deeper = labels[labels]
            if (deeper == labels).all():
                break
            labels[:] = deeper


def _contract(it):
    """Edges of a partition, as a star from each local component's least node; a million edges at a time."""

    def stars(u, v):
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        labels = np.arange(len(nodes))
        merge(labels, at[: len(u)], at[len(u) :])
        off = labels != np.arange(len(nodes))
        return nodes[off], nodes[labels[off]]

    us, vs, held = [], [], 0
    for b in it:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
        held += b.num_rows
        if held > 1_000_000:
            u, v = stars(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            us, vs, held = [], [], 0
    if held:
        u, v = stars(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
    low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable), for every node of edges (u, v: long).

    Alternating large and small stars; each round is a written table, and only its count and
    a checksum reach the driver. Least neighbours are aggregated before they are shuffled, and
    the joins back are plain equi-joins that adaptive execution splits where a node is hot.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = written(e.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or not now[0]:
            break
        before = now
        e = written(_small_star(_large_star(e)), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def tiled(df: DataFrame, keys: list[str], member: Column, cap: int) -> DataFrame:
    """df with lo, hi and slab: groups of more than cap rows are dealt into slabs, and each row goes to every pair of slabs (lo <= hi) that holds its own.

    A pair of rows of a group meets in exactly one tile (lo, hi) as a pair of the tile's two
    slabs. Groups of up to cap rows stay one tile. No group is cut and no row dropped.
    """
    hot = written(df.groupBy(*keys).count().filter(F.col("count") > cap), "hot")
    one = F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("slab")
    if hot.isEmpty():
        return df.select("*", *one)
    n = F.coalesce(F.ceil(F.col("count") / cap), F.lit(1)).cast("int")
    j = df.join(hot, keys, "left").withColumn("_n", n).withColumn("slab", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    j = j.withColumn("_j", F.explode(F.expr("sequence(0, _n - 1)")))
    return j.select(*df.columns, F.least("slab", "_j").alias("lo"), F.greatest("slab", "_j").alias("hi"), "slab")


def joined_back(rows: DataFrame, found: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with found on keys; found is a written table of one row a key, and count its number of rows.

    A key that holds more than one in 4 x partitions of all rows is joined by broadcast, so its
    rows stay where they are; there can be 4 x partitions such keys at most. The others shuffle.
    """
    share = 4 * partitions(rows.sparkSession)
    total = found.agg(F.sum(count)).first()[0] or 0
    hot = found.filter(F.col(count) * share > total)
    rest = found.filter(F.col(count) * share <= total)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def groups(it, keys: int, rows: int = 150_000):
    """Whole groups of a partition sorted by its first ``keys`` columns: tables that end with a group's last row, of about ``rows`` rows or one group's."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(t: pa.Table) -> int:
        """Where the last group begins."""
        if not t.num_rows:
            return 0
        last = np.ones(t.num_rows, bool)
        for k in range(keys):
            c = t.column(k).to_numpy()
            last &= c == c[-1]
        return int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0

    for b in it:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            at = cut(t)
            if at:
                yield t.slice(0, at)
            held = t.slice(at).to_batches()
            n = t.num_rows - at
            if not at:
                rows = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held)
