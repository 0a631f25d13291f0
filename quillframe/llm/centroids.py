"""Centroid clustering: float32 screening with rigorous rounding-error intervals, exact integers where they overlap.

A vector of ``size`` components becomes the integers floor(64 * x). Against centroids c_0, c_1, ...
its squared distances differ by s_j = |c_j|^2 - 2 q.c_j alone. A float32 matrix product gives all
q.c_j of a block of vectors at once; whatever order it sums in, it is off by at most gamma *
|q| * |c_j| (the inputs' rounding, ``size`` products and sums, Cauchy and Schwarz), so each s_j
lies in a known interval. Centroids whose interval reaches under the least upper end are the
shortlist; a shortlist of one is proven nearest. Where several intervals overlap, the squared
distances of just those are recomputed in exact integers and the lowest number wins a tie.
A product that overflows has an interval without ends, so it is recomputed too.

Rounds are Spark jobs: a task assigns its vectors and adds its own integer sums, which leave it as
limbs of 40 bits (a row per centroid, component and limb that isn't zero), so sums of any size
stay exact; Spark adds the limbs, and the driver sees k x size of them, whatever the rows. Only
the k centroids travel to tasks. The start is a top-k by hash. No group holds a cluster's vectors.

Defined results: vectors that are null, of another length, or hold a null or non-finite component
aren't kept and give no row. Rows with a null vec_id are clustered, and start no centroid while others
can. Repeated rows are further vectors; rows that share a vec_id and a start hash are taken in
the order of their integers. With fewer than k vectors kept each starts a centroid. Distances and inertias
beyond a signed 64-bit integer are given as the largest one (sums of them too); assignments stay
exact. An empty table gives an empty result. Other columns are ignored, so names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

SCALE = 64
LIMB = 40
#: Components up to this size have squared distances of up to 2^11 components within 64 bits.
PLAIN = 1 << 25
MOST = 2**63 - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(64 * x) of finite doubles, exact: int64 where all fit in PLAIN, else Python integers."""
    if not x.size or np.abs(x).max() * SCALE < PLAIN:
        return np.floor(x * SCALE).astype(np.int64)
    flat = [(n * SCALE) // d for n, d in map(float.as_integer_ratio, x.ravel().tolist())]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(x.shape)


def _rows(lists: pa.Array) -> np.ndarray:
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return values[offsets[0] : offsets[-1]].astype(np.float64).reshape(len(lists), -1)


def _plain(a: np.ndarray) -> bool:
    return a.dtype != object or not a.size or max(map(abs, a.ravel().tolist())) < PLAIN


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of q and c side by side, in exact integers."""
    if _plain(q) and _plain(c):
        return ((q.astype(np.int64) - c.astype(np.int64)) ** 2).sum(axis=1)
    return ((q.astype(object) - c.astype(object)) ** 2).sum(axis=1)


def screen(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows, centroids): whether a centroid's interval reaches under the least upper end of its row's."""
    with np.errstate(over="ignore", invalid="ignore"):
        qd, cd = q.astype(np.float64), c.astype(np.float64)
        p = (qd.astype(np.float32) @ cd.astype(np.float32).T).astype(np.float64)
        n = q.shape[1] + 8
        gamma = n * 2.0**-24 / (1 - n * 2.0**-24)
        cc = (cd * cd).sum(axis=1)
        norms = np.sqrt((qd * qd).sum(axis=1))[:, None] * np.sqrt(cc)[None]
        off = (2 * gamma * norms + n * 2.0**-52 * (cc[None] + 2 * np.abs(p))) * (1 + 1e-9)
        s = cc[None] - 2 * p
        wild = ~np.isfinite(s) | ~np.isfinite(off)
        low, high = np.where(wild, -np.inf, s - off), np.where(wild, np.inf, s + off)
    return low <= high.min(axis=1, keepdims=True)


def assign(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each row's nearest centroid, ties to the smaller number."""
    near = screen(q, c)
    own = near.argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) > 1)
    if len(rows):
        i, j = np.nonzero(near[rows])
        d = exact(q[rows[i]], c[j])
        if d.dtype == object:
            best: dict[int, tuple] = {}
            for r, k, x in zip(i.tolist(), j.tolist(), d.tolist(), strict=True):
                if r not in best or (x, k) < best[r]:
                    best[r] = (x, k)
            own[rows[list(best)]] = [k for _, k in best.values()]
        else:
            order = np.lexsort((j, d, i))
            first = order[np.unique(i[order], return_index=True)[1]]
            own[rows[i[first]]] = j[first]
    return own


def _limbs(total: int) -> list[tuple[int, int]]:
    """(limb, value) of an integer, none of them zero; the sign is each limb's own."""
    sign, total, out, k = (-1 if total < 0 else 1), abs(total), [], 0
    while total:
        if part := total & ((1 << LIMB) - 1):
            out.append((k, sign * part))
        total >>= LIMB
        k += 1
    return out


def _sums(it, c: np.ndarray):
    """Rows (cluster, component, limb, value) of a task's own sums; component -1 counts the vectors."""
    sums, n = np.zeros(c.shape, object), np.zeros(len(c), np.int64)
    for b in it:
        for at in range(0, b.num_rows, 8192):
            q = integers(_rows(b.column(0).slice(at, 8192)))
            own = assign(q, c)
            n += np.bincount(own, minlength=len(c))
            for k in np.unique(own).tolist():
                sums[k] += q[own == k].sum(axis=0).astype(object)
    out = [(k, -1, 0, int(x)) for k, x in enumerate(n.tolist()) if x]
    out += [(k, i, limb, v) for k in np.flatnonzero(n).tolist() for i, x in enumerate(sums[k].tolist()) for limb, v in _limbs(int(x))]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "component", "limb", "value"])


def _nearest(it, c: np.ndarray):
    for b in it:
        for at in range(0, b.num_rows, 8192):
            own = b.slice(at, 8192)
            q = integers(_rows(own.column(1)))
            k = assign(q, c)
            d = [min(int(x), MOST) for x in exact(q, c[k]).tolist()]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(k, pa.int32()), pa.array(d, pa.int64())], names=["id", "cluster", "distance"])


def _array(rows: list[list[int]]) -> np.ndarray:
    out = np.empty((len(rows), len(rows[0])), object)
    for k, r in enumerate(rows):
        out[k] = r
    return out.astype(np.int64) if _plain(out) else out


def kept_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.filter(f"v is not null and size(v) = {int(size)} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def start(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k first vectors by the lowercase-hex sha256 of seed:id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return _array([integers(np.array([r.v], float))[0].tolist() for r in first]) if first else np.zeros((0, 0), np.int64)


def moved(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    """Centroids after a round: componentwise floors of sum / count; empty ones stay."""
    parts = rows.select("v").mapInArrow(lambda it: _sums(it, c), "cluster int, component int, limb int, value long")
    found = parts.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect()  # at most k x (size + 1) rows a limb
    total: dict[tuple[int, int], int] = {}
    for r in found:
        total[r.cluster, r.component] = total.get((r.cluster, r.component), 0) + (r.value << (LIMB * r.limb))
    return _array([[total.get((k, i), 0) // total[k, -1] for i in range(c.shape[1])] if (k, -1) in total else c[k].tolist() for k in range(len(c))])


def cluster(df: DataFrame, *, k: int = 16, rounds: int = 3, size: int = 64, seed: str = "1", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every kept vector."""
    spark = df.sparkSession
    bounded_batches(spark, 8192)
    rows = kept_vectors(df, key, vector, size)
    c = start(rows, k, seed)
    schema = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(c):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        c = moved(rows, c)
    last = c
    own = written(rows.mapInArrow(lambda it: _nearest(it, last), "id long, cluster int, distance long"), "assigned")
    sums = own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows
    every = sum(int(r.own) for r in sums)
    digest = lambda j: hashlib.sha256(",".join(str(int(x)) for x in last[j]).encode()).hexdigest()
    known = spark.createDataFrame([(r.cluster, min(int(r.own), MOST), min(every, MOST), digest(r.cluster)) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return own.join(F.broadcast(known), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 16, rounds: int = 3, size: int = 64, seed: str = "1") -> str:
    """The same in DuckDB, every round a common table expression."""
    out = [
        f"""WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, q) - 1 AS j, q FROM kept QUALIFY j < {k}
)"""
    ]
    for n in range(rounds + 1):
        out.append(
            f""", a{n} AS (
  SELECT r, min(list_sum(list_transform(range(1, {size + 1}), lambda i: (kept.q[i] - c.q[i]) * (kept.q[i] - c.q[i])))::HUGEINT * {k} + c.j) AS m
  FROM kept, c{n} c GROUP BY r
)"""
        )
        if n < rounds:
            out.append(
                f""", s{n} AS (
  SELECT (m % {k})::INT AS j, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{n} JOIN kept USING (r), unnest(range(1, {size + 1})) t(i) GROUP BY ALL
), m{n} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{n} GROUP BY j
), c{n + 1} AS (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m USING (j))"""
            )
    out.append(
        f"""
SELECT vec_id, (m % {k})::INT AS cluster, (m // {k})::BIGINT AS distance, (sum(m // {k}) OVER (PARTITION BY m % {k}))::BIGINT AS cluster_inertia,
       (sum(m // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.j = m % {k}"""
    )
    return "".join(out)
