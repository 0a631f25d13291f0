"""Clusters against symbols by positional features: for a symbol c, its share of each place in words of each length.

A feature vector has LONGEST * (LONGEST + 1) / 2 numbers. Symbols are an alphabet, 95 rows at
most, and reach every task as one matrix; clusters stream past it in Arrow batches, so no
cluster-symbol-feature rows are ever made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .components import W
from .components import positions as cluster_positions
from .lexicon import LONGEST, POS, positions, word_counts

COLUMNS = LONGEST * (LONGEST + 1) // 2
#: Distances halfway between two roundings, which small binary fractions often are, all go up.
NUDGE = 1e-12


def column(len_, pos):
    """The feature's number, from 0: block by length, then place."""
    return (len_ * (len_ - 1) / 2 + pos - 1).cast("int")


def symbol_matrix(counts: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Symbols in order, their raw counts and their shares by symbol and length; an alphabet's rows reach the driver."""
    rows = counts.select("c", "len", column(F.col("len"), F.col("pos")).alias("k"), "n").collect()
    syms = sorted({r.c for r in rows})
    raw = np.zeros((len(syms), COLUMNS))
    for r in rows:
        raw[syms.index(r.c), r.k] = r.n
    return syms, raw, shares(raw)


def shares(raw: np.ndarray) -> np.ndarray:
    out = np.zeros_like(raw)
    for n in range(1, LONGEST + 1):
        b = slice(n * (n - 1) // 2, n * (n + 1) // 2)
        total = raw[:, b].sum(axis=1, keepdims=True)
        out[:, b] = np.divide(raw[:, b], total, out=np.zeros_like(raw[:, b]), where=total > 0)
    return out


def weights(raw: np.ndarray, wp: float, per_symbol: bool = False) -> np.ndarray:
    """A weight per symbol and feature: wp times the share of symbol mass in the feature's length, the rest even."""
    block = np.concatenate([np.full(n, n - 1) for n in range(1, LONGEST + 1)])
    mass = np.stack([raw[:, block == n].sum(axis=1) for n in range(LONGEST)], axis=1)
    if per_symbol:
        total = mass.sum(axis=1, keepdims=True)
        wt = np.divide(mass, total, out=np.full_like(mass, 1 / LONGEST), where=total > 0)
    else:
        wt = np.tile(mass.sum(axis=0) / max(mass.sum(), 1e-300), (len(raw), 1))
    return wp * wt[:, block] + (1 - wp) * LONGEST / COLUMNS


def rank(clusters: DataFrame, symbols: DataFrame, *, metric: str = "euc", wp: float = 0.0, per_symbol: bool = False, prior: float = 0.0, best: int = 3, key: str = "doc_id") -> DataFrame:
    """key, c, rank, sym, dist: the best symbols of each cluster by weighted distance of shares, ties by symbol.

    metric: euc (squared differences, no root) or manhattan. prior: so many counts of the
    symbols' mean profile of the cluster's class are added to each length first.
    """
    if metric not in ("euc", "manhattan"):
        raise ValueError("metric is euc or manhattan")
    syms, raw, share = symbol_matrix(symbols)
    w = weights(raw, wp, per_symbol)
    classes = np.array([1 if c in T.TALL else 2 if c in T.DEEP else 3 if c in T.LOW else 0 for c in syms])
    profile = np.zeros((4, COLUMNS))
    for k in range(4):
        for n in range(1, LONGEST + 1):
            b = slice(n * (n - 1) // 2, n * (n + 1) // 2)
            t = raw[classes == k][:, b].sum(axis=0)
            profile[k, b] = t / t.sum() if t.sum() else 0
    f = clusters.groupBy(key, "c").agg(F.collect_list(F.struct(column(F.col("len"), F.col("pos")).alias("k"), "n")).alias("f"))
    f = f.select(key, "c", T.symbol_class(F.col("c")).alias("class"), F.col("f.k").alias("k"), F.col("f.n").alias("n"))

    def over(it):
        for b in it:
            for at in range(0, len(b), 512):
                p = b.iloc[at : at + 512]
                x = np.zeros((len(p), COLUMNS))
                for i, (k, n) in enumerate(zip(p["k"], p["n"], strict=True)):
                    x[i, k] = n
                x = shares(x + prior * profile[p["class"].to_numpy()] if prior else x)
                if metric == "euc":
                    d = (x * x) @ w.T - 2 * x @ (w * share).T + (w * share * share).sum(axis=1)
                else:
                    d = np.stack([(np.abs(x - share[j]) * w[j]).sum(axis=1) for j in range(len(syms))], axis=1)
                d = np.round(d + NUDGE, 9) + 0.0
                order = np.argsort(d, axis=1, kind="stable")[:, :best]
                rows = np.arange(len(p))[:, None]
                yield pd.DataFrame({key: np.repeat(p[key].to_numpy(), order.shape[1]), "c": np.repeat(p["c"].to_numpy(), order.shape[1]), "rank": np.tile(np.arange(1, order.shape[1] + 1), len(p)), "sym": np.array(syms, object)[order].ravel(), "dist": d[rows, order].ravel()})

    return f.mapInPandas(over, f"{key} long, c string, rank int, sym string, dist double")


def _query(**how):
    return lambda s, d: rank(cluster_positions(table(s, d, "documents")), positions(word_counts(table(s, d, "documents"))), **how)


RANKED = f"""WITH {W}, {POS}, x0 AS (SELECT doc_id, length(word)::INT AS len, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1)::INT AS pos FROM w1 WHERE length(word) <= 15),
  x1 AS (SELECT doc_id, c, len, pos, count(*) AS n FROM x0 GROUP BY ALL), x AS (SELECT doc_id, c, len, pos, n / sum(n) OVER (PARTITION BY doc_id, c, len) AS x FROM x1),
  y AS (SELECT c AS sym, len, pos, n / sum(n) OVER (PARTITION BY c, len) AS y FROM pc), ms AS (SELECT len, sum(n) / (SELECT sum(n) FROM pc) AS mass FROM pc GROUP BY 1),
  wt AS (SELECT l::INT AS len, WP * coalesce(mass, 0) + (1 - WP) * 0.125::DOUBLE AS w FROM range(1, 16) t(l) LEFT JOIN ms ON ms.len = l),
  a AS (SELECT doc_id, c, sum(w * AX) AS a FROM x JOIN wt USING (len) GROUP BY ALL), b AS (SELECT sym, sum(w * AY) AS b FROM y JOIN wt USING (len) GROUP BY ALL),
  z AS (SELECT doc_id, c, sym, sum(w * (AXY)) AS z FROM x JOIN y USING (len, pos) JOIN wt USING (len) GROUP BY ALL),
  r AS (SELECT a.doc_id, a.c, b.sym, round(a + b + coalesce(z, 0) + 1e-12, 9) + 0.0 AS dist FROM a CROSS JOIN b LEFT JOIN z ON z.doc_id = a.doc_id AND z.c = a.c AND z.sym = b.sym),
  k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, c ORDER BY dist, sym))::INT AS rank FROM r) SELECT doc_id, c, rank, sym, dist FROM k WHERE rank <= 3"""


def _sql(wp: float = 0.0, manhattan: bool = False) -> str:
    parts = ("abs(x - y) - x - y", "x", "y") if manhattan else ("-2 * x * y", "x * x", "y * y")
    return RANKED.replace("WP", f"{wp}::DOUBLE").replace("AXY", parts[0]).replace("AX", parts[1]).replace("AY", parts[2])


QUERIES = {
    "pos_rank_euc": (_query(), _sql()),
    "pos_rank_manhattan": (_query(metric="manhattan"), _sql(manhattan=True)),
    "pos_rank_weighted": (_query(wp=0.85), _sql(0.85)),
    "pos_rank_prior": (_query(prior=5.0), None),
}
