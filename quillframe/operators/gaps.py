"""Gap statistics: histogram, second peak, a two-Poisson mixture, and words split at wide gaps.

Gaps are the hours between a user's events, rounded and clipped to 1..70.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table

MOST = 70
#: Starting rates of the mixture.
RATES = (4.0, 15.0)


def gaps(events: DataFrame) -> DataFrame:
    """user_id, event_id and gap (hours since the user's event before)."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = events.select("user_id", "event_id", "ts", ((ts - F.lag(ts).over(w)) / 3.6e9).alias("gap"))
    return g.filter("gap is not null")


def histogram(g: DataFrame) -> DataFrame:
    """gap, n over all bins 1..MOST."""
    b = g.groupBy(F.least(F.greatest(F.round("gap"), F.lit(1)), F.lit(MOST)).cast("int").alias("gap")).agg(F.count("*").alias("n"))
    bins = g.sparkSession.range(1, MOST + 1).select(F.col("id").cast("int").alias("gap"))
    return bins.join(b, "gap", "left").select("gap", F.coalesce("n", F.lit(0)).alias("n"))


def second_peak(hist: DataFrame) -> DataFrame:
    """width: the bin where the second rise begins that also ends; one more than MOST if there is none. One row of MOST bins."""
    counts = hist.agg(F.array_sort(F.collect_list(F.struct("gap", "n"))).alias("h")).select(F.transform("h", lambda x: x["n"]).alias("n"))
    step = """aggregate(sequence(1, size(n) - 1), named_struct('start', 0, 'closed', 0, 'width', 0),
      (a, i) -> CASE WHEN a.width > 0 THEN a
        WHEN n[i] > n[i - 1] THEN named_struct('start', if(a.start = 0, i + 1, a.start), 'closed', a.closed, 'width', 0)
        WHEN a.start > 0 THEN named_struct('start', 0, 'closed', a.closed + 1, 'width', if(a.closed = 1, a.start, 0))
        ELSE a END, a -> if(a.width > 0, a.width, size(n) + 1))"""
    return counts.select(F.expr(step).alias("width"))


def _terms(hist: DataFrame, l1: float, l2: float) -> DataFrame:
    """Per bin s with its count and the mixture's terms; c comes with the row."""
    fact = F.expr("aggregate(sequence(1, gap), 0D, (a, k) -> a + ln(double(k)))")
    x = hist.filter("n > 0").withColumn("fact", fact)
    a = F.lit(np.log(l1)) * F.col("gap") - l1
    b = F.col("c") - F.col("gap") + F.lit(np.log(l2)) * F.col("gap") - l2
    return x.withColumn("a", a).withColumn("b", b)


def mixture(hist: DataFrame, width: DataFrame, l1: float = RATES[0], l2: float = RATES[1]) -> DataFrame:
    """nll and its gradient d1, d2, d3 by (ln l1, ln l2, ln c) at the rates and c = width, in one aggregate over bins."""
    x = _terms(hist.crossJoin(width.select(F.col("width").cast("double").alias("c"))), l1, l2)
    top = F.greatest("a", "b")
    lse = top + F.log(F.exp(F.col("a") - top) + F.exp(F.col("b") - top))
    soft = F.greatest(F.lit(0.0), F.col("c") - F.col("gap")) + F.log1p(F.exp(-F.abs(F.col("c") - F.col("gap"))))
    sig = F.exp(F.col("a") - lse)
    gate = 1 / (1 + F.exp(F.col("gap") - F.col("c")))
    n, s = F.col("n"), F.col("gap")
    total = lambda e: F.sum(n * e)
    return x.agg(
        F.round(total(F.col("fact") + soft - lse), 6).alias("nll"),
        F.round(l1 * total(sig) - total(s * sig), 6).alias("d1"),
        F.round(l2 * total(F.lit(1.0)) - total(s) - l2 * total(sig) + total(s * sig), 6).alias("d2"),
        F.round(total(F.col("c") * gate) - total(F.col("c") * (1 - sig)), 6).alias("d3"),
    )


def minimise(f, x: np.ndarray, steps: int = 200) -> np.ndarray:
    """Polak-Ribiere conjugate gradients with a backtracking line search; f returns a value and a gradient."""
    v, g = f(x)
    d, t = -g, 1e-3
    for _ in range(steps):
        slope = float(g @ d)
        if slope >= 0:
            d, slope = -g, -float(g @ g)
        if -slope < 1e-14:
            break
        t = min(t * 4, 1.0)
        while t > 1e-14:
            new = x + t * d
            nv, ng = f(new)
            if np.isfinite(nv) and nv <= v + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        beta = max(0.0, float(ng @ (ng - g)) / max(float(g @ g), 1e-300))
        x, v, g, d = new, nv, ng, -ng + beta * d
    return x


def objective(s: np.ndarray, n: np.ndarray):
    """nll and gradient by theta over a histogram, for minimise."""
    fact = np.array([np.log(np.arange(1, k + 1)).sum() for k in s])

    def f(theta: np.ndarray):
        l1, l2, c = np.exp(theta)
        a, b = s * theta[0] - l1, c - s + s * theta[1] - l2
        lse = np.logaddexp(a, b)
        sig = np.exp(a - lse)
        soft = np.logaddexp(0, c - s)
        gate = np.exp(c - s - soft)
        nll = float((n * (fact + soft - lse)).sum())
        return nll, np.array([(n * (l1 - s) * sig).sum(), (n * (l2 - s) * (1 - sig)).sum(), c * (n * (gate - (1 - sig))).sum()])

    return f


def fit(hist: DataFrame, restarts: int = 10) -> DataFrame:
    """l1, l2, c, width: the mixture fitted on MOST bins (all that reaches the driver); the second peak where no fit lies between the modal gap and MOST."""
    spark = hist.sparkSession
    rows = sorted((r.gap, r.n) for r in hist.collect())
    s, n = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    width = float(second_peak(hist).first().width)
    modal, r = float(s[n.argmax()]), np.random.default_rng(1)
    start = np.log([*RATES, width])
    for k in range(restarts):
        with np.errstate(over="ignore", invalid="ignore"):
            l1, l2, c = np.exp(minimise(objective(s, n), start + (r.normal(0, 0.3, 3) if k else 0)))
        if modal <= c <= MOST:
            return spark.createDataFrame([(float(l1), float(l2), float(c), float(c))], "l1 double, l2 double, c double, width double")
    return spark.createDataFrame([(*RATES, width, width)], "l1 double, l2 double, c double, width double")


def gap_words(g: DataFrame, width: float) -> DataFrame:
    """user_id, word, n, spaces: runs of events between gaps of width or more, with the spaces (gap over width, rounded down) before the run."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = g.withColumn("k", F.floor(F.col("gap") / width)).withColumn("word", F.sum(F.when(F.col("k") > 0, 1).otherwise(0)).over(w))
    return x.groupBy("user_id", "word").agg(F.count("*").alias("n"), F.sum("k").alias("spaces"))


_gaps = lambda s, d: gaps(table(s, d, "events"))
G = "WITH g AS (SELECT user_id, event_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9 AS gap FROM events QUALIFY gap IS NOT NULL), h AS (SELECT i::INT AS gap, (SELECT count(*) FROM g WHERE least(greatest(round(gap), 1), 70) = i)::BIGINT AS n FROM range(1, 71) t(i))"
PEAK = ", r AS (SELECT gap, n > lag(n, 1, n) OVER (ORDER BY gap) AS up FROM h), e AS (SELECT *, lag(up, 1, false) OVER (ORDER BY gap) AS was FROM r), b AS (SELECT gap, row_number() OVER (ORDER BY gap) AS k FROM e WHERE up AND NOT was), z AS (SELECT gap, row_number() OVER (ORDER BY gap) AS k FROM e WHERE NOT up AND was), pk AS (SELECT coalesce((SELECT b.gap FROM b JOIN z USING (k) WHERE k = 2), 71)::INT AS width)"
MIX = ", m AS (SELECT gap AS s, n, width::DOUBLE AS c, ln(4.0::DOUBLE) * gap - 4 AS a, width - gap + ln(15.0::DOUBLE) * gap - 15 AS b, lgamma(gap + 1) AS fact FROM h, pk WHERE n > 0), q AS (SELECT *, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS lse, greatest(0, c - s) + ln(1 + exp(-abs(c - s))) AS soft, 1 / (1 + exp(s - c)) AS gate FROM m)"

QUERIES = {
    "gap_hist": (lambda s, d: histogram(_gaps(s, d)), f"{G} SELECT gap, n FROM h"),
    "second_peak": (lambda s, d: second_peak(histogram(_gaps(s, d))), f"{G}{PEAK} SELECT width FROM pk"),
    "poisson_mix_nll": (lambda s, d: mixture(h := histogram(_gaps(s, d)), second_peak(h)).select("nll"), f"{G}{PEAK}{MIX} SELECT round(sum(n * (fact + soft - lse)), 6) AS nll FROM q"),
    "poisson_mix_grad": (lambda s, d: mixture(h := histogram(_gaps(s, d)), second_peak(h)).select("d1", "d2", "d3"), f"{G}{PEAK}{MIX} SELECT round(sum(n * (4 - s) * exp(a - lse)), 6) AS d1, round(sum(n * (15 - s) * (1 - exp(a - lse))), 6) AS d2, round(sum(n * c * (gate - 1 + exp(a - lse))), 6) AS d3 FROM q"),
    "space_model": (lambda s, d: fit(histogram(_gaps(s, d))), None),
    "gap_words": (lambda s, d: gap_words(_gaps(s, d), 24.0), f"{G}, k AS (SELECT *, floor(gap / 24) AS k FROM g), w AS (SELECT *, (sum((k > 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS word FROM k) SELECT user_id, word, count(*)::BIGINT AS n, sum(k)::BIGINT AS spaces FROM w GROUP BY ALL"),
}
