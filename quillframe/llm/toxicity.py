"""Toxicity: a convolutional text classifier over hashed word embeddings, trained on every labelled row.

A word's embedding is the sum of one row of each of two hashed tables, so that a word that
shares a row of one table by chance is told apart by the other. Filters of widths 1, 2 and 3
run over the whole text, max pooling keeps each filter's best place, and a logistic layer
gives the score. The tables start from the training words' smoothed log-odds, counted over all
training rows, and small noise; tables, filters and output are then trained by Adagrad on logistic
loss, and the logits are Platt-scaled on a held-aside fifth of the training rows. A threshold per language
is chosen there too: the lowest multiple of 0.0001 (from 0.5 to 0.9) that keeps the share of clean rows
at or above it within ``false_positives``; languages with few such rows take the threshold of all. Scores
themselves never see a language, label, source or id.

All labelled rows are fitted, in rounds. They are dealt by hash of doc_id into shards of some
``SHARD`` rows; in a round every shard trains its own copy of the model on its rows, and Spark adds up what
copies changed, row of a table by row. The next round's model is the mean of the copies that touched a
row. Sums are of whole multiples of 2^-32, so their order doesn't matter. The driver holds the model, never rows.

Inference multiplies each distinct word of a batch with all filter taps once and adds the
taps up along the texts.

Defined results: null and empty texts and texts without words get the score of a text of
padding. Labels that are null are left out; a doc_id with several labels counts as toxic if
one says so, and several rows of a doc_id as one training text. With no labels, or of one class
only, nothing is learnt: every score is about 1 if that class is toxic, else about 0.
Repeated rows get repeated results. Only the named columns are used, so names can't clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, sliced, strings, trimmed, written

ROWS, DIMS, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
TAPS = sum(WIDTHS)
#: The width that each tap belongs to.
OWNER = np.repeat(np.arange(len(WIDTHS)), WIDTHS)
#: Rows of a shard, some: a task trains on one at a time.
SHARD = 8000
#: Rounds over all shards.
ROUNDS = 4
#: Changes of a round are added up as multiples of this one's inverse.
UNIT = 2.0**32
#: Steps from 0 to 1 that thresholds are chosen from.
GRID = 10_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _crcs(ws: list[str]) -> np.ndarray:
    return np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in ws], np.uint32)


def _places(crcs: np.ndarray) -> np.ndarray:
    """The rows of the two tables for each word's crc32; row 0 is the padding's."""
    h = crcs.astype(np.uint64)
    mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)
    return np.stack([h % np.uint64(ROWS - 1) + np.uint64(1), mixed % np.uint64(ROWS - 1) + np.uint64(1)]).astype(np.int64)


def _hashed(ws: list[str]) -> np.ndarray:
    return _places(_crcs(ws))


@dataclass
class Model:
    tables: np.ndarray  # 2 x ROWS x DIMS
    taps: np.ndarray  # DIMS x TAPS x FILTERS, width after width
    bias: np.ndarray  # widths x FILTERS
    out: np.ndarray  # widths * FILTERS
    prior: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.7
    fitted: bool = True

    def pooled(self, projected: np.ndarray, index: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Each text's best value of each filter. projected: taps of each distinct word, padding first; index: the words' places, each text followed by three of padding (0); begins: of texts. Filters begin at words alone, or at the padding of an empty text."""
        out, tap, idle = [], 0, index == 0
        idle[begins] = False
        for k, w in enumerate(WIDTHS):
            z = projected[:, tap].take(index, axis=0)
            for s in range(1, w):
                z[:-s] += projected[:, tap + s].take(index[s:], axis=0)
            tap += w
            z[idle] = -np.inf
            out.append(np.maximum(np.maximum.reduceat(z, begins, axis=0) + self.bias[k], 0))
        return np.concatenate(out, axis=1)

    def project(self, rows: np.ndarray) -> np.ndarray:
        x = self.tables[0, rows[0]] + self.tables[1, rows[1]]
        return np.einsum("nd,dtf->ntf", x, self.taps, optimize=True).astype(np.float32)

    def logits(self, texts: list[str]) -> np.ndarray:
        """Whole texts' logits."""
        if not self.fitted or not texts:
            return np.full(len(texts), self.prior)
        known: dict[str, int] = {}
        index, begins, n = [], [], 0
        for t in texts:
            ws = words(t)
            begins.append(n)
            part = np.empty(len(ws) + 3, np.int64)
            part[: len(ws)] = [known.setdefault(w, len(known) + 1) for w in ws]
            part[len(ws) :] = 0
            index.append(part)
            n += len(part)
        rows = np.concatenate([np.zeros((2, 1), np.int64), _hashed(list(known))], axis=1) if known else np.zeros((2, 1), np.int64)
        raw = self.pooled(self.project(rows), np.concatenate(index), np.array(begins)) @ self.out + self.prior
        return self.scale[0] * raw + self.scale[1]

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64), -60, 60)))


class Weights:
    """All numbers that are trained as rows of DIMS: the two tables, then taps, bias, output and prior."""

    TAIL = -(-(DIMS * TAPS * FILTERS + 2 * len(WIDTHS) * FILTERS + 1) // DIMS)

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.tables = rows[: 2 * ROWS].reshape(2, ROWS, DIMS)
        tail, n, m = rows[2 * ROWS :].reshape(-1), DIMS * TAPS * FILTERS, len(WIDTHS) * FILTERS
        self.taps = tail[:n].reshape(DIMS, TAPS, FILTERS)
        self.bias, self.out, self.prior = tail[n : n + m].reshape(len(WIDTHS), FILTERS), tail[n + m : n + 2 * m], tail[n + 2 * m : n + 2 * m + 1]

    @classmethod
    def filled(cls, value: float) -> Weights:
        return cls(np.full((2 * ROWS + cls.TAIL, DIMS), value, np.float32))

    def copy(self) -> Weights:
        return Weights(self.rows.copy())

    def model(self) -> Model:
        return Model(self.tables, self.taps, self.bias, self.out, float(self.prior[0]))


def begun(n: np.ndarray, size: np.ndarray, *, seed: int = 7) -> Weights:
    """The weights to start from. n: texts of each class that hold a row of a table (tables x classes x ROWS); size: texts of each class."""
    r = np.random.default_rng(seed)
    w = Weights.filled(0)
    w.tables[:] = r.normal(0, 0.01, (2, ROWS, DIMS))
    odds = np.log((n[:, 1] + 3) / (size[1] + 6)) - np.log((n[:, 0] + 3) / (size[0] + 6))
    odds[n.sum(1) == 0] = 0
    w.tables[..., 0] = odds / 4
    w.tables[:, 0] = 0
    w.taps[:] = r.normal(0, 0.2, (DIMS, TAPS, FILTERS))
    w.taps[0] = np.abs(w.taps[0]) + 0.4
    w.bias[:], w.out[:] = -0.4, r.normal(0.3, 0.1, len(WIDTHS) * FILTERS)
    w.prior[0] = np.log((size[1] + 0.5) / (size[0] + 0.5))
    return w


def step(w: Weights, past: Weights, x: np.ndarray, y: int, *, rate: float = 0.05) -> list[np.ndarray]:
    """One text's step of Adagrad, in place; x: the two tables' rows of its words. Returns the rows of each table that moved."""
    m = max(x.shape[1], 1)
    x = np.concatenate([x, np.zeros((2, m + 2 - x.shape[1]), np.int64)], axis=1)
    e = w.tables[0, x[0]] + w.tables[1, x[1]]
    z = (e @ w.taps.reshape(DIMS, -1)).reshape(len(e), TAPS, FILTERS)
    pooled, places, tap = np.empty((len(WIDTHS), FILTERS), np.float32), np.empty((TAPS, FILTERS), np.int64), 0
    for k, width in enumerate(WIDTHS):
        own = z[:m, tap] + sum(z[s : m + s, tap + s] for s in range(1, width))
        at = own.argmax(axis=0)
        pooled[k] = np.maximum(own[at, np.arange(FILTERS)] + w.bias[k], 0)
        places[tap : tap + width] = at + np.arange(width)[:, None]
        tap += width
    score = 1 / (1 + np.exp(-np.clip(float(pooled.ravel() @ w.out + w.prior[0]), -30, 30)))
    d = np.float32(score - y)
    back = d * w.out.reshape(pooled.shape) * (pooled > 0)
    own = back[OWNER]
    rows = (own[..., None] * w.taps.transpose(1, 2, 0)).reshape(-1, DIMS)
    moves = [("taps", own * e[places].transpose(2, 0, 1)), ("bias", back), ("out", d * pooled.ravel()), ("prior", d)]
    moved = []
    for t in range(2):
        at = x[t, places.ravel()]
        live = (own.ravel() != 0) & (at > 0)
        at, g = at[live], rows[live]
        np.add.at(past.tables[t], at, g * g)
        np.add.at(w.tables[t], at, -rate * g / np.sqrt(past.tables[t][at]))
        moved.append(at)
    for name, g in moves:
        sums = getattr(past, name)
        sums += g * g
        getattr(w, name)[...] -= rate * g / np.sqrt(sums)
    return moved


_SUMS = [f"{k}{i}" for k in "wp" for i in range(DIMS)]
_CHANGES = ", ".join(["row int", *[f"{c} long" for c in _SUMS]])


def _changes(w: Weights, past: Weights, base: Weights, before: Weights, moved: np.ndarray):
    """What a shard changed, as rows of _CHANGES: moved rows of the tables, and all others."""
    at = np.concatenate([np.flatnonzero(moved.ravel()), np.arange(2 * ROWS, len(w.rows))])
    for part in np.array_split(at, len(at) // 20_000 + 1):
        own = [np.rint((new.rows[part].astype(float) - old.rows[part]) * UNIT).astype(np.int64) for new, old in ((w, base), (past, before))]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(np.ascontiguousarray(x[:, i])) for x in own for i in range(DIMS)]], names=["row", *_SUMS])


def trained(rows: DataFrame, w: Weights, *, rounds: int = ROUNDS) -> Weights:
    """The weights after rounds over all rows (shard, y, h: the words' crc32), a shard's rows lying together."""
    spark, past = rows.sparkSession, Weights.filled(1e-3)
    rows = rows.select("shard", "y", "h")
    for k in range(rounds):
        shipped = spark.sparkContext.broadcast((w.rows, past.rows))  # the model and its sums of squares: 17 MB

        def over(it, k=k, shipped=shipped):
            base, before = (Weights(x) for x in shipped.value)
            shard, own, sums, moved = None, None, None, None
            for b in sliced(it):
                ids, ys, hs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
                ends = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
                for begin, end in zip([0, *ends], [*ends, len(ids)], strict=True):
                    if begin == end:
                        continue
                    if ids[begin] != shard:
                        if shard is not None:
                            yield from _changes(own, sums, base, before, moved)
                        shard, own, sums, moved = ids[begin], base.copy(), before.copy(), np.zeros((2, ROWS), bool)
                    for i in np.random.default_rng([k, shard]).permutation(end - begin):
                        at = step(own, sums, _places(np.frombuffer(hs[begin + i], np.uint32)), ys[begin + i])
                        for t in range(2):
                            moved[t, at[t]] = True
            if shard is not None:
                yield from _changes(own, sums, base, before, moved)

        added = rows.mapInArrow(trimmed(over), _CHANGES).groupBy("row").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in _SUMS])
        got = added.toArrow()  # the model's rows at most
        at, n = got["row"].to_numpy(), got["n"].to_numpy()[:, None] * UNIT
        w, past = w.copy(), past.copy()
        for x, kind in ((w, "w"), (past, "p")):
            x.rows[at] += np.stack([got[f"{kind}{i}"].to_numpy() for i in range(DIMS)], axis=1) / n
        shipped.unpersist()
    return w


def platt(scored: DataFrame) -> tuple[float, float]:
    """Scale and shift of all rows' logits (raw, y) by Newton's method, with a weak pull towards (1, 0). Sums are decimal, so their order doesn't matter."""
    a = np.array([1.0, 0.0])
    for _ in range(30):
        z = F.greatest(F.least(F.col("raw") * float(a[0]) + float(a[1]), F.lit(30.0)), F.lit(-30.0))
        p = 1 / (1 + F.exp(-z))
        e, v, x = p - F.col("y"), p * (1 - p), F.col("raw")
        sums = [float(s) for s in scored.select(*[F.sum(c.cast("decimal(28,12)")) for c in (x * e, e, x * x * v, x * v, v)]).first()]
        g = np.array(sums[:2]) + 0.1 * (a - [1.0, 0.0])
        h = np.array([[sums[2], sums[3]], [sums[3], sums[4]]]) + 0.1 * np.eye(2)
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a -= move
        if np.abs(move).max() < 1e-7:
            break
    return float(max(a[0], 0.05)), float(a[1])


def lowest(clean: DataFrame, false_positives: float, *by: str) -> DataFrame:
    """by, t: the lowest step of the grid from 0.5 to 0.9 that at most the share false_positives of rows is at or above. clean: by and s (a score)."""
    at = F.greatest(F.least(F.floor(F.col("s") * GRID), F.lit(GRID * 9 // 10)), F.lit(GRID // 2 - 1))
    steps = clean.groupBy(*by, at.alias("b")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by)
    steps = steps.select(*by, "b", F.sum("n").over(own).alias("all"), F.sum("n").over(own.orderBy(F.desc("b"))).alias("above"))
    over = steps.filter(F.col("above") > F.floor(F.col("all") * false_positives))
    return over.groupBy(*by).agg((F.least(F.max("b") + 1, F.lit(GRID * 9 // 10)) / GRID).alias("t"))


def fold(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def labelled(docs: DataFrame, labels: DataFrame, *, shard: int = SHARD, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> DataFrame:
    """Every labelled text that may be learnt from, once: y, lang, aside, shard and h (its words' crc32), a shard's rows together."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key) != 1)).groupBy(F.col(key).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    docs = docs.filter(F.col(key).isNotNull() & (fold(key) != 1))
    n = known.join(docs.select(F.col(key).alias("id")), "id", "left_semi").count()
    rows = docs.select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t")).join(known, "id").groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct("t", "lang")).alias("s"))
    order = F.xxhash64("id")
    rows = rows.select("y", F.col("s.lang").alias("lang"), (F.pmod(order, F.lit(5)) == 4).alias("aside"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-n // shard) or 1)).cast("int").alias("shard"), order.alias("o"), F.col("s.t").alias("t"))

    def over(it):
        for b in sliced(it):
            if b.num_rows:
                h = pa.array([_crcs(words(t)).tobytes() for t in strings(b.column(5))], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], h], names=["y", "lang", "aside", "shard", "o", "h"])

    rows = rows.mapInArrow(trimmed(over), "y int, lang string, aside boolean, shard int, o long, h binary")
    return written(rows.repartition("shard").sortWithinPartitions("shard", "o", "h"), "toxicity-rows").drop("o")


def _holding(rows: DataFrame) -> np.ndarray:
    """Texts of each class that hold a row of a table: tables x classes x ROWS."""

    def over(it):
        n = np.zeros((2, 2, ROWS), np.int64)
        for b in sliced(it):
            for y, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t, x in enumerate(_places(np.frombuffer(h, np.uint32))):
                    n[t, y, np.unique(x)] += 1
        at = np.flatnonzero(n.ravel())
        for part in np.array_split(at, len(at) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n.ravel()[part])], names=["at", "n"])

    got = rows.select("y", "h").mapInArrow(trimmed(over), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # the tables' rows at most
    n = np.zeros(4 * ROWS)
    n[got["at"].to_numpy()] = got["n"].to_numpy()
    return n.reshape(2, 2, ROWS)


def fit(docs: DataFrame, labels: DataFrame, *, shard: int = SHARD, false_positives: float = 0.002, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Model:
    """The model fitted on all labels whose crc32(doc_id) mod 3 isn't 1."""
    rows = labelled(docs, labels, shard=shard, key=key, text=text, lang=lang, label=label)
    sizes = {(r["y"], r["aside"]): r["count"] for r in rows.groupBy("y", "aside").count().collect()}  # four rows
    if not all(any(sizes.get((y, a)) for a in (True, False)) for y in (0, 1)):
        return Model(np.zeros((2, 1, DIMS)), np.zeros((DIMS, TAPS, FILTERS)), np.zeros((3, FILTERS)), np.zeros(3 * FILTERS), 60.0 if any(y for y, _ in sizes) else -60.0, fitted=False)
    own = rows.filter(~F.col("aside"))
    m = trained(own, begun(_holding(own), np.array([sizes.get((y, False), 0) for y in (0, 1)]))).model()
    held = rows.filter("aside") if all(sizes.get((y, True)) for y in (0, 1)) else rows
    shipped = rows.sparkSession.sparkContext.broadcast(m)

    def over(it):
        for b in sliced(it):
            if b.num_rows:
                raw = [_raw(shipped.value, _places(np.frombuffer(h, np.uint32))) for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.float64())], names=["y", "lang", "raw"])

    scored = written(held.select("y", "lang", "h").mapInArrow(trimmed(over), "y int, lang string, raw double"), "toxicity-held")
    shipped.unpersist()
    m.scale = platt(scored)
    z = F.greatest(F.least(F.col("raw") * m.scale[0] + m.scale[1], F.lit(60.0)), F.lit(-60.0))
    clean = scored.filter("y = 0").select("lang", (1 / (1 + F.exp(-z))).alias("s"))
    m.threshold = lowest(clean.withColumn("of", F.lit("all")), false_positives, "of").first()["t"]
    many = scored.filter("lang != ''").groupBy("lang").count().filter("count >= 50").select("lang")
    have = many.join(lowest(clean, false_positives, "lang"), "lang", "left").collect()  # a row a language
    m.thresholds = {r["lang"]: 0.7 if r["t"] is None else r["t"] for r in sorted(have, key=lambda r: r["lang"])}
    return m


def _raw(m: Model, x: np.ndarray) -> float:
    n = x.shape[1]
    rows = np.concatenate([np.zeros((2, 1), np.int64), x], axis=1)
    index = np.concatenate([np.arange(1, n + 1), np.zeros(3, np.int64)])
    return float((m.pooled(m.project(rows), index, np.array([0])) @ m.out + m.prior)[0])


def score(docs: DataFrame, m: Model, *, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """key, score, threshold (of the row's language) and rejected for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(m)  # two tables of ROWS x DIMS numbers: 8 MB

    def over(it):
        for b in sliced(it):
            if b.num_rows:
                s, t = _judged(shipped.value, b.column(1), b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(t), pa.array(s >= t)], names=[key, "score", "threshold", "rejected"])

    own = F.col(lang) if lang else F.lit(None)
    rows = docs.select(F.col(key), F.col(text).alias("_t"), own.cast("string").alias("_l"))
    return rows.mapInArrow(trimmed(over), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, threshold double, rejected boolean")


def _judged(m: Model, texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return m.scores(strings(texts)), np.array([m.thresholds.get(x, m.threshold) for x in langs.to_pylist()])


def accepted(docs: DataFrame, m: Model, *, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows of docs, all columns as they are, whose score stays under their language's threshold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(m)
    at, where = docs.columns.index(text), docs.columns.index(lang) if lang in docs.columns else None

    def over(it):
        for b in sliced(it):
            if b.num_rows:
                s, t = _judged(shipped.value, b.column(at), pa.nulls(b.num_rows) if where is None else b.column(where))
                yield b.filter(pa.array(s < t))

    return docs.mapInArrow(trimmed(over), docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    m = fit(docs, labels)
    s = score(docs, m)
    return s.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", "rejected")
