"""Layout: a text as a page raster, one row per line and one column per symbol, ink where a symbol isn't blank.

Boxes are (l, t, r, b), ends included; distances between boxes are gaps clamped at 0.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import per_text
from ..sources.tables import table

_INK = re.compile("[^ \\t\\r\\f]+")
#: Least and most height and width of a component, and its least and most width over height.
SIZES, RATIOS = (2, 100), (0.1, 10.0)


def pixels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, r, c of ink, from 0."""
    line = docs.select(key, F.posexplode(F.split(text, "\\n")).alias("r", "l"))
    return line.select(key, "r", F.posexplode(T.symbols(F.col("l"))).alias("c", "x")).filter("x rlike '[^ \\\\t\\\\r\\\\f]'").select(key, "r", "c")


def boxes(px: DataFrame, *by: str) -> DataFrame:
    """The bounding box and ink of each label's pixels."""
    return px.groupBy(*by).agg(F.min("c").alias("l"), F.min("r").alias("t"), F.max("c").alias("r"), F.max("r").alias("b"), F.count("*").alias("ink"))


def cropped(px: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """Pixels inside a kept region, each once; pages without a region stay whole. regions: on, l, t, r, b."""
    g = regions.select(*on, F.struct("l", "t", "r", "b").alias("_q"))
    g = g.groupBy(*on).agg(F.collect_list("_q").alias("_q"))  # a page's regions
    x = px.join(g, on, "left")
    inside = F.exists("_q", lambda q: F.col("c").between(q["l"], q["r"]) & F.col("r").between(q["t"], q["b"]))
    return x.filter(F.col("_q").isNull() | inside).drop("_q")


def ink_inside(docs: DataFrame, key: str = "doc_id", text: str = "text", regions: str = "regions") -> DataFrame:
    """key and n, the pixels of pages inside their regions (a list of l, t, r, b beside the text; null: the whole page), each once; pages without any have no row."""

    def over(it):
        for b in it:
            n = [_inside(t or "", q) for t, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n"])

    x = docs.select(key, text, regions).mapInArrow(over, f"`{key}` {docs.schema[key].dataType.simpleString()}, n long")
    return x.filter("n > 0").groupBy(key).agg(F.sum("n").alias("n"))


def _inside(text: str, regions: list[dict] | None) -> int:
    if regions is not None:  # no row below the last region counts
        text = "\n".join(text.split("\n", max((q["b"] + 1 for q in regions), default=0))[: max((q["b"] + 1 for q in regions), default=0)])
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = x == 10
    at = np.flatnonzero(~(end | (x == 32) | (x == 9) | (x == 13) | (x == 12)))
    if regions is None:
        return len(at)
    row = np.cumsum(end)[at]
    c = at - np.concatenate([[0], np.flatnonzero(end) + 1])[row]
    ok = np.zeros(len(at), bool)
    for q in regions:
        ok |= (c >= q["l"]) & (c <= q["r"]) & (row >= q["t"]) & (row <= q["b"])
    return int(ok.sum())


def word_runs(text: str) -> tuple[np.ndarray, ...]:
    """line, word (from 0 along each line), l and r of a text's ink runs, in reading order."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = x == 10
    ink = ~(end | (x == 32) | (x == 9) | (x == 13) | (x == 12))
    step = np.diff(ink.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    starts = np.concatenate([[0], np.flatnonzero(end) + 1])  # of lines
    line = np.searchsorted(starts, first, "right") - 1
    return line, np.arange(len(line)) - np.searchsorted(line, line), first - starts[line], last - starts[line]


def beside(line: np.ndarray, l: np.ndarray, r: np.ndarray, off: int) -> np.ndarray:  # noqa: E741
    """For each run the place of the one that overlaps it most on the line `off` further (equal ones: the first), or -1. Runs are in reading order."""
    wide = int(r.max(initial=0)) + 2
    first = np.searchsorted(line * wide + r, (line + off) * wide + l)
    n = np.maximum(np.searchsorted(line * wide + l, (line + off) * wide + r, "right") - first, 0)
    own = np.repeat(np.arange(len(line)), n)
    other = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full(len(line), -1)
    if len(own):
        over = np.minimum(r[own], r[other]) - np.maximum(l[own], l[other])
        most = np.maximum.reduceat(over, np.flatnonzero(np.diff(own, prepend=-1)))
        best = np.flatnonzero(over == np.repeat(most, n[n > 0]))[::-1]
        out[own[best]] = other[best]  # the first of equals is written last
    return out


def neighbours_by_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`neighbours` of a text's words, inside the text's row."""

    def made(t: str) -> tuple:
        line, word, l, r = word_runs(t)  # noqa: E741
        same = line[1:] == line[:-1]
        gap = np.maximum(l[1:] - r[:-1], 0)
        before, behind = (np.ma.masked_all(len(line), int) for _ in range(2))
        before[1:][same], behind[:-1][same] = gap[same], gap[same]
        over = [np.ma.masked_array(word[at], at < 0) for at in (beside(line, l, r, off) for off in (-1, 1))]
        return line, word, before, behind, *over

    return per_text(docs, key, text, [("line", "int", pa.int32()), ("word", "long", pa.int64()), ("left_gap", "int", pa.int32()), ("right_gap", "int", pa.int32()), ("above", "long", pa.int64()), ("below", "long", pa.int64())], made)


def words(docs: DataFrame, blanks: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word (from 0 along each line) and box: ink runs of a line with fewer than `blanks` blank columns inside."""

    def made(t: str) -> tuple[list, ...]:
        out: tuple[list, ...] = ([], [], [], [])
        for line, x in enumerate(t.split("\n")):
            runs: list[list[int]] = []
            for m in _INK.finditer(x):
                if runs and m.start() - runs[-1][1] <= blanks:
                    runs[-1][1] = m.end() - 1
                else:
                    runs.append([m.start(), m.end() - 1])
            for word, (a, b) in enumerate(runs):
                for c, v in zip(out, (line, word, a, b), strict=True):
                    c.append(v)
        return out

    return per_text(docs, key, text, [("line", "int", pa.int32()), ("word", "long", pa.int64()), ("l", "int", pa.int32()), ("r", "int", pa.int32())], word_runs if blanks <= 1 else made)


def neighbours(w: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each word with its left and right neighbour's gap, and the words that overlap it most on the lines right above and below; ties to the first, null without one."""
    by = Window.partitionBy(key, "line").orderBy("word")
    x = w.withColumn("left_gap", F.when(F.lag("r").over(by).isNotNull(), F.greatest(F.lit(0), F.col("l") - F.lag("r").over(by)))).withColumn("right_gap", F.when(F.lead("l").over(by).isNotNull(), F.greatest(F.lit(0), F.lead("l").over(by) - F.col("r"))))
    for name, off in (("above", -1), ("below", 1)):
        o = w.select(key, (F.col("line") - off).alias("line"), F.col("word").alias("o"), F.col("l").alias("ol"), F.col("r").alias("orr"))
        over = F.least("r", "orr") - F.greatest("l", "ol") + 1
        # overlapping boxes share a block of 16 columns; a pair counts in its first
        cells = F.explode(F.sequence(F.floor(F.col("l") / 16), F.floor(F.col("r") / 16)))
        ocells = F.explode(F.sequence(F.floor(F.col("ol") / 16), F.floor(F.col("orr") / 16)))
        p = w.withColumn("cell", cells).join(o.withColumn("cell", ocells), [key, "line", "cell"]).filter((over > 0) & (F.col("cell") == F.floor(F.greatest("l", "ol") / 16)))
        best = p.groupBy(key, "line", "word").agg(F.max_by("o", F.struct(over, -F.col("o"))).alias(name))
        x = x.join(best, [key, "line", "word"], "left")
    return x.select(key, "line", "word", "left_gap", "right_gap", "above", "below")


def line_properties(px: DataFrame, width: DataFrame, share: float = 0.2, key: str = "doc_id") -> DataFrame:
    """key, baseline (last row with that share of ink, else the last row) and xheight (the most frequent topmost ink row of columns, at or above it; equal counts: the smallest)."""
    rows = px.groupBy(key, "r").agg(F.count("*").alias("ink")).join(width, key)
    base = rows.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("ink") >= share * F.col("w"), F.col("r"))), F.max("r")).alias("baseline"))
    top = px.join(base, key).filter("r <= baseline").groupBy(key, "c").agg(F.min("r").alias("t"))
    mode = top.groupBy(key, "t").agg(F.count("*").alias("n")).groupBy(key).agg(F.min_by("t", F.struct(-F.col("n"), "t")).alias("xheight"))
    return base.join(mode, key, "left").select(key, "baseline", F.coalesce("xheight", "baseline").alias("xheight"))


def label(ink: np.ndarray, eight: bool = True) -> np.ndarray:
    """Component numbers (from 1, by first pixel in reading order) of a bilevel image."""
    at = np.argwhere(ink)
    if not len(at):
        return np.zeros(ink.shape, int)
    place = {(r, c): i for i, (r, c) in enumerate(at.tolist())}
    root = list(range(len(at)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    steps = [(0, -1), (-1, 0)] + ([(-1, -1), (-1, 1)] if eight else [])
    for i, (r, c) in enumerate(at.tolist()):
        for dr, dc in steps:
            j = place.get((r + dr, c + dc))
            if j is not None:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out, number = np.zeros(ink.shape, int), {}
    for i, (r, c) in enumerate(at.tolist()):
        out[r, c] = number.setdefault(find(i), len(number) + 1)
    return out


def _united(one: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the least one that these links join it to."""
    root = np.arange(n)
    while len(one):
        a, b = root[one], root[other]
        apart = a != b
        one, other, a, b = one[apart], other[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def component_boxes(text: str, eight: bool = True) -> tuple[np.ndarray, ...]:
    """l, t, r, b and ink of a text's connected components, by first place: ink runs that touch (with `eight` also by a corner) on neighbouring lines are one."""
    line, _, l, r = word_runs(text)  # noqa: E741
    slack, wide = int(eight), int(r.max(initial=0)) + 3
    first = np.searchsorted(line * wide + r, (line - 1) * wide + l - slack)
    n = np.maximum(np.searchsorted(line * wide + l, (line - 1) * wide + r + slack, "right") - first, 0)
    own = np.repeat(np.arange(len(line)), n)
    root = _united(own, first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n), len(line))
    at = np.argsort(root, kind="stable")
    cut = np.flatnonzero(np.diff(root[at], prepend=-1))
    if not len(cut):
        return l, l, l, l, l
    low, high, sum_ = (f.reduceat for f in (np.minimum, np.maximum, np.add))
    return low(l[at], cut), low(line[at], cut), high(r[at], cut), high(line[at], cut), sum_((r - l + 1)[at], cut)


def runs_components(docs: DataFrame, key: str = "doc_id", text: str = "text", eight: bool = True) -> DataFrame:
    """key, comp (by first place), l, t, r, b, ink and kept (the size and ratio test) of the raster's connected components, inside the text's row."""

    def made(t: str) -> tuple:
        l, top, r, b, ink = component_boxes(t, eight)  # noqa: E741
        h, w = b - top + 1, r - l + 1
        kept = (h >= SIZES[0]) & (h <= SIZES[1]) & (w >= SIZES[0]) & (w <= SIZES[1]) & (w / h >= RATIOS[0]) & (w / h <= RATIOS[1])
        return np.arange(len(l)), l, top, r, b, ink, kept

    return per_text(docs, key, text, [(c, "int", pa.int32()) for c in ("comp", "l", "t", "r", "b", "ink")] + [("kept", "boolean", pa.bool_())], made)


def blocks(px: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, r and line of every row with ink: rows without an empty row between are one line, numbered from 0."""
    by = Window.partitionBy(key).orderBy("r")
    x = px.select(key, "r").distinct().withColumn("new", F.coalesce(F.col("r") - F.lag("r").over(by) > 1, F.lit(False)).cast("int"))
    return x.select(key, "r", F.sum("new").over(by).cast("int").alias("line"))


def absorbed(box: np.ndarray, most: int) -> np.ndarray:
    """For each box (rows of l, t, r, b) of one line, the place of the box it ends in.

    Boxes are walked in order; each that is left takes in the first other one left whose columns
    hold or lie in its own, and whose rows do so too or are within `most` of touching. What was
    taken in widens the box for those walked later.
    """
    # a box takes the wider columns of two, so only those whose columns hold or lie in another's at first can ever meet
    order = np.lexsort((-box[:, 2], box[:, 0]))
    r = box[order, 2]
    held, holds = np.zeros(len(box), bool), np.zeros(len(box), bool)
    held[1:] = r[1:] <= np.maximum.accumulate(r)[:-1]
    holds[:-1] = r[:-1] >= np.minimum.accumulate(r[::-1])[::-1][1:]
    met = np.sort(order[held | holds])
    into = np.arange(len(box))
    into[met] = met[_absorbed(box[met], most)]
    return into


#: Boxes that are looked through one by one before the others are at once.
SPAN = 64


def _absorbed(box: np.ndarray, most: int) -> np.ndarray:
    """`absorbed`, box by box, of those left whose rows are within reach: the ones walked before (`behind`), then the next ones."""
    order = np.argsort(box[:, 1], kind="stable")
    if (np.diff(order) < 0).any():  # not from the top: all are within reach
        reach, beyond = np.full(len(box), np.iinfo(np.int64).min), np.full(len(box), len(box))
    else:
        reach, beyond = box[:, 1] - most, np.searchsorted(box[:, 1], box[:, 3] + most, "right")
    now = box.copy()
    left, top, right, bottom = box.T.tolist()
    into, open_ = list(range(len(box))), np.ones(len(box), bool)
    behind: list[int] = []
    least = None
    for i, (start, end) in enumerate(zip(reach.tolist(), beyond.tolist(), strict=True)):
        if into[i] != i:
            continue
        if start != least:  # the boxes still to be walked begin no higher
            behind, least = [j for j in behind if into[j] == j and bottom[j] >= start], start
        l, t, r, b = left[i], top[i], right[i], bottom[i]  # noqa: E741
        few = [*behind[:SPAN], *range(i + 1, min(i + 1 + SPAN, end))] if len(behind) <= SPAN else behind[:SPAN]
        for j in few:
            if into[j] == j and ((left[j] >= l and right[j] <= r) or (left[j] <= l and right[j] >= r)) and (abs(bottom[j] - t) <= most or abs(top[j] - b) <= most or (top[j] >= t and bottom[j] <= b) or (top[j] <= t and bottom[j] >= b)):
                break
        else:
            j = -1
            for x in (behind[SPAN:], slice(i + 1 + SPAN if len(behind) <= SPAN else i + 1, end)):
                if not (len(x) if isinstance(x, list) else x.start < x.stop):
                    continue
                ll, tt, rr, bb = now[x].T
                ok = open_[x] & (((ll >= l) & (rr <= r)) | ((ll <= l) & (rr >= r))) & ((np.abs(bb - t) <= most) | (np.abs(tt - b) <= most) | ((tt >= t) & (bb <= b)) | ((tt <= t) & (bb >= b)))
                if ok.any():
                    j = x[int(ok.argmax())] if isinstance(x, list) else x.start + int(ok.argmax())
                    break
        if j >= 0:
            left[i], top[i], right[i], bottom[i] = now[i] = min(l, left[j]), min(t, top[j]), max(r, right[j]), max(b, bottom[j])
            into[j], open_[j] = i, False
        behind.append(i)
    out = np.array(into, int)
    while (up := out[out]).tobytes() != out.tobytes():  # what was taken in may have taken others
        out = up
    return out


def diacritics(comps: DataFrame, most: int = 7, key: str = "doc_id") -> DataFrame:
    """Components (key, line, comp, l, t, r, b, ink) with marks above or below joined to their symbol: the absorbing comp's number, the joint box, ink and the parts it has."""

    def over(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("comp", ignore_index=True)
        d["comp"] = d["comp"].to_numpy()[absorbed(d[["l", "t", "r", "b"]].to_numpy(np.int64), most)]
        return d.groupby([key, "line", "comp"], as_index=False).agg(l=("l", "min"), t=("t", "min"), r=("r", "max"), b=("b", "max"), ink=("ink", "sum"), parts=("ink", "size"))

    kept = comps.select(key, "line", "comp", "l", "t", "r", "b", "ink")
    return kept.groupBy(key, "line").applyInPandas(over, f"{key} long, line int, comp int, l int, t int, r int, b int, ink int, parts int")


def diacritics_by_text(docs: DataFrame, most: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`diacritics` of a text's components, inside the text's row; a component's line is the block of rows with ink that its top row is in."""

    def made(t: str) -> tuple:
        box = np.stack(component_boxes(t), axis=1)
        if not len(box):
            return (box[:, 0],) * 8
        rows = np.unique(word_runs(t)[0])
        line = np.cumsum(np.diff(rows, prepend=rows[:1]) > 1)[np.searchsorted(rows, box[:, 1])]
        comp = np.arange(len(box))
        begin = np.flatnonzero(np.diff(line, prepend=-1))  # components are numbered from the top
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(box)], strict=True):
            if b - a > 1:
                comp[a:b] = a + absorbed(box[a:b, :4], most)
        at = np.argsort(comp, kind="stable")
        cut = np.flatnonzero(np.diff(comp[at], prepend=-1))
        low, high = np.minimum.reduceat(box[at], cut), np.maximum.reduceat(box[at], cut)
        return line[at][cut], comp[at][cut], low[:, 0], low[:, 1], high[:, 2], high[:, 3], np.add.reduceat(box[at, 4], cut), np.diff(np.append(cut, len(at)))

    return per_text(docs, key, text, [(c, "int", pa.int32()) for c in ("line", "comp", "l", "t", "r", "b", "ink", "parts")], made)


def subimage(img: np.ndarray, sub: np.ndarray, share: float) -> tuple[int, int, float] | None:
    """The first best place of sub in img by mismatched ink plus mismatched blanks over sub's area, within share."""
    h, w = sub.shape
    best = None
    for r in range(img.shape[0] - h + 1):
        for c in range(img.shape[1] - w + 1):
            x = img[r : r + h, c : c + w]
            s = (abs(float((x * sub).sum() - sub.sum())) + float((x * (1 - sub)).sum())) / sub.size
            if s <= share and (best is None or s < best[2]):
                best = (r, c, s)
    return best


def crop(img: np.ndarray) -> np.ndarray:
    """The image inside its outermost rows and columns with a pixel of 0.5 or more."""
    at = np.argwhere(img >= 0.5)
    return img[at[:, 0].min() : at[:, 0].max() + 1, at[:, 1].min() : at[:, 1].max() + 1] if len(at) else img[:0, :0]


def noise(img: np.ndarray, remove: float, add: float, seed: int) -> np.ndarray:
    """Exactly round(n * share) on-pixels off and off-pixels on, drawn from a seed."""
    r, out = np.random.default_rng(seed), img.copy().ravel()
    on, off = np.flatnonzero(out > 0), np.flatnonzero(out <= 0)
    out[r.choice(on, round(len(on) * remove), replace=False)] = 0
    out[r.choice(off, round(len(off) * add), replace=False)] = 1
    return out.reshape(img.shape)


_docs = lambda s, d: table(s, d, "documents")


def _regions(docs: DataFrame) -> DataFrame:
    """Texts with two rectangles beside those that aren't odd: the first twenty columns of the first lines, and a block further in."""
    q = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("ltrb", x, strict=True))) for x in ((0, 0, 19, 4), (10, 2, 59, 9))))
    return docs.select("doc_id", "text", F.when(F.expr("doc_id % 2 <> 0"), F.lit(None)).otherwise(q).alias("regions"))


def lined(docs: DataFrame) -> DataFrame:
    """Components with the line that their top row is in; no component goes beyond a line's rows."""
    line = blocks(pixels(docs)).select("doc_id", F.col("r").alias("t"), "line")
    return runs_components(docs).join(line, ["doc_id", "t"])


def _width(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.array_max(F.transform(F.split("text", "\\n"), F.length)).alias("w"))


PX = r"l0 AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), l1 AS (SELECT doc_id, unnest(p) AS l, (generate_subscripts(p, 1) - 1)::INT AS r FROM l0), l2 AS (SELECT doc_id, r, unnest(string_split(l, '')) AS x, (generate_subscripts(string_split(l, ''), 1) - 1)::INT AS c FROM l1 WHERE l <> ''), px AS (SELECT doc_id, r, c FROM l2 WHERE regexp_matches(x, '[^ \t\r\f]'))"
WD = PX + ", n0 AS (SELECT *, (c - lag(c) OVER (PARTITION BY doc_id, r ORDER BY c) > 1)::INT AS nw FROM px), n1 AS (SELECT doc_id, r, c, sum(coalesce(nw, 0)) OVER (PARTITION BY doc_id, r ORDER BY c) AS word FROM n0), wd AS (SELECT doc_id, r AS line, word::BIGINT AS word, min(c) AS l, max(c) AS r FROM n1 GROUP BY ALL)"

QUERIES = {
    "bbox": (lambda s, d: boxes(pixels(_docs(s, d)), "doc_id"), f"WITH {PX} SELECT doc_id, min(c) AS l, min(r) AS t, max(c) AS r, max(r) AS b, count(*)::BIGINT AS ink FROM px GROUP BY 1"),
    "region_filter": (lambda s, d: ink_inside(_regions(_docs(s, d))), f"WITH {PX} SELECT doc_id, count(*)::BIGINT AS n FROM px WHERE doc_id % 2 <> 0 OR (c BETWEEN 0 AND 19 AND r BETWEEN 0 AND 4) OR (c BETWEEN 10 AND 59 AND r BETWEEN 2 AND 9) GROUP BY 1"),
    "line_words": (lambda s, d: words(_docs(s, d)), f"WITH {WD} SELECT doc_id, line, word, l, r FROM wd"),
    "nn4": (lambda s, d: neighbours_by_text(_docs(s, d)), f"""WITH {WD}, a AS (SELECT w.doc_id, w.line, w.word, o.word AS o FROM wd w JOIN wd o ON o.doc_id = w.doc_id AND o.line = w.line - 1 AND least(w.r, o.r) >= greatest(w.l, o.l) QUALIFY row_number() OVER (PARTITION BY w.doc_id, w.line, w.word ORDER BY least(w.r, o.r) - greatest(w.l, o.l) DESC, o.word) = 1),
      b AS (SELECT w.doc_id, w.line, w.word, o.word AS o FROM wd w JOIN wd o ON o.doc_id = w.doc_id AND o.line = w.line + 1 AND least(w.r, o.r) >= greatest(w.l, o.l) QUALIFY row_number() OVER (PARTITION BY w.doc_id, w.line, w.word ORDER BY least(w.r, o.r) - greatest(w.l, o.l) DESC, o.word) = 1)
      SELECT doc_id, line, word, greatest(0, l - lag(r) OVER k) * (lag(r) OVER k IS NOT NULL)::INT + CASE WHEN lag(r) OVER k IS NULL THEN NULL ELSE 0 END AS left_gap, lead(l) OVER k - r AS right_gap, a.o AS above, b.o AS below
      FROM wd LEFT JOIN a USING (doc_id, line, word) LEFT JOIN b USING (doc_id, line, word) WINDOW k AS (PARTITION BY doc_id, line ORDER BY word)"""),
    "line_props": (lambda s, d: line_properties(pixels(_docs(s, d)), _width(_docs(s, d))), f"""WITH {PX}, wi AS (SELECT doc_id, max(length(l)) AS w FROM l1 GROUP BY 1), rw AS (SELECT doc_id, r, count(*) AS ink FROM px GROUP BY ALL), ba AS (SELECT doc_id, coalesce(max(r) FILTER (WHERE ink >= 0.2 * w), max(r)) AS baseline FROM rw JOIN wi USING (doc_id) GROUP BY 1),
      tp AS (SELECT doc_id, c, min(r) AS t FROM px JOIN ba USING (doc_id) WHERE r <= baseline GROUP BY ALL), md AS (SELECT doc_id, t FROM (SELECT doc_id, t, count(*) AS n FROM tp GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t) = 1)
      SELECT doc_id, baseline, coalesce(t, baseline) AS xheight FROM ba LEFT JOIN md USING (doc_id)"""),
    "line_blocks": (lambda s, d: blocks(pixels(_docs(s, d))), f"WITH {PX}, ir AS (SELECT DISTINCT doc_id, r FROM px), nr AS (SELECT *, (r - lag(r) OVER (PARTITION BY doc_id ORDER BY r) > 1)::INT AS nw FROM ir) SELECT doc_id, r, (sum(coalesce(nw, 0)) OVER (PARTITION BY doc_id ORDER BY r))::INT AS line FROM nr"),
    "diacritic_merge": (lambda s, d: diacritics_by_text(_docs(s, d)), None),
    "components": (lambda s, d: runs_components(_docs(s, d)), None),
}
