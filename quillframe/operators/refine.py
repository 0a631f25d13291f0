"""Refinement of clusters and boxes: merging broken symbols, splitting, line assignment, and distances of images of unequal sizes."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import per_text
from ..sources.tables import regions, table
from .components import components
from .decode import solve_line
from .raster import WD, crop, word_runs, words
from .reports import side_by_side
from .vectors import EVERY, ROOTS, SIDE, blocks, coded, images, label_means, listed, matrix, parted, strips


def merge_rounds(text: str, least: int = 3, share: float = 0.85) -> list[list[str]]:
    """The text's lines as lists of clusters' names after merging.

    The largest cluster (equal sizes: the least name) of at least `least` members whose modal left
    neighbour, another cluster, precedes `least` of them and `share` of both clusters' members is
    joined with it, member by member, under both names; members without that partner stay as they are.
    Repeated until no cluster qualifies. Blanks are gaps, not members, and nothing merges across one.
    """
    lines = [[list(w) for w in line.split()] for line in text.split("\n")]
    while True:
        size: Counter = Counter()
        pairs: Counter = Counter()
        for line in lines:
            for w in line:
                size.update(w)
                pairs.update(zip(w, w[1:], strict=False))
        left: dict[str, tuple[int, str]] = {}
        for (a, b), f in pairs.items():
            if a != b and (b not in left or (-f, a) < left[b]):
                left[b] = (-f, a)
        fit = [(-size[b], b, a) for b, (f, a) in left.items() if -f >= least and -f >= share * size[a] and -f >= share * size[b]]
        if not fit:
            return [[c for w in line for c in w] for line in lines]
        _, b, a = min(fit)
        for line in lines:
            for k, w in enumerate(line):
                if b in w:
                    out: list[str] = []
                    for c in w:
                        if c == b and out and out[-1] == a:
                            out[-1] = a + b
                        else:
                            out.append(c)
                    line[k] = out


def _merged(text: str) -> tuple[list, ...]:
    n = Counter(c for line in merge_rounds(text) for c in line)
    names = sorted(n, key=lambda c: (-n[c], c))
    return list(range(1, len(names) + 1)), names, [n[c] for c in names]


def merged_clusters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, clust (1 the largest; equal sizes by name), name and n of each text's clusters after merging, inside the text's row."""
    return per_text(docs, key, text, [("clust", "int", pa.int32()), ("name", "string", pa.string()), ("n", "long", pa.int64())], _merged)


def truth_conflicts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, pos, c, left of components whose truth differs from their left neighbour's."""
    return components(docs, key, text).filter("c <> left").select(key, "line", "pos", "c", "left")


def split_boxes(boxes: DataFrame, at: int) -> DataFrame:
    """Boxes wider than `at` columns in two at that column: part 0 and 1, with the distances 1 between them; other boxes whole."""
    cut = F.col("r") - F.col("l") + 1 > at
    none = F.lit(None).cast("int")
    part = lambda k, l, r, lg, rg: F.struct(F.lit(k).alias("part"), l.alias("l"), r.alias("r"), lg.alias("left_gap"), rg.alias("right_gap"))  # noqa: E731, E741
    one = F.lit(1)
    halves = F.array(part(0, F.col("l"), F.col("l") + at - 1, none, one), part(1, F.col("l") + at, F.col("r"), one, none))
    whole = F.array(part(0, F.col("l"), F.col("r"), none, none))
    return boxes.select("doc_id", "line", "word", F.explode(F.when(cut, halves).otherwise(whole)).alias("p")).select("doc_id", "line", "word", "p.*")


def nearest_assigned(boxes: DataFrame, wide: int) -> DataFrame:
    """boxes with owner: the box itself where it's at least `wide`; else the nearest such box on its line (equal gaps: the left one), or itself where the line has none."""
    w = Window.partitionBy("doc_id", "line").orderBy("word")
    own = F.when(F.col("r") - F.col("l") + 1 >= wide, F.struct("word", "l", "r"))
    x = boxes.withColumn("own", own)
    x = x.withColumn("before", F.last("own", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("behind", F.first("own", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    far = F.lit(1 << 30)
    before, behind = F.coalesce(F.col("l") - F.col("before.r"), far), F.coalesce(F.col("behind.l") - F.col("r"), far)
    near = F.when(before <= behind, F.col("before.word")).otherwise(F.col("behind.word"))
    return x.select("doc_id", "line", "word", F.when(F.col("own").isNotNull(), F.col("word")).otherwise(F.coalesce(near, F.col("word"))).alias("owner"))


def assigned_by_text(docs: DataFrame, wide: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`nearest_assigned` of a text's words, inside the text's row."""

    def made(t: str) -> tuple:
        line, word, l, r = word_runs(t)  # noqa: E741
        at, n = np.arange(len(line)), len(line)
        own = r - l + 1 >= wide
        before = np.maximum.accumulate(np.where(own, at, -1))
        behind = np.minimum.accumulate(np.where(own, at, n)[::-1])[::-1]
        has = (before >= 0) & (line[before] == line), (behind < n) & (line[np.minimum(behind, n - 1)] == line)
        behind = np.minimum(behind, n - 1)
        far = 1 << 30
        gaps = np.where(has[0], l - r[before], far), np.where(has[1], l[behind] - r, far)
        near = np.where(has[0] & (gaps[0] <= gaps[1]), before, np.where(has[1], behind, at))
        return line, word, word[np.where(own, at, near)]

    return per_text(docs, key, text, [("line", "int", pa.int32()), ("word", "long", pa.int64()), ("owner", "long", pa.int64())], made)


def tight_boxes(img: DataFrame, on: float, side: int = SIDE) -> DataFrame:
    """id and the box l, t, r, b of pixels of at least `on`, for images that have one."""
    at = F.expr(f"filter(sequence(0, size(v) - 1), i -> v[i] >= {float(on)!r}D)")
    x = img.select("id", at.alias("at")).filter(F.size("at") > 0)
    col, row = F.transform("at", lambda i: i % side), F.transform("at", lambda i: F.floor(i / side).cast("int"))
    return x.select("id", F.array_min(col).alias("l"), F.array_min(row).alias("t"), F.array_max(col).alias("r"), F.array_max(row).alias("b"))


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """The row and column of b at which a's first pixel lies, and their overlap (the sum of products) there, for the overlap nearest to a's sum; ties by column, then row."""
    h, w = a.shape
    space = np.pad(b, ((h - 1, h - 1), (w - 1, w - 1)))
    overlap = np.einsum("rcij,ij->rc", np.lib.stride_tricks.sliding_window_view(space, (h, w)), a)
    c, r = np.unravel_index(np.argmin(np.round(np.abs(overlap - a.sum()), 12).T), overlap.T.shape)
    return int(r) - h + 1, int(c) - w + 1, float(overlap[r, c])


def conv_euclid(a: np.ndarray, b: np.ndarray) -> float:
    """Root of the squared distance over the smaller area; images of unequal sizes are aligned first."""
    if not a.size or not b.size:
        return 0.0 if a.size == b.size else float("inf")
    dot = float((a * b).sum()) if a.shape == b.shape else aligned(a, b)[2]
    return float(np.sqrt(max(0.0, (a * a).sum() + (b * b).sum() - 2 * dot)) / min(a.size, b.size))


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])


def soft_hausdorff(a: np.ndarray, b: np.ndarray, share: float = 1.0, mean: bool = False) -> float:
    """The ceil(n * share)-th smallest distance of on-pixels to the other aligned image's, as the larger (or the mean) of both directions; blank with blank 0, else infinite."""
    if not a.any() or not b.any():
        return 0.0 if not a.any() and not b.any() else float("inf")
    r, c, _ = aligned(a.astype(float), b.astype(float))
    d = _apart(np.argwhere(a) + (r, c), np.argwhere(b))
    both = [np.sort(x)[int(np.ceil(len(x) * share)) - 1] for x in (d.min(1), d.min(0))]
    return float(np.mean(both) if mean else max(both))


def sub_hausdorff(sub: np.ndarray, img: np.ndarray, most: float = 1.0) -> list[tuple[int, int, float]]:
    """Row, column and distance of every place of sub inside img where neither's on-pixels there lie farther than `most` from the other's; a place without ink is infinitely far."""
    h, w = sub.shape
    s, i = np.argwhere(sub), np.argwhere(img)
    if not len(s) or not len(i):
        return []
    out = []
    for r in range(img.shape[0] - h + 1):
        for c in range(img.shape[1] - w + 1):
            here = i[(i >= (r, c)).all(1) & (i < (r + h, c + w)).all(1)]
            if len(here):
                d = max(_apart(s + (r, c), i).min(1).max(), _apart(here, s + (r, c)).min(1).max())
                if d <= most:
                    out.append((r, c, float(d)))
    return out


def _distinct(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The first rows of a matrix's distinct rows, and each row's place among them."""
    known: dict[bytes, int] = {}
    place = np.array([known.setdefault(r.tobytes(), len(known)) for r in x], np.int64)
    first = dict(zip(place[::-1].tolist(), range(len(x) - 1, -1, -1), strict=True))
    return [first[k] for k in range(len(known))], place


def cropped_search(img: DataFrame, kernel, on: float, side: int = SIDE) -> DataFrame:
    """q_id, id and d: the kernel over each query (ids that EVERY divides) and every other image, off under `on` and cropped to their ink. Equal cropped images are taken once a block."""

    def cuts(x: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        v = matrix(x.column("v"))[0].reshape(-1, side, side)
        v = np.where(v >= on, v, 0.0)
        made = [crop(y) for y in v]
        ink = np.array([bool(y.size) for y in made], bool)
        first, place = _distinct(np.where(ink[:, None, None], v, 0.0).reshape(len(v), side * side))  # without ink all are alike
        return [made[k] for k in first], place

    def made(a: pa.Table, b: pa.Table) -> pa.Table:
        (own, place), (q_own, q_place) = cuts(a), cuts(b)
        d = np.round(np.array([[kernel(y, x) for x in own] for y in q_own]).reshape(len(q_own), len(own)), 9)
        return listed([parted(*x) for x in strips(a, b, lambda first, behind: d[q_place[first:behind]][:, place])])

    return blocks(img, img.filter(F.col("id") % EVERY == 0), ["v"], made, "q_id long, id long, d double")


def sub_search(img: DataFrame, on: float, window: int, most: float, side: int = SIDE) -> DataFrame:
    """q_id, id, r, c and d: where the first window x window pixels of a query (ids that EVERY divides) match a place of another image, by `sub_hausdorff`; all places of a block of pairs at once."""
    columns = ["q_id", "id", "r", "c", "d"]

    def made(a: pa.Table, b: pa.Table) -> pa.Table:
        image, sub = (matrix(x.column("v"))[0].reshape(-1, side, side) >= on for x in (a, b))
        sub = np.ascontiguousarray(sub[:, :window, :window])
        dt, sub_dt = (np.ascontiguousarray(coded(x).T) for x in (image, sub))
        mask, sub_mask = (np.ascontiguousarray(np.where(x.reshape(len(x), x.shape[1] * x.shape[2]), 255, 0).astype(np.uint8).T) for x in (image, sub))
        ids, q_ids, out = a.column("id").to_numpy(), b.column("id").to_numpy(), []
        pixels = range(window * window)
        for q_id, own, d in strips(a, b, lambda first, behind: (first, behind)):
            first, behind = d
            far, part = np.empty((behind - first, len(own)), np.uint8), np.empty((behind - first, len(own)), np.uint8)
            other = q_id[:, None] != own[None]
            for r in range(side - window + 1):
                for c in range(side - window + 1):
                    at = [(r + k // window) * side + c + k % window for k in pixels]
                    here = mask[at].any(axis=0)
                    far[:] = 0
                    for k, p in zip(pixels, at, strict=True):
                        for x, y in ((sub_mask, dt), (sub_dt, mask)):
                            np.bitwise_and(x[k, first:behind, None], y[p][None], out=part)
                            np.maximum(far, part, out=far)
                    q, i = np.nonzero((ROOTS[far] <= most) & here[None] & other & sub_mask[:, first:behind].any(axis=0)[:, None])
                    out.append((q_id[q], own[i], np.full(len(q), r, np.int32), np.full(len(q), c, np.int32), np.round(ROOTS[far[q, i]], 9)))
        if not out:
            out = [(ids[:0], q_ids[:0], np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))]
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=columns)

    return blocks(img, img.filter(F.col("id") % EVERY == 0), ["v"], made, "q_id long, id long, r int, c int, d double")


def line_decode(lines: DataFrame, shapes: DataFrame, slack: int = 2) -> DataFrame:
    """grp, path (labels from left to right), widths and cost of lines of images by segmental decoding with a bilevel model of each label.

    shapes holds label, at and mean, a row a pixel of each class; its classes are the model's alphabet and stand in one row.
    """
    model = shapes.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("v"))
    model = model.agg(F.array_sort(F.collect_list(F.struct("label", F.col("v.mean").alias("v")))).alias("models"))
    columns = ["grp", "width", "height", "image"]

    def over(it):
        for b in it:
            out = []
            for g, w, h, image, models in zip(*(b[c] for c in [*columns, "models"]), strict=True):
                made = [(np.asarray(m["v"], float).reshape(h, -1) > 0).astype(float) for m in models]
                even = np.full((len(made), len(made)), 1 / len(made))
                path, widths, cost = solve_line((np.asarray(image, float).reshape(h, w) > 0).astype(float), made, even, most=slack)
                out.append((g, ",".join(str(models[k]["label"]) for k in path), ",".join(map(str, widths)), round(cost, 6)))
            yield pd.DataFrame(out, columns=["grp", "path", "widths", "cost"])

    return lines.select(*columns).crossJoin(F.broadcast(model)).mapInPandas(over, "grp long, path string, widths string, cost double")


_docs = lambda s, d: table(s, d, "documents")
_emb = lambda s, d: table(s, d, "embeddings").filter(f"size(embedding) = {SIDE * SIDE}")
_img = lambda s, d: images(_emb(s, d))
ON = 0.2


def _listed(docs: DataFrame) -> DataFrame:
    """A region file for each text: its lines' places as regions of class text_body or figure."""
    line = F.transform(F.split("text", "\\n"), lambda l, i: F.concat(F.when(i % 3 == 0, F.lit("class = figure")).otherwise(F.lit("class = text_body")), F.lit("\n% a note\npos = 0 "), i.cast("string"), F.lit(" "), F.length(l).cast("string"), F.lit(" "), (i + 1).cast("string")))  # noqa: E741
    return docs.select("doc_id", F.array_join(line, "\n").alias("regions"))


QUERIES = {
    "merge_refine": (lambda s, d: merged_clusters(_docs(s, d)), None),
    "truth_conflicts": (
        lambda s, d: truth_conflicts(_docs(s, d)),
        "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), x AS (SELECT doc_id, line, s, unnest(range(2, len(s) + 1)) AS i FROM (SELECT doc_id, line, string_split(l, '') AS s FROM l WHERE l <> '')) SELECT doc_id, line::INT AS line, (i - 1)::INT AS pos, s[i] AS c, s[i - 1] AS left FROM x WHERE s[i] <> s[i - 1]",
    ),
    "split_boxes": (
        lambda s, d: split_boxes(words(_docs(s, d)), 3),
        f"WITH {WD} SELECT doc_id, line, word, k::INT AS part, (CASE k WHEN 0 THEN l ELSE l + 3 END)::INT AS l, (CASE WHEN k = 0 AND r - l >= 3 THEN l + 2 ELSE r END)::INT AS r, CASE WHEN k = 1 THEN 1 END AS left_gap, CASE WHEN k = 0 AND r - l >= 3 THEN 1 END AS right_gap FROM wd, range(0, 2) t(k) WHERE k = 0 OR r - l >= 3",
    ),
    "nearest_assigned": (
        lambda s, d: assigned_by_text(_docs(s, d), 4),
        f"""WITH {WD}, o AS (SELECT *, CASE WHEN r - l >= 3 THEN word END AS own, CASE WHEN r - l >= 3 THEN l END AS ol, CASE WHEN r - l >= 3 THEN r END AS orr FROM wd),
      n AS (SELECT *, last_value(own IGNORE NULLS) OVER a AS bw, last_value(orr IGNORE NULLS) OVER a AS br, first_value(own IGNORE NULLS) OVER z AS hw, first_value(ol IGNORE NULLS) OVER z AS hl FROM o
        WINDOW a AS (PARTITION BY doc_id, line ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), z AS (PARTITION BY doc_id, line ORDER BY word ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
      SELECT doc_id, line, word, coalesce(own, CASE WHEN bw IS NULL THEN hw WHEN hw IS NULL OR l - br <= hl - r THEN bw ELSE hw END, word) AS owner FROM n""",
    ),
    "region_scan": (
        lambda s, d: regions(_listed(_docs(s, d)), ["text"], "doc_id", "regions"),
        "WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) SELECT doc_id, i::INT AS region, 'text_body' AS class, 0 AS l, (i - 1)::INT AS t, length(s)::INT AS r, i::INT AS b FROM x WHERE (i - 1) % 3 <> 0",
    ),
    "tight_boxes": (
        lambda s, d: tight_boxes(_img(s, d), ON),
        f"WITH x AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)) SELECT vec_id AS id, min((i - 1) % 8)::INT AS l, min((i - 1) // 8)::INT AS t, max((i - 1) % 8)::INT AS r, max((i - 1) // 8)::INT AS b FROM x WHERE v >= {ON}::DOUBLE GROUP BY 1",
    ),
    "vec_conv_euclid": (lambda s, d: cropped_search(_img(s, d), conv_euclid, ON), None),
    "vec_soft_hausdorff": (lambda s, d: cropped_search(_img(s, d), lambda a, b: soft_hausdorff(a > 0, b > 0, 0.9), ON), None),
    "line_decode": (lambda s, d: line_decode(side_by_side(_emb(s, d), F.floor(F.col("vec_id") / 4), "vec_id", "embedding", SIDE, SIDE), label_means(_img(s, d))), None),
    "vec_sub_hausdorff": (lambda s, d: sub_search(_img(s, d), ON, 4, 1.0), None),
}
