"""Line discovery on a page of boxes: the nearest box on each of four sides, a walk along each line, and lines for what the walks miss.

A page is one row; its boxes are made and walked inside that row, so Spark deals out whole pages and nothing is
shuffled. Work grows with the area of a page's boxes, not with pairs of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.rows import per_text
from ..sources.tables import table
from .raster import _INK, WD, word_runs

LEFT, TOP, RIGHT, BOTTOM = range(4)
_BLANKS = str.maketrans("\t\r\f", "   ")


def _beside(low: np.ndarray, high: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each box the one that follows it directly in a lane (low to high) they share, its gap, the one before and that one's gap: the least gap, then the first lane; -1 and 0 without one."""
    of = np.lexsort((np.arange(len(low)), end, begin))  # boxes as they come in a lane
    n = (high - low + 1)[of]
    first = np.cumsum(n) - n
    i = np.repeat(np.arange(len(of)), n)
    lane = low[of][i] + np.arange(len(i)) - first[i]
    order = np.argsort(lane.astype(np.uint16) if lane.max(initial=0) < 1 << 16 else lane, kind="stable")
    same = np.flatnonzero(lane[order[1:]] == lane[order[:-1]])
    one, other = order[same], order[same + 1]
    gap = np.maximum(begin[of][i[other]] - end[of][i[one]], 0)
    wide = int(lane.max(initial=0)) + 1
    out = []
    for at, to in ((one, other), (other, one)):
        least = np.full(len(i), np.iinfo(np.int64).max)  # a box's lanes lie together
        least[at] = gap * wide + lane[at]
        found, near, gaps = np.zeros(len(of), np.int64), np.full(len(of), -1), np.zeros(len(of), np.int64)
        if len(i):
            found = np.minimum.reduceat(least, first)
        has = found < np.iinfo(np.int64).max
        who = np.full(len(i), -1)
        who[at] = i[to]
        near[of[has]], gaps[of[has]] = of[who[first[has] + found[has] % wide - low[of][has]]], found[has] // wide
        out += [near, gaps]
    return tuple(out)


def four_nearest(box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For boxes (rows of l, t, r, b; ends included) the nearest box to the left, above, to the right and below (-1 without one), and its gap.

    A neighbour follows directly in a row (or column) that both cover, however far away; equal gaps go to the first such row
    (column). Gaps are clamped at 0.
    """
    l, t, r, b = box.T  # noqa: E741
    near, gaps = np.full((len(box), 4), -1), np.zeros((len(box), 4), np.int64)
    for lanes, before, behind in (((t, b, l, r), LEFT, RIGHT), ((l, r, t, b), TOP, BOTTOM)):
        near[:, behind], gaps[:, behind], near[:, before], gaps[:, before] = _beside(*lanes)
    return near, gaps


def outermost(near: np.ndarray) -> np.ndarray:
    """Where following these neighbours ends (a box of a circle where they run in one), by pointer jumping."""
    at = np.where(near >= 0, near, np.arange(len(near)))
    for _ in range(max(1, len(near)).bit_length()):
        at = at[at]
    return at


def page_lines(box: np.ndarray) -> np.ndarray:
    """The line (from 0, as found) of each box of a page.

    The first line begins at the far left of the highest box (equal ones: the leftmost). A walk to the right takes in each
    box on its way that has no line yet, and what is below it but has the same far left; the line's frame grows with
    them. Of the other boxes below, the highest whose far left begins no line yet is where the next walk begins. Boxes inside a line's
    frame belong to it. A box that no walk met goes to the line of the nearest box that has one, followed to the nearer side
    first (equal gaps: left), then to the other; without one it opens a new line.
    """
    n = len(box)
    line = np.full(n, -1)
    if not n:
        return line
    near, gaps = four_nearest(box)
    far = outermost(near[:, LEFT]).tolist()
    left, right, below_of = (near[:, k].tolist() for k in (LEFT, RIGHT, BOTTOM))
    to_left, to_right = (gaps[:, k].tolist() for k in (LEFT, RIGHT))
    l, t, r, b = (x.tolist() for x in box.T)  # noqa: E741
    down = np.argsort(box[:, 1], kind="stable")
    tops = box[down, 1]
    place = (box[:, 1] * (int(box[:, 0].max()) + 1) + box[:, 0]).tolist()  # from the top, then from the left
    start: int | None = min(range(n), key=place.__getitem__)
    begun: set[int] = set()
    own, met = line.tolist(), line.tolist()
    lines = 0
    while start is not None:
        at = head = far[start]
        begun.add(head)
        walked = []
        while at >= 0 and met[at] != lines:
            met[at] = lines
            walked.append(at)
            at = right[at]
        below = [k for k in map(below_of.__getitem__, walked) if k >= 0]
        walked += [k for k in below if far[k] == head]
        for k in walked:
            if own[k] < 0:
                own[k] = lines
        x, y, z, w = (f(map(v.__getitem__, walked)) for f, v in ((min, l), (min, t), (max, r), (max, b)))
        # boxes whose top is in the frame's rows
        for k in down[np.searchsorted(tops, y) : np.searchsorted(tops, w, "right")].tolist():
            if own[k] < 0 and l[k] >= x and r[k] <= z and b[k] <= w:
                own[k] = lines
        lines += 1
        below = [k for k in below if own[k] < 0 and far[k] not in begun]
        start = min(below, key=place.__getitem__) if below else None
    for k in range(n):
        if own[k] >= 0:
            continue
        sides = [left, right] if left[k] >= 0 and (right[k] < 0 or to_left[k] <= to_right[k]) else [right, left]
        for side in sides:
            at, seen = side[k], set()
            while at >= 0 and own[at] < 0 and at not in seen:
                seen.add(at)
                at = side[at]
            if at >= 0 and own[at] >= 0:
                own[k] = own[at]
                break
        if own[k] < 0:
            own[k] = lines
            lines += 1
    return np.array(own)


def word_boxes(text: str) -> np.ndarray:
    """The boxes of a text's words on its raster."""
    line, _, l, r = word_runs(text)  # noqa: E741
    return np.stack([l, line, r, line], axis=1)


def _frames(box: np.ndarray, line: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The frame of each line, in order of their numbers."""
    if not len(box):
        return []
    at = np.argsort(line, kind="stable")
    cut = np.flatnonzero(np.diff(line[at], prepend=-1))
    return list(zip(*(np.minimum.reduceat(box[at, k], cut).tolist() for k in (0, 1)), *(np.maximum.reduceat(box[at, k], cut).tolist() for k in (2, 3)), strict=True))


def found_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and, for each line found on a page, its frame l, t, r, b and its number of boxes."""

    def made(t: str) -> tuple:
        box = word_boxes(t)
        line = page_lines(box)
        return (*([f[k] for f in _frames(box, line)] for k in range(4)), np.bincount(line) if len(box) else [])

    kinds = [(c, "int", pa.int32()) for c in ("l", "t", "r", "b")] + [("n", "long", pa.int64())]
    return per_text(docs, key, text, kinds, made)


def cut_image(rows: list[str], frame: tuple[int, int, int, int]) -> tuple[str, str]:
    """(image, truth) of a frame l, t, r, b of a page: its pixels, # for ink and . for none, a row a line, and the symbols there.

    Words that go on beyond the frame's sides are another label's: they are dropped from both.
    """
    l, t, r, b = frame  # noqa: E741
    image, truth = [], []
    for row in rows[t : b + 1]:
        x = row[l : r + 1]
        if l and (m := _INK.match(x)) and _INK.match(row, l - 1):
            x = " " * m.end() + x[m.end() :]
        if _INK.match(row, r + 1):
            kept = len(x.rstrip(" \t\r\f"))
            if kept == len(x) and kept:
                kept = max(x.rfind(c) for c in " \t\r\f") + 1
            x = x[:kept]
        x = x.translate(_BLANKS).ljust(r - l + 1)
        truth.append(x)
        image.append(np.where(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) == 32, np.uint8(46), np.uint8(35)).tobytes().decode())
    return "\n".join(image), "\n".join(truth)


def line_images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, l, t, r, b, image and truth of each line found on a page: training data of lines. A page's rows are cut once for all of them."""

    def made(t: str) -> tuple:
        box = word_boxes(t)
        rows, line = t.split("\n"), page_lines(box)
        frames = _frames(box, line)
        cut = [cut_image(rows, f) for f in frames]
        return (*([f[k] for f in frames] for k in range(4)), [c[0] for c in cut], [c[1] for c in cut])

    return per_text(docs, key, text, [(c, "int", pa.int32()) for c in ("l", "t", "r", "b")] + [("image", "string", pa.string()), ("truth", "string", pa.string())], made)


def side_gaps(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and how many of a page's words have a nearest box on each side, with the summed gaps above and below."""

    def made(t: str) -> tuple:
        near, gaps = four_nearest(word_boxes(t))
        has = near >= 0
        return tuple([int(x)] for x in (len(near), *has.sum(0), gaps[has[:, TOP], TOP].sum(), gaps[has[:, BOTTOM], BOTTOM].sum()))

    return per_text(docs, key, text, [(c, "long", pa.int64()) for c in ("n", "to_left", "above", "to_right", "below", "gap_above", "gap_below")], made)


_docs = lambda s, d: table(s, d, "documents")

QUERIES = {
    "page_lines": (lambda s, d: found_lines(_docs(s, d)), f"WITH {WD} SELECT doc_id, min(l)::INT AS l, line AS t, max(r)::INT AS r, line AS b, count(*)::BIGINT AS n FROM wd GROUP BY doc_id, line"),
    "line_images": (
        lambda s, d: line_images(_docs(s, d)),
        f"""WITH {WD}, f AS (SELECT doc_id, line, min(l) AS l, max(r) AS r FROM wd GROUP BY ALL), x AS (SELECT f.*, substr(l1.l, f.l::INT + 1, (f.r - f.l + 1)::INT) AS s FROM f JOIN l1 ON l1.doc_id = f.doc_id AND l1.r = f.line)
      SELECT doc_id, l::INT AS l, line AS t, r::INT AS r, line AS b, regexp_replace(regexp_replace(s, '[^ \t\r\f]', '#', 'g'), '[ \t\r\f]', '.', 'g') AS image, regexp_replace(s, '[ \t\r\f]', ' ', 'g') AS truth FROM x""",
    ),
    "four_nearest": (
        lambda s, d: side_gaps(_docs(s, d)),
        f"""WITH {WD}, c AS (SELECT doc_id, line, word, unnest(range(l, r + 1)) AS c FROM wd),
      k AS (SELECT *, line - lag(line) OVER v AS up, lead(line) OVER v - line AS down FROM c WINDOW v AS (PARTITION BY doc_id, c ORDER BY line)),
      v AS (SELECT doc_id, line, word, min(up) AS up, min(down) AS down FROM k GROUP BY ALL),
      h AS (SELECT doc_id, line, word, lag(word) OVER w AS a, lead(word) OVER w AS z FROM wd WINDOW w AS (PARTITION BY doc_id, line ORDER BY word))
      SELECT doc_id, count(*)::BIGINT AS n, count(a)::BIGINT AS to_left, count(up)::BIGINT AS above, count(z)::BIGINT AS to_right, count(down)::BIGINT AS below, coalesce(sum(up), 0)::BIGINT AS gap_above, coalesce(sum(down), 0)::BIGINT AS gap_below
      FROM v JOIN h USING (doc_id, line, word) GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 0, 0 FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM wd)""",
    ),
}
