"""Small images in stacks (n, rows, columns): distance transform, resizing, erosion, thinning. Numpy inside Arrow batches; every function works on a whole stack."""

from __future__ import annotations

import numpy as np


def distance_transform(on: np.ndarray) -> np.ndarray:
    """The Euclidean distance of each pixel to its image's nearest on-pixel; infinite where an image has none.

    Separable: along columns the distance to the nearest on-pixel, then along rows the lower envelope of the
    parabolas (x - x0)^2 + d(x0)^2, of which a row of w pixels has w.
    """
    n, h, w = on.shape
    far = float(h + w)
    d = np.where(on, 0.0, far)
    for y in range(1, h):
        d[:, y] = np.minimum(d[:, y], d[:, y - 1] + 1)
    for y in range(h - 2, -1, -1):
        d[:, y] = np.minimum(d[:, y], d[:, y + 1] + 1)
    square = np.where(d >= far, np.inf, d * d)
    out = np.full_like(square, np.inf)
    x = np.arange(w)
    for x0 in range(w):
        np.minimum(out, square[:, :, x0, None] + (x - x0) ** 2, out=out)
    return np.sqrt(out)


def farthest(on: np.ndarray, to: np.ndarray, share: float = 1.0) -> np.ndarray:
    """For each image of on, the ceil(n * share)-th smallest distance (from a transform) of its n on-pixels; blank images: 0 where `to` is blank too, else infinite."""
    k, flat = len(on), on.reshape(len(on), -1)
    n = flat.sum(1)
    d = np.sort(np.where(flat, to.reshape(k, -1), np.inf), axis=1)  # on-pixels first
    place = np.maximum(np.ceil(n * share).astype(int) - 1, 0)
    out = d[np.arange(k), np.minimum(place, d.shape[1] - 1)]
    return np.where(n > 0, out, np.where(np.isinf(to.reshape(k, -1)).all(1), 0.0, np.inf))


def resize(img: np.ndarray, h: int, w: int, smooth: bool = False) -> np.ndarray:
    """A stack at another size: the nearest pixel's centre (equal distances: the later one), or bilinear between centres, clamped at the edges."""
    ys, xs = ((np.arange(m) + 0.5) * k / m - 0.5 for m, k in ((h, img.shape[1]), (w, img.shape[2])))
    if not smooth:
        at = [np.clip(np.floor(v + 0.5).astype(int), 0, k - 1) for v, k in ((ys, img.shape[1]), (xs, img.shape[2]))]
        return img[:, at[0][:, None], at[1][None]]
    out = img.astype(float)
    for axis, v in ((1, ys), (2, xs)):
        k = out.shape[axis]
        v = np.clip(v, 0, k - 1)
        low = np.floor(v).astype(int)
        part = (v - low).reshape([-1 if a == axis else 1 for a in range(3)])
        out = out.take(low, axis) * (1 - part) + out.take(np.minimum(low + 1, k - 1), axis) * part
    return out


def erode(img: np.ndarray, h: int = 3, w: int = 3) -> np.ndarray:
    """Each pixel's least value in the h x w window around it; windows are cut at the edges."""
    out = img
    for axis, k in ((1, h), (2, w)):
        before, behind = (k - 1) // 2, k // 2
        pad = [(before, behind) if a == axis else (0, 0) for a in range(3)]
        out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, mode="edge"), k, axis=axis).min(axis=-1)
    return out


def thin(on: np.ndarray) -> np.ndarray:
    """Bilevel images thinned until nothing changes: in turn from two sides, on-pixels go whose neighbourhood has 2 to 6 on-pixels, one change from off to on around it, and a blank side (Zhang and Suen)."""
    on = on.astype(bool).copy()
    while True:
        before = on.copy()
        for step in (0, 1):
            p = np.pad(on, ((0, 0), (1, 1), (1, 1)))
            h, w = on.shape[1:]
            ring = [p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            count = sum(r.astype(int) for r in ring)
            turns = sum((~a & b).astype(int) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            up, right, down, left = ring[0], ring[2], ring[4], ring[6]
            sides = ~(up & right & down) & ~(right & down & left) if step == 0 else ~(up & right & left) & ~(up & down & left)
            on &= ~((count >= 2) & (count <= 6) & (turns == 1) & sides)
        if (on == before).all():
            return on
