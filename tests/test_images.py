"""Functions over stacks of small images against plain loops."""

import numpy as np

from quillframe.functions import images as I


def _stack(n=60, h=7, w=9, share=0.25):
    r = np.random.default_rng(1)
    on = r.random((n, h, w)) < share
    on[0], on[1] = False, True
    return on


def test_distance_transform_against_all_pixels():
    on = _stack(share=0.08)
    y, x = np.mgrid[: on.shape[1], : on.shape[2]]
    for a, d in zip(on, I.distance_transform(on), strict=True):
        at = np.argwhere(a)
        want = np.full(a.shape, np.inf) if not len(at) else np.sqrt(((y[..., None] - at[:, 0]) ** 2 + (x[..., None] - at[:, 1]) ** 2).min(-1))
        assert np.allclose(d, want, equal_nan=True) or (np.isinf(d) & np.isinf(want)).all()


def test_farthest():
    a, b = _stack(), _stack()[::-1]
    d = I.distance_transform(b)
    for share in (1.0, 0.9, 0.3):
        got = I.farthest(a, d, share)
        for k in range(len(a)):
            if not a[k].any():
                assert got[k] == (0.0 if not b[k].any() else np.inf)
            else:
                own = np.sort(d[k][a[k]])
                assert got[k] == own[int(np.ceil(len(own) * share)) - 1]


def test_resize():
    r = np.random.default_rng(2)
    img = r.random((4, 6, 8))
    assert (I.resize(img, 6, 8) == img).all() and np.allclose(I.resize(img, 6, 8, True), img)
    assert (I.resize(img, 12, 16)[:, ::2, ::2] == img).all() and (I.resize(img, 12, 16)[:, 1::2, 1::2] == img).all()
    assert I.resize(img, 3, 5).shape == (4, 3, 5) and np.isin(I.resize(img, 3, 5), img).all()
    flat = I.resize(np.full((1, 5, 5), 3.0), 9, 2, True)
    assert flat.shape == (1, 9, 2) and np.allclose(flat, 3)
    ramp = I.resize(np.arange(8.0).reshape(1, 1, 8), 1, 16, True)[0, 0]
    assert np.allclose(np.diff(ramp)[1:-1], 0.5) and (ramp[0], ramp[-1]) == (0, 7)


def test_erosion():
    on = _stack(share=0.7)
    got = I.erode(on)
    for k in range(len(on)):
        for y in range(on.shape[1]):
            for x in range(on.shape[2]):
                assert got[k, y, x] == on[k, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].all()
    assert (I.erode(on, 1, 1) == on).all()


def test_thinning_keeps_parts_and_ends():
    from quillframe.operators.raster import label

    on = np.zeros((4, 12, 20), bool)
    on[0, 3:8, 2:18] = True  # a bar becomes a line
    on[1, 2:10, 2:6] = on[1, 2:10, 12:17] = True  # two bars stay two
    on[2, 2:10, 2:18] = True
    on[2, 5:7, 7:13] = False  # a ring stays a ring
    got = I.thin(on)
    assert (got <= on).all() and (I.thin(got) == got).all()
    assert [label(x).max() for x in got] == [label(x).max() for x in on] == [1, 2, 1, 0]
    assert got[0].sum() < 20 and got[0].any(0).sum() >= 10
    hole = lambda x: label(np.pad(~x, 1), eight=False).max()
    assert hole(got[2]) == hole(on[2]) == 2
