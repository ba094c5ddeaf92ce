"""The tile kernels against pixel-by-pixel definitions, and instances in Spark."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from spotweave.functions import maps
from spotweave.operators import detect, instances

STEPS = ((-1, 0), (0, -1), (0, 1), (1, 0))


def regions(mask):
    """Flood from each pixel not seen yet, in raster order."""
    out, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if not out[r, c]:
            n += 1
            todo = [(r, c)]
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = n
                    todo += [(y + a, x + b) for a, b in STEPS]
    return out


def without_small(labels, least):
    return np.array([[v if v and (labels == v).sum() >= least else 0 for v in row] for row in labels])


def mirrored(i, n):
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i if n > 1 else 0


def correlated(image, kernel):
    h, w = image.shape
    a, b = kernel.shape[0] // 2, kernel.shape[1] // 2
    return np.array([[sum(kernel[i, j] * image[mirrored(r + i - a, h), mirrored(c + j - b, w)] for i in range(kernel.shape[0]) for j in range(kernel.shape[1])) for c in range(w)] for r in range(h)])


def binomial(n):
    row = [1]
    for _ in range(n):
        row = [a + b for a, b in zip([0, *row], [*row, 0])]
    return np.array(row, float)


def flooded(height, markers, mask):
    """Again and again the open pixel of least (height, order of reach, place) grows."""
    out, opened, age = np.where(mask, markers, 0), [], 0
    opened = [(height[r, c], 0, r, c) for r, c in zip(*np.nonzero(out))]
    while opened:
        x = min(opened)
        opened.remove(x)
        for a, b in STEPS:
            r, c = x[2] + a, x[3] + b
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not out[r, c]:
                out[r, c] = out[x[2], x[3]]
                age += 1
                opened.append((height[r, c], age, r, c))
    return out


def scaled(x):
    return (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else x * 0


def defined(prob, across, down, least=10, size=21):
    """The whole of ``separate``, pixel by pixel."""
    h, w = prob.shape
    body = without_small(regions(prob >= 0.5), least) > 0
    d = binomial(size - 2)
    d, s = np.array([a - b for a, b in zip([0, *d], [*d, 0])]), binomial(size - 1)
    steep = np.maximum(1 - scaled(correlated(scaled(across), np.outer(s, d))), 1 - scaled(correlated(scaled(down), np.outer(d, s))))
    steep = np.where(body, steep, np.maximum(steep - 1, 0))
    blur = np.array([1, 2, 1]) / 4
    height = -correlated((1 - steep) * body, np.outer(blur, blur))
    mark = body & ~(steep >= 0.4)
    out = np.pad(regions(np.pad(~mark, 1, constant_values=True)) == 1, 0)[1:-1, 1:-1]
    mark = ~out
    near = [(i - 2, j - 2) for i in range(5) for j in range(5) if maps.ELLIPSE[i, j]]
    inside = lambda r, c: 0 <= r < h and 0 <= c < w
    thin = np.array([[all(mark[r + a, c + b] for a, b in near if inside(r + a, c + b)) for c in range(w)] for r in range(h)])
    mark = np.array([[any(thin[r + a, c + b] for a, b in near if inside(r + a, c + b)) for c in range(w)] for r in range(h)])
    grown = flooded(height, without_small(regions(mark), least), body)
    order = {v: k + 1 for k, v in enumerate(sorted(set(grown[grown > 0].tolist())))}
    return np.array([[order.get(v, 0) for v in row] for row in grown.tolist()])


def discs(seed, h, w, n, radius=5):
    """Maps of overlapping discs: probability, and signed distances to the nearest centre."""
    rng = np.random.default_rng(seed)
    y, x = rng.uniform(0, h, n), rng.uniform(0, w, n)
    r, c = np.mgrid[:h, :w]
    far = np.hypot(r[None] - y[:, None, None], c[None] - x[:, None, None])
    own = far.argmin(0)
    inside = far.min(0) <= radius
    return np.where(inside, 0.9, 0.1) + rng.normal(0, 0.05, (h, w)), np.where(inside, (c - x[own]) / radius, 0), np.where(inside, (r - y[own]) / radius, 0), inside * (own % 3)


@given(st.integers(0, 10**6), st.integers(1, 14), st.integers(1, 14), st.floats(0.2, 0.9))
@settings(max_examples=60, deadline=None)
def test_regions_holes_openings_and_floods(seed, h, w, share):
    rng = np.random.default_rng(seed)
    mask = rng.random((h, w)) < share
    assert (maps.components(mask) == regions(mask)).all()
    assert (maps.drop_small(regions(mask), 3) == without_small(regions(mask), 3)).all()
    outside = regions(np.pad(~mask, 1, constant_values=True)) == 1
    assert (maps.fill_holes(mask) == ~outside[1:-1, 1:-1]).all()
    height = rng.integers(0, 3, (h, w)).astype(float)
    markers = regions(mask & (rng.random((h, w)) < 0.2))
    assert (maps.watershed(height, markers, mask) == flooded(height, markers, mask)).all()


@pytest.mark.parametrize("size", [3, 5, 21])
def test_gradients_match_two_dimensional_correlation(size):
    image = np.random.default_rng(size).normal(size=(9, 13))
    d, s = maps.derivative_kernels(size)
    assert size > 3 or (d.tolist() == [-1, 0, 1] and s.tolist() == [1, 2, 1])
    for axis, kernel in ((1, np.outer(s, d)), (0, np.outer(d, s))):
        want = correlated(image, kernel)
        assert np.allclose(maps.gradient(image, size, axis), want, atol=1e-9 * np.abs(want).max())


@pytest.mark.parametrize("seed,n,size", [(1, 4, 5), (2, 6, 7), (3, 9, 21), (4, 0, 21)])
def test_instance_map_matches_the_definition(seed, n, size):
    maps_of = discs(seed, 26, 30, n) if n else (np.zeros((26, 30)),) * 4
    got = maps.separate(*maps_of[:3], 10, size)
    assert (got == defined(*maps_of[:3], 10, size)).all() and (got.max() > 0) == (n > 0)


def test_touching_discs_are_told_apart():
    r, c = np.mgrid[:40, :60]
    own = np.hypot(r - 20, c - 22) > np.hypot(r - 20, c - 36)
    inside = np.minimum(np.hypot(r - 20, c - 22), np.hypot(r - 20, c - 36)) <= 8.2
    x = np.where(own, 36, 22)
    got = maps.separate(inside * 1.0, np.where(inside, (c - x) / 8, 0), np.where(inside, (r - 20) / 8, 0))
    assert maps.components(inside).max() == 1 and got.max() == 2
    assert ((got > 0) == inside).all() and len(set(got[inside & own].tolist())) == 1


@pytest.mark.parametrize("sparse", [False, True])
def test_instances_in_spark(spark, sparse):
    tiles, want = [], []
    for k, (h, w) in enumerate([(40, 48), (48, 40), (30, 30)]):
        prob, across, down, kind = discs(10 + k, h, w, 7)
        labels = maps.separate(prob, across, down)
        for v in range(1, labels.max() + 1):
            r, c = np.nonzero(labels == v)
            n = sorted(((-(kind[r, c] == t).sum(), t) for t in set(kind[r, c].tolist())))
            pick = n[1] if n[0][1] == 0 and len(n) > 1 else n[0]
            want.append((1, k + 1, v, len(r), r.min(), c.min(), r.max() + 1, c.max() + 1, round(c.mean(), 9), round(r.mean(), 9), pick[1], round(-pick[0] / (len(r) + 1e-6), 9)))
        flat = [[float(v) for v in m.ravel()] for m in (prob, across, down)] + [[int(v) for v in kind.ravel()]]
        if sparse:
            at = [i for i in range(h * w) if any(m[i] for m in flat)]
            flat = [at, *([m[i] for i in at] for m in flat)]
        tiles.append((1, k + 1, h, w, *flat, "x"))
    tiles.append((2, 1, 8, 8, *([[]] * 5 if sparse else [[0.0] * 64] * 3 + [[0] * 64]), None))
    df = spark.createDataFrame(tiles, "patch_row long, patch_col long, height int, width int, " + "at array<int>, " * sparse + "prob array<double>, across array<double>, down array<double>, kind array<int>, instance string")
    out = instances.instances_from_maps(df.repartition(2), pixels=True)
    got = sorted((*r[:8], round(r[8], 9), round(r[9], 9), r[10], round(r[11], 9)) for r in out.collect())
    assert got == sorted(want) and all(len(r["pixels"]) == r["n_pixels"] for r in out.collect())
    boxes = out.withColumnRenamed("instance", "cell_id")
    assert detect.instance_records(boxes, 48, 8).count() == len(want)
    assert instances.instances_from_maps(df.where("false")).collect() == []
