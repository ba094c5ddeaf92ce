"""Numpy kernels over one tile's maps: components, morphology, gradients and the watershed."""

from __future__ import annotations

import heapq

import numpy as np

#: Opening element, as rows: an ellipse in 5 x 5 (fixed values).
ELLIPSE = np.array([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]], bool)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of the regions joined by edges, numbered from 1 in the order of their first pixel; 0 elsewhere.

    Roots hook onto the smaller of two neighbours, then paths are halved, until no edge joins two roots.
    """
    h, w = mask.shape
    place = np.arange(h * w).reshape(h, w)
    across, down = mask[:, 1:] & mask[:, :-1], mask[1:] & mask[:-1]
    a = np.concatenate([place[:, :-1][across], place[:-1][down]])
    b = np.concatenate([place[:, 1:][across], place[1:][down]])
    root = np.arange(h * w)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    held = mask.ravel()
    out = np.zeros(h * w, np.int64)
    out[held] = np.unique(root[held], return_inverse=True)[1] + 1
    return out.reshape(h, w)


def drop_small(labels: np.ndarray, least: int) -> np.ndarray:
    """Labels of fewer than ``least`` pixels become 0; the others keep theirs."""
    size = np.bincount(labels.ravel())
    return np.where(size[labels] >= least, labels, 0)


def renumber(labels: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... in their order, without gaps."""
    held = np.unique(labels[labels > 0])
    return np.where(labels > 0, np.searchsorted(held, labels) + 1, 0)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """``mask`` and the background that no path along edges joins to the outside."""
    outside = components(np.pad(~mask, 1, constant_values=True))
    return ~(outside == 1)[1:-1, 1:-1]


def opened(mask: np.ndarray, element: np.ndarray = ELLIPSE) -> np.ndarray:
    """Erosion, to which places outside don't count, then dilation."""
    r, c = element.shape[0] // 2, element.shape[1] // 2
    h, w = mask.shape
    offsets = list(zip(*np.nonzero(element)))
    padded = np.pad(mask, ((r, r), (c, c)), constant_values=True)
    eroded = np.logical_and.reduce([padded[i : i + h, j : j + w] for i, j in offsets])
    padded = np.pad(eroded, ((r, r), (c, c)))
    return np.logical_or.reduce([padded[2 * r - i : 2 * r - i + h, 2 * c - j : 2 * c - j + w] for i, j in offsets])


def derivative_kernels(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The smoothed first difference of ``size`` (odd) entries and the binomial that smooths across."""
    smooth = np.ones(1)
    for _ in range(size - 2):
        smooth = np.convolve(smooth, [1.0, 1.0])
    return np.convolve(smooth, [-1.0, 1.0]), np.convolve(smooth, [1.0, 1.0])


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along an axis; the image goes on mirrored about its outermost pixels."""
    reach = len(kernel) // 2
    n = image.shape[axis]
    place = np.abs(np.arange(-reach, n + reach)) % max(2 * n - 2, 1)
    padded = np.take(image, np.minimum(place, 2 * n - 2 - place) if n > 1 else np.zeros_like(place), axis)
    return sum(k * np.take(padded, np.arange(i, i + n), axis) for i, k in enumerate(kernel))


def gradient(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    """The derivative along ``axis``, smoothed along both."""
    difference, smooth = derivative_kernels(size)
    return _along(_along(image, difference, axis), smooth, 1 - axis)


def to_unit(image: np.ndarray) -> np.ndarray:
    """Shifted and scaled to reach from 0 to 1; 0 where all values are equal."""
    low, high = image.min(), image.max()
    return (image - low) / (high - low) if high > low else np.zeros_like(image)


def watershed(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Regions that grow from the markers over the mask along edges, lowest pixels first.

    Of pixels of one height the one reached first grows first (markers before
    all, in raster order); neighbours are reached up, left, right and down.
    """
    h, w = height.shape
    value = np.pad(height, 1).ravel()
    value_of = value.tolist()
    label = np.pad(np.where(mask, markers, 0), 1).ravel().tolist()
    free = (np.pad(mask, 1).ravel() & (np.array(label) == 0)).tolist()
    queue = [(value_of[i], 0, i) for i in np.flatnonzero(label).tolist()]
    heapq.heapify(queue)
    steps, age = (-(w + 2), -1, 1, w + 2), 0
    while queue:
        _, _, i = heapq.heappop(queue)
        for s in steps:
            j = i + s
            if free[j]:
                free[j] = False
                label[j] = label[i]
                age += 1
                heapq.heappush(queue, (value_of[j], age, j))
    return np.array(label, np.int64).reshape(h + 2, w + 2)[1:-1, 1:-1]


def separate(prob: np.ndarray, across: np.ndarray, down: np.ndarray, least: int = 10, size: int = 21, threshold: float = 0.5, rim: float = 0.4) -> np.ndarray:
    """The instance map of one tile: 0 for the background, instances from 1.

    ``prob`` is the foreground's probability; ``across`` and ``down`` are the
    signed distances to the instance's centre, which jump where two meet: their
    steep places are rims, what they leave of the foreground are the markers.
    """
    body = drop_small(components(prob >= threshold), least) > 0
    steep = np.maximum(1 - to_unit(gradient(to_unit(across), size, 1)), 1 - to_unit(gradient(to_unit(down), size, 0)))
    steep = np.maximum(steep - ~body, 0.0)
    blur = np.array([0.25, 0.5, 0.25])
    height = -_along(_along((1 - steep) * body, blur, 0), blur, 1)
    markers = opened(fill_holes(body & ~(steep >= rim)))
    markers = drop_small(components(markers), least)
    return renumber(watershed(height, markers, body))
