"""Instances from the prediction maps of tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import maps


def instances_from_maps(tiles: DataFrame, least: int = 10, size: int = 21, pixels: bool = False) -> DataFrame:
    """patch_row, patch_col, instance, n_pixels, rmin, cmin, rmax, cmax, centroid_x, centroid_y, type, share of the instances of every tile.

    ``tiles``: patch_row, patch_col, height, width, and arrays prob, across, down
    and kind (the type of a pixel, 0: background), all in raster order, or only
    at the places of the array ``at`` if there is such a column (0 elsewhere).
    Boxes are tile-local with their greatest ends excluded, as ``instance_records``
    takes them.  The type is the most frequent one, or the next where that is the
    background and there is another (ties: the least), with its share of the
    pixels.  ``pixels`` adds the instance's raster places.  A tile is one row, so
    a task holds one tile's maps at a time and tiles need no shuffle.  Null
    arrays, and arrays of another size than the tile, are errors.
    """
    sparse = "at" in tiles.columns
    names = ["patch_row", "patch_col", "height", "width", *["at"] * sparse, "prob", "across", "down", "kind"]
    schema = "patch_row bigint, patch_col bigint, instance int, n_pixels bigint, rmin bigint, cmin bigint, rmax bigint, cmax bigint, centroid_x double, centroid_y double, type int, share double" + ", pixels array<int>" * pixels
    columns = [f.split()[0] for f in schema.split(", ")]

    def whole(row: dict, name: str, dtype) -> np.ndarray:
        n, values = row["height"] * row["width"], row[name]
        if values is None or len(values) != (len(row["at"]) if sparse else n):
            raise ValueError(f"{name} of tile {row['patch_row']}, {row['patch_col']} hasn't a value per pixel")
        out = np.zeros(n, dtype)
        if sparse:
            out[np.asarray(row["at"], int)] = values
        else:
            out[:] = values
        return out.reshape(row["height"], row["width"])

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                row |= {k: int(row[k]) for k in ("patch_row", "patch_col", "height", "width")}
                if not row["height"] or not row["width"]:
                    continue
                found = maps.separate(*(whole(row, name, float) for name in ("prob", "across", "down")), least, size)
                out = [(row["patch_row"], row["patch_col"], *x) for x in described(found, whole(row, "kind", int), pixels)]
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return tiles.select(*names).mapInPandas(run, schema)


def described(labels: np.ndarray, kinds: np.ndarray, pixels: bool = False):
    """Number, size, box, centroid, type and share of each instance of a map, and its places."""
    flat = labels.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[np.searchsorted(flat[order], 1) :]
    if not len(order):
        return
    ids, first = np.unique(flat[order], return_index=True)
    for number, at in zip(ids.tolist(), np.split(order, first[1:])):
        r, c = np.divmod(at, labels.shape[1])
        values, count = np.unique(kinds.ravel()[at], return_counts=True)
        best = np.argsort(-count, kind="stable")
        pick = best[1] if values[best[0]] == 0 and len(best) > 1 else best[0]
        out = (number, len(at), int(r.min()), int(c.min()), int(r.max()) + 1, int(c.max()) + 1, float(c.mean()), float(r.mean()), int(values[pick]), float(count[pick] / (len(at) + 1e-6)))
        yield (*out, at.astype(np.int32)) if pixels else out
