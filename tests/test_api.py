import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave import api
from spotweave.operators import deconv
from spotweave.sources import io
from spotweave.streaming import tiles


def test_registry_and_outside_models():
    assert {"nnls", "dwls", "rctd", "cell2location"} <= set(api.list_available_backends())
    assert api.get_backend_error("nnls") is None and "weights" in api.get_backend_error("cellvit")
    assert "no backend" in api.get_backend_error("tape")


def test_deconvolution_collects_errors_and_weighs_methods(spark):
    counts = spark.createDataFrame([(s, g, float(1 + (s * g) % 5)) for s in range(4) for g in range(6)], "obs long, gene int, value double")
    means = spark.createDataFrame([(t, g, float(1 + (i + 1) * g % 4)) for i, t in enumerate("ab") for g in range(6)], "cell_type string, gene int, mean double")
    out, weights, errors = api.deconv_celltype(counts, means, ["nnls", "dwls", "cellvit"])
    assert set(weights) == {"nnls", "dwls"} and set(errors) == {"cellvit"}
    per = {}
    for r in out.collect():
        per[r["spot_id"]] = per.get(r["spot_id"], 0) + r["value"]
    assert len(per) == 4 and all(abs(v - 1) < 1e-9 or v == 0 for v in per.values())
    with pytest.raises(RuntimeError):
        api.deconv_celltype(counts, means, ["cellvit"])
    alone, _, _ = api.deconv_celltype(counts, means, ["cell2location"])
    assert {r["spot_id"] for r in alone.collect()} == {0, 1, 2, 3} and all(r["value"] >= 0 for r in alone.collect())


def test_methods_run_once_on_the_same_tables_with_a_cache(spark, tmp_path):
    counts = spark.createDataFrame([(s, g, float(1 + (s * g) % 5)) for s in range(4) for g in range(6)], "obs long, gene int, value double")
    means = spark.createDataFrame([(t, g, float(1 + (i + 1) * g % 4)) for i, t in enumerate("ab") for g in range(6)], "cell_type string, gene int, mean double")
    ran = []

    def counted(counts, means):
        ran.append(1)
        return deconv.nnls_deconv(counts, means)

    api.register_backend("counted", counted)
    api.register_backend("broken", lambda counts, means: deconv.nnls_deconv(counts, means).withColumn("value", F.lit(-1.0)))
    try:
        runs = [api.deconv_celltype(c, means, ["counted", "broken"], cache=str(tmp_path))[0] for c in (counts, counts.repartition(3), counts.where("obs < 3"))]
        assert len(ran) == 2 and [r.count() for r in runs] == [8, 8, 6] and runs[0].exceptAll(runs[1]).isEmpty()
        assert io.cache_entries(spark, str(tmp_path)).count() == 2  # what doesn't validate is no entry
    finally:
        for name in ("counted", "broken"):
            api._BACKENDS.pop(name)


def test_cells_are_detected_from_maps_and_points_get_shares(spark):
    r, c = np.mgrid[:64, :64]
    tiles, inside = [], {}
    for col in (1, 2):  # tiles start every 48; one disc lies in the overlap of both, one in each middle
        x0 = (col - 1) * 48
        centres = [(30.0, 28.0), (30.0, 56.0), (30.0, 84.0)]
        far = np.array([np.hypot(r - y, c + x0 - x) for y, x in centres])
        own, near = far.argmin(0), far.min(0) <= 6
        dx, dy = c + x0 - np.array(centres)[own, 1], r - np.array(centres)[own, 0]
        maps = [near * 0.9, np.where(near, dx / 6, 0.0), np.where(near, dy / 6, 0.0)]
        tiles.append((1, col, 64, 64, *[[float(v) for v in m.ravel()] for m in maps], [int(v) for v in near.ravel()]))
    df = spark.createDataFrame(tiles, "patch_row long, patch_col long, height int, width int, prob array<double>, across array<double>, down array<double>, kind array<int>")
    got = sorted((round(x["centroid_x"]), round(x["centroid_y"])) for x in api.detect_cells(df, 64, 16).collect())
    assert got == [(28, 30), (56, 30), (84, 30)]
    features = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(20)], "point_id long, vector array<double>")
    labels = spark.createDataFrame([(i, "ab"[i % 2], 1.0) for i in range(20)], "point_id long, cell_type string, value double")
    out = api.superres_celltype(features, labels, features, hidden=4, epochs=3, rate=0.1)
    assert out.count() == 40


def test_stream_of_tiles(spark, tmp_path):
    rows = [(1, 2, 1, 0, 10, 40, 50, 30.0, 20.0)]
    spark.createDataFrame(rows, tiles.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = tiles.stream_records(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("tiles").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from tiles").first()
    assert (r["rmin"], r["cell_status"], r["edge_position"], r["edge_patches"]) == (192, 1, True, [[1, 1]])
