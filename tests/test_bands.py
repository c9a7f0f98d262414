"""Kernels over bands of rows against the kernels on the whole plane."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishscope.operators import bands, grid, kernels


def plane_rows(spark, m, name="m"):
    return spark.createDataFrame([(int(y), int(x), bool(m[y, x])) for y in range(m.shape[0]) for x in range(m.shape[1])], f"y int, x int, {name} boolean")


def to_plane(df, shape, name):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r[name]
    return out


def masks():
    rng = np.random.default_rng(3)
    sparse = rng.random((23, 9)) > 0.02
    sparse[4:20] = True  # several bands without a false pixel
    return [rng.random((23, 9)) > 0.3, sparse, np.ones((11, 5), bool), np.zeros((7, 4), bool)]


@pytest.mark.parametrize("k", range(4))
def test_edt(spark, k):
    m = masks()[k]
    assert np.array_equal(to_plane(bands.edt(plane_rows(spark, m), [], "m", rows=4), m.shape, "dist"), kernels.edt(m))
    assert np.array_equal(to_plane(bands.edt(plane_rows(spark, m), [], "m", rim=True, rows=4), m.shape, "dist"), kernels.edt(np.pad(m, 1))[1:-1, 1:-1])


def test_edt_pairs_no_pixels(spark):
    """the rows' pixels are not paired with one another."""
    plan = grid.edt(plane_rows(spark, masks()[0]), [], "m")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "transform(" not in plan


@pytest.mark.parametrize("k", range(4))
def test_components(spark, k):
    m = masks()[k] if k else np.random.default_rng(8).random((41, 9)) > 0.45
    for c in (4, 8):
        got = to_plane(bands.label_components(plane_rows(spark, m), [], "m", c, rows=3), m.shape, "label")
        assert np.array_equal(got, kernels.components(m, c))
    whole, _ = bands.components(plane_rows(spark, m), [], "m", rows=3)
    lab = kernels.components(m)
    want = sorted((k, int((lab == k).sum()), int(np.nonzero(lab == k)[1].min()), int(np.nonzero(lab == k)[0].min())) for k in range(1, lab.max() + 1))
    assert sorted((r["label"], r["n"], r["x0"], r["y0"]) for r in whole.collect()) == want


def test_components_by_plate(spark):
    a, b = np.random.default_rng(1).random((2, 20, 7)) > 0.5
    df = plane_rows(spark, a).withColumn("p", F.lit("a")).unionByName(plane_rows(spark, b).withColumn("p", F.lit("b")))
    got = bands.label_components(df, ["p"], "m", rows=4)
    for name, m in (("a", a), ("b", b)):
        assert np.array_equal(to_plane(got.filter(F.col("p") == name), m.shape, "label"), kernels.components(m))


@pytest.mark.parametrize("k", range(4))
def test_holes(spark, k):
    m = masks()[k] if k else np.random.default_rng(9).random((37, 11)) > 0.5
    assert np.array_equal(to_plane(bands.fill_holes(plane_rows(spark, m), [], "m", rows=4), m.shape, "filled"), kernels.fill_holes(m))


def test_disks(spark):
    m = np.random.default_rng(4).random((33, 12)) > 0.4
    body = lambda p: {"o": kernels.opened(p["m"], 2), "c": kernels.closed(p["m"], 2)}
    got = {r["y"]: (r["o"], r["c"]) for r in bands.on_margins(plane_rows(spark, m), [], 4, "y int, o long, c long", body, rows=5).collect()}
    o, c = kernels.opened(m, 2).sum(axis=1), kernels.closed(m, 2).sum(axis=1)
    assert got == {y: (o[y], c[y]) for y in range(33)}


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_cores(spark, chunk):
    d = np.random.default_rng(6).integers(0, 12, (40, 15)) / 2.0
    df = spark.createDataFrame([(x + 1, y + 1, float(d[y, x])) for y in range(40) for x in range(15)], "x int, y int, depth double")
    assert bands.find_cores(df, 1.0, 20, chunk) == kernels.find_cores(d, np.ones(d.shape, bool), 1.0, 20)


@pytest.mark.parametrize("name", ["reassigned_classes", "label_components", "component_filters", "core_candidates", "dish_places", "disk_morphology", "distance_in_box", "distance_kernel", "filled_holes"])
def test_no_plane_in_one_task(spark, name):
    """F10, F14 to F21: the picture is not gathered into one group."""
    from dishscope.queries import QUERIES

    assert "_all" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
