import numpy as np
from pyspark.sql import functions as F

from dishscope.operators import grid
from dishscope.operators import kernels as K


def flood(mask, connectivity):
    out, n = np.zeros(mask.shape, int), 0
    around = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))[: 4 if connectivity == 4 else 8]
    for x in range(mask.shape[1]):
        for y in range(mask.shape[0]):
            if mask[y, x] and not out[y, x]:
                n += 1
                stack, out[y, x] = [(y, x)], n
                while stack:
                    a, b = stack.pop()
                    for dy, dx in around:
                        v, u = a + dy, b + dx
                        if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not out[v, u]:
                            out[v, u] = n
                            stack.append((v, u))
    return out


def rows(spark, plane, name="v"):
    kind = "boolean" if plane.dtype == bool else "double"
    return spark.createDataFrame([(y, x, plane[y, x].item()) for y in range(plane.shape[0]) for x in range(plane.shape[1])], f"y int, x int, {name} {kind}")


def to_plane(df, shape, name):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r[name]
    return out


def test_distance_is_exact(spark):
    m = np.random.default_rng(0).random((30, 40)) < 0.85
    ys, xs = np.nonzero(~m)
    want = np.array([[np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min()) for x in range(40)] for y in range(30)])
    assert np.abs(K.edt(m) - want).max() < 1e-10
    got = to_plane(grid.edt(rows(spark, m, "m"), [], "m"), m.shape, "dist")
    assert np.abs(got - want).max() < 1e-10
    assert np.isinf(K.edt(np.ones((3, 3), bool))).all()


def test_components_match_a_flood_fill(spark):
    m = np.zeros((5, 5), bool)
    m[0, 0] = m[1, 1] = True
    assert K.components(m, 8).max() == 1 and K.components(m, 4).max() == 2
    rng = np.random.default_rng(1)
    for c in (4, 8):
        for _ in range(10):
            m = rng.random((20, 27)) < 0.5
            assert (K.components(m, c) == flood(m, c)).all()
    got = to_plane(grid.label_components(rows(spark, m, "m"), [], "m"), m.shape, "label")
    assert (got == flood(m, 8)).all()


def test_blurs(spark):
    assert np.allclose(K.box_blur(np.full((20, 30), 3.0), 3), 3)
    x = np.random.default_rng(2).standard_normal((20, 20))
    assert np.isclose(K.box_blur(x, 1, 1)[9, 9], x[8:11, 8:11].mean())
    assert np.allclose(to_plane(grid.gauss_blur(rows(spark, x), [], "v", 2.0), x.shape, "blur"), K.gauss_blur(x, 2.0))
    assert np.allclose(to_plane(grid.local_sd(rows(spark, x), [], "v", 2), x.shape, "sd"), K.local_sd(x, 2))
    w = (x > 0).astype(float)
    got = to_plane(grid.box_mean(rows(spark, x).withColumn("w", (F.col("v") > 0).cast("double")), [], "v", 2, "w"), x.shape, "mean")
    assert np.allclose(got, K.box_mean(x, 2, w), equal_nan=True)


def test_watershed_parts_two_discs():
    y, x = np.mgrid[1:51, 1:81]
    m = ((y - 25) ** 2 + (x - 25) ** 2 <= 225) | ((y - 25) ** 2 + (x - 52) ** 2 <= 225)
    marks = np.zeros(m.shape, int)
    marks[24, 24], marks[24, 51] = 1, 2
    w = K.watershed(-K.edt(m), marks, m)
    assert (w[24, 9:36] == 1).all() and (w[24, 40:66] == 2).all() and (w[m] > 0).all() and (w[~m] == 0).all()


def test_holes_morphology_and_shapes(spark):
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    stop = np.zeros((9, 9), bool)
    stop[4, 4] = True
    assert K.fill_holes(ring)[4, 4] and not K.fill_holes(ring, stop)[4, 4]
    assert K.hull_area(np.array([1, 2, 3, 1, 2, 3]), np.array([1, 1, 1, 2, 2, 2])) == 6
    full = np.ones((4, 5), bool)
    assert np.isclose(K.perimeter(full), 18 * np.pi / 4)
    assert np.isclose(grid.perimeter(rows(spark, full, "m"), [], "m").first()["perimeter_px"], 18 * np.pi / 4)
    assert (K.opened(ring, 0) == ring).all() and K.remove_small(ring, 100).sum() == 0
    x = np.random.default_rng(3)
    assert 2 < K.otsu_threshold(np.concatenate([x.normal(0, 1, 500), x.normal(10, 1, 500)])) < 8


def test_resizes_and_samples(spark):
    x = np.arange(48, dtype=float).reshape(6, 8)
    assert np.allclose(K.resize_area(x[..., None], 0.5)[..., 0], x.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    got = to_plane(grid.area_resize(rows(spark, x), [], ["v"], 0.5), (3, 4), "v")
    assert np.allclose(got, K.resize_area(x[..., None], 0.5)[..., 0])
    near = to_plane(grid.resize_nearest(rows(spark, x), [], 6, 8, 3, 4), (3, 4), "v")
    assert np.allclose(near, K.resize_nearest(x, 3, 4))
    assert np.isclose(K.bilinear(x, np.array([2.5]), np.array([3.25]))[0], x[2, 1] * 0.375 + x[2, 2] * 0.375 + x[3, 1] * 0.125 + x[3, 2] * 0.125)
    assert np.isnan(K.bilinear(x, np.array([0.5]), np.array([1.0]))[0])
    pts = spark.createDataFrame([(2.5, 3.25), (-1.0, 0.0)], "px double, py double")
    v = {r["px"]: r["value"] for r in grid.bilinear(rows(spark, x), [], pts, "v").collect()}
    assert np.isclose(v[2.5], x[3, 2] * 0.375 + x[3, 3] * 0.375 + x[4, 2] * 0.125 + x[4, 3] * 0.125) and v[-1.0] is None


def test_disks_against_distances():
    rng = np.random.default_rng(5)
    for shape in ((30, 41), (1, 9), (12, 1)):
        for p in (0.1, 0.5, 0.9, 1.0, 0.0):
            m = rng.random(shape) < p
            for r in (0.5, 1, 1.5, 2, 3.7, 60):
                assert (K.erode(m, r) == (K.edt(m) > r)).all()
                if m.any():
                    assert (K.dilate(m, r) == (K.edt(~m) <= r)).all()
