import numpy as np
import pytest
from pyspark.sql import functions as F

from dishscope.functions import colour as C


def lab_of(spark, rgb):
    df = spark.createDataFrame([tuple(map(float, rgb))], "r double, g double, b double")
    return df.select(*C.srgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).first()


@pytest.mark.parametrize(("rgb", "lab"), [((1, 1, 1), (100, 0, 0)), ((0, 0, 0), (0, 0, 0)), ((0.5, 0.5, 0.5), (53.389, 0, 0)), ((1, 0, 0), (53.24, 80.09, 67.20))])
def test_known_colours(spark, rgb, lab):
    assert np.allclose(lab_of(spark, rgb), lab, rtol=1e-3, atol=1e-3)
    assert np.allclose(C.np_lab(np.array(rgb, float)), lab, rtol=1e-3, atol=1e-3)


def test_round_trip(spark):
    rgb = np.random.default_rng(1).uniform(0.02, 0.98, (100, 3))
    assert np.allclose(C.np_srgb(C.np_lab(rgb)), rgb, atol=1e-6)
    df = spark.createDataFrame([tuple(map(float, v)) for v in rgb], "r double, g double, b double")
    back = df.select(*C.lab_to_srgb(*C.srgb_to_lab(F.col("r"), F.col("g"), F.col("b")))).collect()
    assert np.allclose(np.array(back), rgb, atol=1e-6)


def test_chroma_hue_and_difference(spark):
    one = spark.range(1)
    r = one.select(C.chroma(F.lit(0.0), F.lit(10.0)), C.hue(F.lit(0.0), F.lit(10.0)), C.chroma(F.lit(5.0), F.lit(20.0)), C.hue(F.lit(5.0), F.lit(20.0)), C.hue(F.lit(0.0), F.lit(-1.0))).first()
    assert np.allclose(r, (10, 90, 20.61553, 75.96376, 270), atol=1e-4)
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = one.select(C.delta_e(lit(50, 0, 0), lit(53, 4, 0)), C.delta_e(lit(50, 0, 0), lit(52, 1, -1)), *C.lab_to_srgb(*lit(50, 0, 0))).first()
    assert np.allclose(r, (5, 2.44949, 0.4663266, 0.4663266, 0.4663266), atol=1e-5)
