import math

import pytest
from pyspark.sql import functions as F

from dishscope.operators import bootstrap, layout, relational, stats


def test_facing_bias(spark):
    rows = [("c", p, "control", v) for p, v in zip(("TL", "TR", "TL", "TR"), (4.0, -8.0, 5.0, -7.0), strict=True)]
    rows += [("b", p, "bacteria", v) for p, v in zip(("TL", "TR", "TL", "TR"), (9.0, -2.0, 10.0, -3.0), strict=True)]
    df = spark.createDataFrame(rows, "plate_id string, colony_id string, treatment string, delta_MI_facing double")
    got = sorted(r["delta_MI_facing_corrected"] for r in relational.correct_facing_bias(df).collect())
    assert got == sorted([-0.5, -0.5, 0.5, 0.5, 4.5, 5.5, 5.5, 4.5])
    with pytest.raises(ValueError):
        relational.correct_facing_bias(df, control="none")


def test_layout():
    spots = {n: (round(u, 3), round(v, 3)) for n, u, v in layout.plate_layout().positions}
    assert spots == {"TL": (-0.318, -0.318), "TR": (0.318, -0.318), "BR": (0.318, 0.318), "BL": (-0.318, 0.318)}
    three = [(round(u, 3), round(v, 3)) for _, u, v in layout.plate_layout(3, ids=["A", "B", "C"]).positions]
    assert three == [(-0.318, -0.318), (0.435, -0.116), (-0.116, 0.435)]
    assert layout.layout_by_treatment({"treatment": "Ctrl"}).centre == "none"
    assert layout.layout_by_treatment(None).centre == "none"
    assert layout.layout_by_treatment({"treatment": "bacteria"}).centre == "bacteria"


def test_metadata(spark, tmp_path):
    files = spark.createDataFrame([("/d/bact_01.jpg",), ("/d/ctrl_01.jpg",), ("/d/ctrl_02.JPG",)], "path string")
    sheet = relational.metadata_sheet(files, patterns={"bacteria": "bact", "control": "CTRL"}, extra={"day": 3})
    assert [r["treatment"] for r in sheet.orderBy("file").collect()] == ["bacteria", "control", "control"]
    relational.write_metadata(sheet, str(tmp_path / "m"))
    with pytest.raises(Exception):  # noqa: B017
        relational.write_metadata(sheet, str(tmp_path / "m"))
    back = relational.read_metadata(spark, str(tmp_path / "m"))
    assert back.count() == 3 and dict(back.dtypes)["day"] == "int" and back.filter("notes is null").count() == 3
    results = spark.createDataFrame([("bact_01", 1), ("other", 2)], "plate_id string, x int")
    twice = back.unionByName(back).withColumn("_o", F.monotonically_increasing_id())
    out = relational.attach_metadata(results, twice, "plate_id", "_o")
    assert {r["plate_id"]: r["treatment"] for r in out.collect()} == {"bact_01": "bacteria", "other": None} and out.count() == 2


def test_union_fill(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2, 0.5)], "i int, d double")
    out = relational.union_fill(a, None, b)
    assert out.columns == ["i", "s", "d"] and out.filter("s is null").count() == 1


def test_comparisons(spark):
    import random

    random.seed(1)
    rows = []
    for k in range(12):
        off = random.gauss(0, 1)
        for j in range(4):
            g = "bacteria" if k % 2 else "control"
            rows.append((f"p{k}", g, f"c{j}", 50 + off + (4 if g == "bacteria" else 0) + random.gauss(0, 0.9)))
    df = spark.createDataFrame(rows, "plate_id string, treatment string, colony_id string, MI_mean double")
    mixed = stats.compare(df, reference="control")
    means = stats.compare(df, reference="control", method="means")
    m, w = mixed.coefficients[0], means.coefficients[0]
    assert m["term"] == "bacteria" and m["ci_lo"] < 4 < m["ci_hi"]
    assert math.isclose(m["estimate"], w["estimate"], abs_tol=1e-6) and mixed.icc > 0.3
    # balanced design: the standard error from the plates' means
    by = df.groupBy("treatment", "plate_id").agg(F.avg("MI_mean").alias("m")).groupBy("treatment").agg(F.var_samp("m").alias("v")).collect()
    assert math.isclose(m["se"], math.sqrt(sum(r["v"] for r in by) / 6), rel_tol=1e-4)
    assert math.isclose(stats.t_tail(2.228138852, 10), 0.05, rel_tol=1e-6) and math.isclose(stats.f_tail(4.964602744, 1, 10), 0.05, rel_tol=1e-6)
    more = df.unionByName(df.withColumn("treatment", F.lit("third")).withColumn("plate_id", F.concat(F.lit("x"), "plate_id")).filter("plate_id in ('xp1', 'xp2')"))
    assert stats.compare(more, method="means").method == "anova"


def test_bootstrap(spark):
    df = spark.range(600).select(F.lit("k").alias("k"), (F.col("id") % 30).alias("b"), ((F.col("id") * 7919) % 100).cast("double").alias("v"))
    r = bootstrap.block_bootstrap(df, ["k"], "b", "v").first()
    assert r["lo"] < 49.5 < r["hi"]
    assert r == bootstrap.block_bootstrap(df, ["k"], "b", "v").first()
    assert bootstrap.block_bootstrap(df.filter("b < 2"), ["k"], "b", "v").count() == 0


@pytest.mark.parametrize("many", [1_000, 10])
def test_resamples(spark, monkeypatch, many):
    """F8, F9, F12: a group's draws are those of ``draw``, whether one task or several make them; no row a draw is made."""
    import numpy as np

    monkeypatch.setattr(bootstrap, "MANY", many)
    monkeypatch.setattr(bootstrap.Hashes, "PIECE", 7)
    df = spark.range(900).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 31 % 40).alias("b"), ((F.col("id") * 7919) % 101).cast("double").alias("v")).filter("k <> '2' or b < 29")
    out = bootstrap.block_bootstrap(df, ["k"], "b", "v", 25, 0.8, 4)
    assert "_rep" not in out._jdf.queryExecution().toString()
    got = {r["k"]: (r["lo"], r["hi"]) for r in out.collect()}
    draws = spark.range(40).select("id", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("r"))
    for k in "012":
        sums = [tuple(r) for r in df.filter(F.col("k") == k).groupBy("b").agg(F.sum("v"), F.count("v")).orderBy("b").select("sum(v)", "count(v)").collect()]
        n = len(sums)
        means = [[0.0, 0] for _ in range(25)]
        for r in draws.filter(F.col("id") < n).select("r", bootstrap.draw(4, F.lit(n), F.col("r"), F.col("id")).alias("i")).collect():
            means[r["r"]][0] += sums[r["i"]][0]
            means[r["r"]][1] += sums[r["i"]][1]
        assert np.allclose(got[k], np.quantile([s / c for s, c in means], [0.1, 0.9]))
