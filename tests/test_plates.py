import numpy as np
import pytest
from pyspark.sql import functions as F

from dishscope.operators import background, classify, dish
from dishscope.operators.layout import plate_layout
from dishscope.plans import batch
from dishscope.sources import images, render
from dishscope.sources.simulate import simulate

SIZE = {"width": 450, "height": 600}


def test_dish_is_found():
    from dishscope.functions.colour import np_lab

    s = simulate(**SIZE)
    d = dish.detect(np_lab(s["image"]))
    t = s["truth"]
    assert np.hypot(d["x"] - t["dish"]["x"], d["y"] - t["dish"]["y"]) < 1.5 and abs(d["mm_per_px"] / t["mm_per_px"] - 1) < 0.005


@pytest.fixture(scope="module")
def result(spark):
    specs = [{"plate_id": "conf", **SIZE}, {"plate_id": "ctrl", "centre": "none", **SIZE}, {"plate_id": "facing", "facing_darkening": 6, **SIZE}, {"plate_id": "missing", "colony_radius_mm": [7, 7, 0.01, 7], **SIZE}]
    data = images.simulated_images(spark, specs)
    bad = data.filter("plate_id = 'conf'").withColumn("plate_id", F.lit("broken")).withColumn("data", F.lit(None).cast("binary"))
    return batch.analyze(data.unionByName(bad), {"ctrl": plate_layout(centre="none")}, batch.Settings(n_boot=40, qc=True))


def test_batch(result):
    t = {r["colony_id"]: r for r in simulate(**SIZE)["truth"]["colonies"]}
    rows = {(r["plate_id"], r["colony_id"]): r for r in result.colonies.collect()}
    assert len(rows) == 16 and [r["plate_id"] for r in result.failed.collect()] == ["broken"]
    for k, truth in t.items():
        r = rows["conf", k]
        assert r["detected"] and abs(r["area_mm2"] / truth["area_mm2"] - 1) < 0.04 and abs(r["MI_mean"] - truth["MI_mean"]) < 1
        assert r["MI_lo"] <= r["MI_mean"] <= r["MI_hi"] and rows["facing", k]["delta_MI_facing"] > 3
        assert rows["ctrl", k]["interaction_target"] == "dish_centre" and rows["ctrl", k]["gap_bacteria_mm"] is None
    order = sorted(t, key=lambda k: t[k]["MI_mean"])
    assert sorted(t, key=lambda k: rows["conf", k]["MI_mean"]) == order
    assert not rows["missing", "BR"]["detected"] and rows["missing", "BR"]["area_mm2"] is None
    plates = {r["plate_id"]: r for r in result.plates.collect()}
    assert plates["conf"]["n_satellites"] == 1 and plates["conf"]["bacteria_area_mm2"] > 0 and plates["conf"]["halo_area_mm2"] > 0
    assert plates["ctrl"]["bacteria_area_mm2"] == 0 and "BR" in plates["missing"]["warnings"]
    assert (len(result.colonies.columns), len(result.profiles.columns), len(result.plates.columns)) == (43, 14, 28)
    rings = {r["ring"]: r["MI_mean"] for r in result.profiles.filter("plate_id = 'conf' and colony_id = 'TL'").collect()}
    assert rings[1] < rings[4]
    assert all(bytes(r["qc"]).startswith(b"\x89PNG") for r in result.qc.collect())


def test_supervised_and_calibration():
    from dishscope.functions.colour import np_lab

    s = simulate(exposure=0.7, grey_card=True, **SIZE)
    lab = np_lab(s["image"])
    d = dish.detect(lab)
    raw, cal = background.model(s["image"], d), background.model(s["image"], d, reference=(0.1, 0.92, 0.05))
    own = s["truth"]["labels"] == 1
    want = s["truth"]["colonies"][0]["L_mean"]
    assert abs(raw["lab"][..., 0][own].mean() - want) > 4 and abs(cal["lab"][..., 0][own].mean() - want) < 1
    s = simulate(**SIZE)
    bg = background.model(s["image"], d)
    lay = plate_layout()
    spots = lay.pixels(d)
    regions = [("fungus", spots[0][1], spots[0][2], 10), ("fungus", spots[2][1], spots[2][2], 10), ("bacteria", d["x"], d["y"], 10), ("halo", d["x"] + 60, d["y"], 8)]
    model = classify.train_classifier(classify.training_pixels(bg, regions))
    again = classify.from_json(classify.to_json(model))
    assert set(again) == {"fungus", "bacteria", "halo"} and "fungus" in classify.summary(again)
    got = batch.analyze_array(s["image"], lay, batch.Settings(classifier=again))
    assert all(r["detected"] for r in got["objects"]["table"]) and got["classes"]["classifier"] == "supervised"


def test_files(spark, tmp_path):
    x = simulate(width=150, height=200)["image"]
    for name in ("a.png", "b.PNG", "notes.txt"):
        (tmp_path / name).write_bytes(render.png(x))
    rows = {r["plate_id"]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"}
    back = images.to_array(rows["a"]["height"], rows["a"]["width"], rows["a"]["channels"], bytes(rows["a"]["data"]))
    assert np.abs(back - x).max() <= 0.5 / 255 + 1e-9
    px = images.pixel_rows(images.read_images(spark, str(tmp_path / "a.png"))).filter("y = 3 and x = 7").first()
    assert np.allclose((px["r"], px["g"], px["b"]), back[2, 6])
    assert images.prepared(np.full((40, 80), 200.0), max_dim=40)["rgb"].shape == (20, 40, 3)
    tiff = b"\xff\xd8\xff\xe1\x00\x22Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    assert images.orientation(tiff) == 6 and images.upright(np.arange(6).reshape(2, 3, 1), 6)[..., 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    assert render.melanin_ramp(100).shape == (100, 3)
    s = simulate(width=150, height=200)
    m = render.melanization_map(np.stack([np.full((200, 150), 40.0)] * 3, axis=-1), s["truth"]["labels"], 0.5)
    assert m["mi_range"][0] <= 60 <= m["mi_range"][1] and m["height"].shape[0] <= 200


def test_examples_and_folders(spark, tmp_path):
    from dishscope.operators.layout import layout_by_treatment
    from dishscope.sources.simulate import example_plates
    from dishscope.streaming.watch import watch

    folder, out = tmp_path / "pictures", tmp_path / "out"
    folder.mkdir()
    paths = example_plates(str(folder))
    assert len(paths) == 2 and images.is_images(images.read_images(spark, paths)) and not images.is_images(3)
    sheet = spark.createDataFrame([("confrontation.png", "bacteria"), ("control.png", "control")], "file string, treatment string")
    r = batch.analyze_plates(spark, str(folder), sheet, layout_by_treatment, batch.Settings(n_boot=20))
    rows = r.colonies.collect()
    assert len(rows) == 8 and {x["plate_id"]: x["treatment"] for x in rows} == {"confrontation": "bacteria", "control": "control"} and r.failed.count() == 0
    batch.write_result(r, str(out))
    assert spark.read.option("header", True).csv(str(out / "plates")).count() == 2
    seen = []
    q = watch(spark, str(folder), str(tmp_path / "state"), lambda result, n: seen.append(result.plates.count()), settings=batch.Settings(n_boot=0))
    q.awaitTermination()
    assert seen == [2]
    marks = classify.annotated([("fungus", 3, 4)], 0.1)
    assert marks == [("fungus", 3.0, 4.0, 5.0)]


def test_two_files_of_one_stem(spark, tmp_path):
    from dishscope.operators.relational import METADATA  # noqa: F401  the sheet below has its columns

    folder = tmp_path / "clash"
    (folder / "more").mkdir(parents=True)
    x = render.png(simulate(width=150, height=200)["image"])
    for name in ("a.png", "a.PNG", "b.png", "more/b.png"):
        (folder / name).write_bytes(x)
    (folder / "bad.png").write_bytes(b"not a picture")
    rows = {r["plate_id"]: r["data"] for r in images.read_images(spark, str(folder)).collect()}
    assert set(rows) == {"a.png", "a.PNG", "b", "bad"} and rows["bad"] is None and rows["a.PNG"] is not None
    paths = [str(folder / n) for n in ("more/b.png", "bad.png", "b.png", "a.PNG", "a.png")]
    sheet = spark.createDataFrame([("a.png", None, "control"), ("a.PNG", None, "bacteria"), ("a.PNG", None, "second"), (None, "bad", "none")], "file string, plate_id string, treatment string")
    names = images.picture_files(spark, paths)
    assert len({r["plate_id"] for r in names.collect()}) == 5
    assert {r["plate_id"]: r["treatment"] for r in batch.sheet_of_plates(names, sheet).collect()} == {"a.png": "control", "a.PNG": "bacteria", "bad": "none"}
    r = batch.analyze_plates(spark, paths, sheet, settings=batch.Settings(n_boot=0, qc=True))
    assert [p["plate_id"].rsplit("/", 2)[-2:] for p in r.plates.collect()] == [["more", "b.png"], ["clash", "b.png"], ["a.PNG"], ["a.png"]]
    assert [f["plate_id"] for f in r.failed.collect()] == ["bad"]
    batch.write_result(r, str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "qc").glob("*_qc.png"))) == 4
    with pytest.raises(ValueError, match="several pictures"):
        batch.analyze(images.read_images(spark, str(folder)).withColumn("plate_id", F.lit("same")), settings=batch.Settings(n_boot=0))


def test_objects_of_a_plate():
    from dishscope.operators import segment

    s = simulate(**SIZE)
    got = batch.analyze_array(s["image"], plate_layout(), batch.Settings(edge_criterion=0))
    kept = batch.analyze_array(s["image"], plate_layout(), batch.Settings())
    off, on = (np.bincount(g["objects"]["labels"].ravel(), minlength=5)[1:] for g in (got, kept))
    assert (off >= on).all() and (off > on).any()
    # without the step, labels are the flooded fungus itself
    fungus = got["objects"]["map"] == segment.FUNGUS
    assert ((got["objects"]["labels"] > 0) & ~fungus).mean() < 0.002
    layout = plate_layout(centre="fungus")
    middle = np.array(s["image"])
    y, x = np.mgrid[: middle.shape[0], : middle.shape[1]]
    t, px = s["truth"], s["truth"]["mm_per_px"]
    d = t["dish"]
    plain = simulate(layout=plate_layout(centre="none"), **SIZE)["image"]
    middle = np.where((np.hypot(x + 1 - d["x"], y + 1 - d["y"]) <= 6 / px)[..., None], np.array([0.35, 0.28, 0.2]), plain)
    rows = {r["colony_id"]: r for r in batch.analyze_array(middle, layout, batch.Settings())["objects"]["table"]}
    assert set(rows) == {"TL", "TR", "BR", "BL", "centre"} and rows["centre"]["detected"]


def test_margins_of_the_bacterium_have_no_holes():
    from dishscope.operators import segment

    bact, loose = np.zeros((60, 60), bool), np.zeros((60, 60), bool)
    bact[20:40, 20:40] = True
    loose[20:40, 41:50] = True
    loose[25:35, 43:47] = False
    loose[2:5, 2:5] = True
    rim = np.zeros((60, 60), bool)
    rim[50:] = True
    loose[48:55, 5:9] = True
    margin, satellites = segment.sort_fragments(loose, bact, rim)
    assert margin[20:40, 41:43].all() and not margin[:10].any() and satellites.sum() == 9


def test_cores_on_shoulders():
    from dishscope.operators import kernels as K

    depth = np.zeros((9, 60))
    depth[4] = np.concatenate([np.linspace(1, 20, 30), np.linspace(20, 12, 30)])  # no second peak, but deep far from the first
    mask = depth > 0
    got = K.find_cores(depth, mask, 2.0)
    assert got[0][:2] == (30.0, 5.0) and len(got) == 1 or got[1][2] < got[0][2]
    wide = np.zeros((5, 200))
    wide[2] = np.linspace(10, 5, 200)
    assert len(K.find_cores(wide, wide > 0, 2.0)) > 5


def test_pictures_of_results():
    s = simulate(width=150, height=200)
    got = batch.analyze_array(s["image"], plate_layout(), batch.Settings())
    args = got["background"]["rgb"], got["objects"], got["background"]["shadow"]
    assert render.qc_panels(*args).shape == (212, 300, 3) and render.qc_panels(*args, panels=("classes",), legend=False).shape == (200, 150, 3)
    with pytest.raises(ValueError):
        render.qc_panels(*args, panels=("nothing",))
    assert render.show_rgb(s["image"], 100).shape == (100, 75, 3)
    m = render.melanization_map(got["background"]["lab"], got["objects"]["labels"], got["dish"]["mm_per_px"])
    flat, relief = render.flat_map(m), render.relief_map(m)
    assert flat.shape[0] == 200 and relief.ndim == 3 and len(np.unique(relief.reshape(-1, 3), axis=0)) > 20
    assert "150 x 200" in images.describe(s["image"], "p", got["dish"])
