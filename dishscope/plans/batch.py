"""Batches of plates: one task analyses one photograph, everything after labels is relational."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import background, classify, dish, kernels, measure, segment
from ..operators.layout import Layout, plate_layout
from ..operators.relational import attach_metadata, base_name, first_rows
from ..sources.images import picture_files, prepared, read_images, to_array
from .scratch import cut

#: Everything one plate's task returns, told apart by ``kind``.
ROWS = (
    "plate_id string, kind string, colony_id string, x int, y int, sides int, L double, a double, b double, r double, g double, bl double, depth double, d_bact double, d_any double, sat_id int, "
    "detected boolean, expected_x double, expected_y double, core_depth_mm double, error string, "
    "dish_x double, dish_y double, dish_r double, mm_per_px double, dish_fit_rmse_px double, dish_arc_coverage double, agar_L double, agar_a double, agar_b double, agar_sd_L double, illumination_range_pct double, "
    "overexposed_fraction double, classifier string, target string, target_x double, target_y double, has_bacteria boolean, notes string, qc binary"
)


@dataclass(frozen=True)
class Settings:
    """Parameters of a plate's analysis, with the usual values."""

    dish_diameter_mm: float = 90
    agar_fraction: float = 0.88
    dish: tuple[float, float, float] | None = None
    mm_per_px: float | None = None
    background: str = "auto"
    reference: Any = None
    reference_lab: tuple[float, float, float] = (50, 0, 0)
    max_dim: int = 2000
    flat_field: bool = True
    classifier: classify.Model | None = None
    min_delta_e: float = 3
    min_area_mm2: float = 0.5
    min_core_mm: float = 0.4
    morph_mm: float = 0.08
    edge_criterion: float = 0.5
    edge_exclude_mm: float = 0.1
    dark_l: float | None = None
    n_boot: int = 200
    block_mm: float = 0.5
    ring_width_mm: float = 0.5
    profile_mode: str = "absolute"
    n_rings: int = 10
    qc: bool = False
    seed: int = 1


@dataclass
class Result:
    colonies: DataFrame
    profiles: DataFrame
    plates: DataFrame
    failed: DataFrame
    qc: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    def summary(self) -> str:
        n = self.plates.count()
        found = self.colonies.filter("detected").count()
        return f"{n} plates, {found} of {self.colonies.count()} colonies found, {self.failed.count()} pictures failed"


def analyze_array(picture: np.ndarray, layout: Layout, s: Settings) -> dict:
    """All stages of one plate up to its objects."""
    read = prepared(picture, s.max_dim)
    from ..functions.colour import np_lab

    found = dish.detect(np_lab(read["rgb"]), s.dish, s.dish_diameter_mm, s.agar_fraction, s.background, s.mm_per_px, s.seed)
    bg = background.model(read["rgb"], found, s.flat_field, min_delta_e=s.min_delta_e, reference=s.reference, reference_lab=s.reference_lab)
    cls = classify.classify(bg, found, layout, s.classifier)
    seg = segment.segment(cls, bg, found, layout, s.min_area_mm2, s.min_core_mm, s.morph_mm, edge_criterion=s.edge_criterion)
    if layout.centre == "bacteria" and not seg["bacteria"].any():
        seg["warnings"].append("no bacterium found at the centre")
    return {"read": read, "dish": found, "background": bg, "classes": cls, "objects": seg, "notes": [*bg["warnings"], *cls["warnings"], *seg["warnings"]]}


def _rows(plate_id: str, got: dict, s: Settings):
    """The task's output: one plate row, a row per expected colony, and the pixels of all objects."""
    import pandas as pd

    d, bg, seg = got["dish"], got["background"], got["objects"]
    bact, any_ = seg["bacteria"], seg["bacteria"] | seg["halo"]
    has = bool(bact.any())
    ys, xs = np.nonzero(bact)
    target = ("bacteria", xs.mean() + 1, ys.mean() + 1) if has else ("dish_centre", d["x"], d["y"])
    plate = {
        "kind": "plate", "dish_x": d["x"], "dish_y": d["y"], "dish_r": d["r_outer"], "mm_per_px": d["mm_per_px"], "dish_fit_rmse_px": d["fit_rmse_px"], "dish_arc_coverage": d["arc_coverage"],
        **dict(zip(("agar_L", "agar_a", "agar_b"), map(float, bg["agar_lab"]), strict=True)), "agar_sd_L": float(bg["agar_sd"][0]), "illumination_range_pct": bg["illumination_range_pct"],
        "overexposed_fraction": got["read"]["clipped_fraction"], "classifier": got["classes"]["classifier"], "target": target[0], "target_x": float(target[1]), "target_y": float(target[2]), "has_bacteria": has, "notes": " | ".join(got["notes"]),
    }
    if s.qc:
        from ..sources.render import png, qc_panels

        plate["qc"] = png(qc_panels(bg["rgb"], seg, bg["shadow"]))
    yield pd.DataFrame([{"plate_id": plate_id, **plate}])
    yield pd.DataFrame([{"plate_id": plate_id, "kind": "colony", **{k: r[k] for k in ("colony_id", "detected", "expected_x", "expected_y", "core_depth_mm")}} for r in seg["table"]])
    far_b = kernels.edt(~bact) if has else None
    far_a = kernels.edt(~any_) if has else None
    sat_ids = kernels.components(seg["satellites"])

    def facing(own: np.ndarray) -> np.ndarray:
        """Sides of each pixel that face another label."""
        return sum((own & ~n).astype(np.int8) for n in kernels.neighbours(own))

    def pixels(mask: np.ndarray, kind: str, **more) -> pd.DataFrame:
        y, x = np.nonzero(mask)
        lab, rgb = bg["lab"][y, x], bg["rgb"][y, x]
        return pd.DataFrame({"plate_id": plate_id, "kind": kind, "x": x + 1, "y": y + 1, "L": lab[:, 0], "a": lab[:, 1], "b": lab[:, 2], "r": rgb[:, 0], "g": rgb[:, 1], "bl": rgb[:, 2], **{k: v[y, x] if isinstance(v, np.ndarray) else v for k, v in more.items()}})

    for row in seg["table"]:
        own = seg["labels"] == row["label"]
        if row["detected"]:
            yield pixels(own, "fungus", colony_id=row["colony_id"], depth=kernels.edt_local(own), sides=facing(own), **({"d_bact": far_b, "d_any": far_a} if has else {}))
    for kind in ("bacteria", "halo", "other"):
        yield pixels(seg[kind], kind)
    yield pixels(seg["satellites"], "satellite", sat_id=sat_ids)


def analyze(images: DataFrame, layouts: dict[str, Layout] | Layout | None = None, settings: Settings | None = None) -> Result:
    """Measure decoded images (see ``read_images``); a picture that fails is a row of ``failed`` and stops nothing."""
    s = settings or Settings()
    fallback = layouts if isinstance(layouts, Layout) else plate_layout()
    by_plate = layouts if isinstance(layouts, dict) else {}
    import pandas as pd

    names = [c.split()[0] for c in ROWS.split(", ")]

    def one(row) -> pd.DataFrame:
        plate_id = row["plate_id"]
        try:
            if row["data"] is None:
                raise ValueError("the picture cannot be decoded")
            picture = to_array(int(row["height"]), int(row["width"]), int(row["channels"]), row["data"], int(row["turn"]))
            parts = list(_rows(plate_id, analyze_array(picture, by_plate.get(plate_id, fallback), s), s))
        except Exception as e:  # noqa: BLE001  any failure of a picture belongs to its row
            parts = [pd.DataFrame([{"plate_id": plate_id, "kind": "failed", "error": f"{type(e).__name__}: {e}"}])]
        out = pd.concat([p for p in parts if len(p)], ignore_index=True).reindex(columns=names)
        for c in ("colony_id", "error", "classifier", "target", "notes", "qc"):
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        for c in ("x", "y", "sides", "sat_id"):
            out[c] = out[c].astype("Int32")
        for c in ("detected", "has_bacteria"):
            out[c] = out[c].astype("boolean")
        return out

    def run(batches):
        for pdf in batches:  # a few pictures: a batch is bounded by its bytes
            for row in pdf.to_dict("records"):
                yield one(row)

    # pictures are analysed in the tasks that hold them, without a shuffle
    rows = cut(images.select("plate_id", "height", "width", "channels", "data", "turn").mapInPandas(run, ROWS))
    again = rows.filter("kind = 'plate'").groupBy("plate_id").count().filter("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"several pictures of one plate_id: {', '.join(str(r['plate_id']) for r in again)}")
    return measured(rows, s)


def measured(rows: DataFrame, s: Settings) -> Result:
    """The result tables from the tasks' rows."""
    plates = rows.filter("kind = 'plate'")
    colonies = rows.filter("kind = 'colony'").select("plate_id", "colony_id", "detected", "expected_x", "expected_y")
    fungus = rows.filter("kind = 'fungus'").select("plate_id", "colony_id", "x", "y", "sides", "L", "a", "b", "r", "g", "bl", "depth", "d_bact", "d_any")
    tissue = rows.filter("kind in ('bacteria', 'halo', 'other', 'satellite')").select("plate_id", "kind", "x", "y", "L", "a", "b", "sat_id")
    table = measure.measure_colonies(fungus, plates, colonies, s.edge_exclude_mm, s.dark_l, s.n_boot, s.block_mm, s.seed)
    profiles = measure.colony_profiles(fungus, plates, s.ring_width_mm, s.profile_mode, s.n_rings, s.n_boot, s.block_mm, s.seed)
    warned = plate_warnings(table, plates)
    plates = plates.join(warned, "plate_id", "left").withColumn("warnings", F.coalesce("warnings", F.lit(""))).withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0)))
    return Result(table, profiles, measure.measure_plates(tissue, plates, colonies), rows.filter("kind = 'failed'").select("plate_id", "error"), rows.filter("kind = 'plate'").select("plate_id", "qc") if s.qc else None, s)


def plate_warnings(colonies: DataFrame, plates: DataFrame) -> DataFrame:
    """plate_id, n_warnings, warnings: the six rules of quality control and what the stages noted."""
    per = colonies.groupBy("plate_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("detected"), F.col("colony_id")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("specular_fraction") > 0.02, F.col("colony_id")))).alias("shiny"),
        F.array_sort(F.collect_list(F.when(F.col("offset_from_expected_mm") > 8, F.col("colony_id")))).alias("away"),
    )
    some = lambda c, text: F.when(F.size(c) > 0, F.concat(F.lit(text), F.array_join(c, ", ")))
    p = plates.select("plate_id", "dish_arc_coverage", "illumination_range_pct", "has_bacteria", "notes").join(per, "plate_id", "left")
    rules = F.array_compact(F.array(
        some("missing", "not detected: "),
        F.when(F.col("dish_arc_coverage") < 0.4, F.lit("little of the dish's edge is visible")),
        F.when(F.col("illumination_range_pct") > 30, F.lit("uneven illumination")),
        some("shiny", "specular reflections: "),
        some("away", "far from the expected place: "),
    ))
    all_ = F.concat(F.filter(F.split(F.coalesce("notes", F.lit("")), r" \| "), lambda n: n != ""), rules)
    return p.select("plate_id", F.size(all_).alias("n_warnings"), F.array_join(all_, " | ").alias("warnings"))


def analyze_plates(spark: SparkSession, paths: str | list[str], metadata: DataFrame | None = None, layout: Layout | Callable[[dict | None], Layout] | None = None, settings: Settings | None = None) -> Result:
    """Photographs of a folder or list of files, with metadata columns on every result.

    ``layout`` may be a function of a plate's metadata row; metadata is matched by
    file name, or by plate_id where no file name is given, first row first.
    """
    images, names = read_images(spark, paths), picture_files(spark, paths)
    layouts: dict[str, Layout] | Layout | None = layout if isinstance(layout, Layout) else None
    sheet = sheet_of_plates(names, metadata) if metadata is not None else None
    if callable(layout):
        known = {r["plate_id"]: r.asDict() for r in sheet.collect()} if sheet is not None else {}  # a row a plate
        layouts = {r["plate_id"]: layout(known.get(r["plate_id"])) for r in names.select("plate_id").collect()}
    result = analyze(images, layouts, settings)
    if sheet is not None:
        for name in ("colonies", "profiles", "plates"):
            setattr(result, name, attach_metadata(getattr(result, name), sheet, "plate_id", "_order"))
    if not isinstance(paths, str):  # in the order of the files given
        places = F.broadcast(names.select("plate_id", F.col("place").alias("_place")))  # a row a file of the caller's list
        for name, keys in (("colonies", ["colony_id"]), ("profiles", ["colony_id", "ring"]), ("plates", []), ("failed", [])):
            table = getattr(result, name)
            setattr(result, name, table.join(places, "plate_id", "left").orderBy("_place", "plate_id", *keys).select(*table.columns))
    return result


def sheet_of_plates(names: DataFrame, metadata: DataFrame) -> DataFrame:
    """The metadata row of each plate: by file name, or by plate_id where the row names no file; the first of several."""
    file = base_name(F.col("file")) if "file" in metadata.columns else F.lit(None).cast("string")
    plate = F.col("plate_id").cast("string") if "plate_id" in metadata.columns else F.lit(None).cast("string")
    rows = metadata.select(F.when(file.isNotNull(), F.struct(file.alias("k"), F.lit(0).alias("by"))).otherwise(F.struct(plate.alias("k"), F.lit(1).alias("by"))).alias("_key"), "*")
    rows = rows.withColumn("_order", F.monotonically_increasing_id()).drop("plate_id")
    keys = F.array(F.struct(F.col("file").alias("k"), F.lit(0).alias("by")), F.struct(F.col("stem").alias("k"), F.lit(1).alias("by")))
    asked = names.select("plate_id", F.explode(keys).alias("_key"))
    found = asked.join(rows, "_key").withColumn("_first", F.struct("_key.by", "_order")).drop("_key")
    return first_rows(found, "plate_id", "_first").drop("_first")


def write_result(result: Result, folder: str, mode: str = "errorifexists") -> None:
    """The four tables as CSV folders, missing values blank; pictures for quality control as ``qc/<plate>_qc.png``."""
    for name in ("colonies", "profiles", "plates", "failed"):
        getattr(result, name).write.mode(mode).option("header", True).option("nullValue", "").csv(f"{folder}/{name}")
    if result.qc is not None:
        write_pictures(result.qc, f"{folder}/qc").count()


def write_pictures(qc: DataFrame, folder: str) -> DataFrame:
    """Write each plate's picture as a file; returns the plan of (plate_id, path), which writes as it runs."""
    folder = folder if "://" in folder else "file://" + os.path.abspath(folder)

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            paths = [f"{root}/{re.sub('[^A-Za-z0-9._ -]', '_', p)}_qc.png" for p in pdf["plate_id"]]
            for path, data in zip(paths, pdf["qc"], strict=True):
                with store.open_output_stream(path) as out:
                    out.write(bytes(data))
            yield pdf[["plate_id"]].assign(path=paths)

    return qc.mapInPandas(run, "plate_id string, path string")
