"""Plate photographs as rows, and pixel tables."""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.colour import CLIPPED
from ..operators.kernels import resize_area
from ..operators.relational import IMAGE_NAME, base_name, stem


def orientation(content: bytes) -> int:
    """The EXIF orientation of a JPEG, 1 where there is none."""
    if not content or content[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if kind == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            t = content[at + 10 : at + 2 + size]
            order = "<" if t[:2] == b"II" else ">"
            try:
                ifd = struct.unpack(order + "I", t[4:8])[0]
                for k in range(struct.unpack(order + "H", t[ifd : ifd + 2])[0]):
                    tag, _, _, value = struct.unpack(order + "HHIH", t[ifd + 2 + 12 * k : ifd + 12 + 12 * k])
                    if tag == 0x0112:
                        return value if 1 <= value <= 8 else 1
            except struct.error:
                return 1
            return 1
        if kind == 0xDA:
            break
        at += 2 + size
    return 1


def _orientations(heads):
    import pandas as pd

    return pd.Series([orientation(bytes(h)) if h is not None else 1 for h in heads], dtype="int32")


def upright(picture: np.ndarray, turn: int) -> np.ndarray:
    """The picture as its EXIF orientation wants it shown."""
    if turn in (5, 6, 7, 8):
        picture = picture.transpose(1, 0, 2)
    if turn in (2, 3, 6, 7):
        picture = picture[:, ::-1]
    if turn in (3, 4, 7, 8):
        picture = picture[::-1]
    return np.ascontiguousarray(picture)


#: Files up to which their names are broadcast to the pictures; beyond that Spark picks the join.
FEW_FILES = 1_000_000


def picture_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, file, stem, plate_id, place of the image files, without their contents.

    The plate's id is the file's stem; files that share a stem have their file name,
    those that share this too their whole path.  ``place`` is the position in a given
    list of files, 0 for all of a folder.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(given).select("path").filter(base_name(F.col("path")).rlike(IMAGE_NAME))
    files = files.select("path", base_name(F.col("path")).alias("file"), stem(F.col("path")).alias("stem"))
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) == 1
    plate_id = F.when(alone("stem"), F.col("stem")).when(alone("file"), F.col("file")).otherwise(F.col("path"))
    files = files.withColumn("plate_id", plate_id)
    if isinstance(paths, str):
        return files.withColumn("place", F.lit(0))
    places = spark.createDataFrame([(_plain(p), k) for k, p in enumerate(given)], "_path string, place int").groupBy("_path").agg(F.min("place").alias("place"))
    # a row for each name the caller gave
    return files.join(F.broadcast(places), _plain(F.col("path")) == F.col("_path"), "left").drop("_path").fillna({"place": len(given)})


def _plain(path):
    """A path without the scheme of local files."""
    if isinstance(path, str):
        return re.sub("^file:/+", "/", path)
    return F.regexp_replace(path, "^file:/+", "/")


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, plate_id, height, width, channels, data (BGR bytes), turn; undecodable files have null data.

    Pictures stay in the tasks that decode them: only names and orientations, a row
    a file, are joined to them.
    """
    files = picture_files(spark, paths)
    jpeg = spark.read.format("binaryFile").load(paths).filter(base_name(F.col("path")).rlike(r"(?i)\.jpe?g$"))
    # the marker segment with the orientation is at the start of a file
    turn = F.pandas_udf(_orientations, "int", F.PandasUDFType.SCALAR)(F.substring(F.col("content"), 1, 65536 * 2))
    names = files.join(jpeg.select("path", turn.alias("turn")), "path", "left").select("path", "plate_id", F.coalesce("turn", F.lit(1)).alias("turn"))
    names = F.broadcast(names) if files.count() <= FEW_FILES else names
    seen = spark.read.format("image").option("dropInvalid", False).load(paths).select("image.*")
    joined = seen.join(names, _plain(F.col("origin")) == _plain(F.col("path")))
    return joined.select("path", "plate_id", "height", "width", F.col("nChannels").alias("channels"), F.when(F.col("height") > 0, F.col("data")).alias("data"), "turn")


def describe(picture: np.ndarray, plate_id: str, dish: dict | None = None) -> str:
    """A picture in one line: its name, size, and what is known of its dish."""
    h, w = picture.shape[:2]
    found = f"dish radius {dish['r_outer']:.1f} px at ({dish['x']:.1f}, {dish['y']:.1f}), {dish['mm_per_px']:.4f} mm/px" if dish else "dish not found yet"
    return f"plate {plate_id}: {w} x {h} px, {found}"


def is_images(df: object) -> bool:
    """Whether a table has what ``analyze`` reads of an image."""
    return isinstance(df, DataFrame) and {"plate_id", "height", "width", "channels", "data", "turn"} <= set(df.columns)


def to_array(height: int, width: int, channels: int, data: bytes, turn: int = 1) -> np.ndarray:
    """RGB in 0..1; grey pictures become three equal channels, alpha is dropped."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    x = np.repeat(x, 3, axis=2) if channels == 1 else x[..., 2::-1]
    return upright(x, turn or 1).astype(float) / 255


def prepared(picture: np.ndarray, max_dim: int | None = 2000) -> dict:
    """A picture at working size with what is known of its original."""
    x = np.asarray(picture, float)
    if x.ndim == 2:
        x = np.repeat(x[..., None], 3, axis=2)
    x = x[..., :3]
    if x.max() > 1:
        x = x / 255
    over = float((x >= CLIPPED).any(axis=2).mean())
    size, factor = x.shape[:2], 1.0
    if max_dim and max(size) > max_dim:
        factor = max_dim / max(size)
        x = resize_area(x, factor)
    return {"rgb": x, "original_dim": size, "resize_factor": factor, "clipped_fraction": over}


def pixel_rows(images: DataFrame) -> DataFrame:
    """plate_id, y, x, r, g, b (1-based places, 0..1) of every pixel of decoded images, without Python."""
    at = F.posexplode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1))
    rows = images.filter("data is not null and channels >= 3").select("plate_id", "width", "channels", F.hex("data").alias("_h"), at.alias("_p", "_i"))
    value = lambda c: F.conv(F.substring("_h", (F.col("_i") * F.col("channels") + c) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255
    return rows.select("plate_id", (F.floor(F.col("_i") / F.col("width")) + 1).cast("int").alias("y"), (F.col("_i") % F.col("width") + 1).cast("int").alias("x"), value(2).alias("r"), value(1).alias("g"), value(0).alias("b"))


def simulated_images(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """Simulated plates in the form of read images; each spec has plate_id and arguments of ``simulate``."""
    import json

    plain = [(s["plate_id"], json.dumps({k: v for k, v in s.items() if k not in ("plate_id", "layout")}), s.get("centre", "bacteria")) for s in specs]

    def run(batches):
        import pandas as pd

        from ..operators.layout import plate_layout
        from .simulate import simulate

        for batch in batches:
            for plate_id, spec, _ in batch.itertuples(index=False):
                options = json.loads(spec)
                layout = plate_layout(centre=options.pop("centre", "bacteria"))
                x = np.rint(simulate(layout=layout, **options)["image"] * 255).astype(np.uint8)
                yield pd.DataFrame({"path": [f"{plate_id}.png"], "plate_id": [plate_id], "height": [x.shape[0]], "width": [x.shape[1]], "channels": [3], "data": [x[..., ::-1].tobytes()], "turn": [1]})

    rows = spark.createDataFrame(plain, "plate_id string, spec string, centre string").repartition(max(1, len(plain)))
    return rows.mapInPandas(run, "path string, plate_id string, height int, width int, channels int, data binary, turn int")
