"""Pictures of results: a PNG writer, quality-control panels, darkness maps."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels as K

#: Fixed colours of the classes in class panels: agar, fungus, bacteria, halo, other, shadow.
PAINT = ((60, 60, 60), (190, 150, 90), (240, 230, 120), (120, 170, 90), (200, 80, 160), (40, 40, 90))


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of an (H, W, 3) array in 0..1 or of bytes."""
    x = rgb if rgb.dtype == np.uint8 else np.rint(np.clip(rgb, 0, 1) * 255).astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in x)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def melanin_ramp(n: int = 100) -> np.ndarray:
    """n colours from pale to dark brown (hue, chroma and lightness along a line and an arc), as RGB in 0..1."""
    from ..functions.colour import np_companded

    t = np.linspace(0, 1, n)
    h, c, light = np.radians(55 - 20 * t), 12 + 38 * np.sin(np.pi * np.minimum(t, 0.85) / 1.7), 94 - 80 * t
    u0, v0 = 0.1978398, 0.4683363
    y = np.where(light > 8, ((light + 16) / 116) ** 3, light / 903.3)
    u, v = c * np.cos(h) / (13 * light) + u0, c * np.sin(h) / (13 * light) + v0
    x, z = 9 * y * u / (4 * v), y * (12 - 3 * u - 20 * v) / (4 * v)
    from ..functions.colour import XYZ_TO_RGB

    return np_companded(np.clip(np.stack([x, y, z], axis=1) @ np.array(XYZ_TO_RGB).T, 0, 1))


def class_panel(seg: dict, shadow: np.ndarray) -> np.ndarray:
    """Classes painted over one another: agar, fungus, bacteria, halo, other, shadow, colonies."""
    out = np.broadcast_to(np.array(PAINT[0], np.uint8), (*seg["labels"].shape, 3)).copy()
    for mask, colour in ((seg["map"] == 1, PAINT[1]), (seg["bacteria"], PAINT[2]), (seg["halo"], PAINT[3]), (seg["other"], PAINT[4]), (shadow, PAINT[5])):
        out[mask] = colour
    top = int(seg["labels"].max())
    for k in range(1, top + 1):
        out[seg["labels"] == k] = np.rint(127 + 120 * np.cos(2 * np.pi * (k / max(top, 1) + np.array([0, 1 / 3, 2 / 3])))).astype(np.uint8)
    return out


#: What the colours of the class panel stand for, in the order of PAINT.
LEGEND = ("agar", "fungus", "bacteria", "halo", "other", "shadow")
#: Outlines on the photograph.
OUTLINES = {"halo": PAINT[3], "bacteria": PAINT[2], "satellites": (255, 0, 255), "colonies": (255, 40, 40)}


def outlined(rgb: np.ndarray, seg: dict) -> np.ndarray:
    """The photograph with the outlines of its objects."""
    photo = np.rint(np.clip(rgb, 0, 1) * 255).astype(np.uint8)
    for name in ("halo", "bacteria", "satellites"):
        photo[K.mask_boundary(seg[name])] = OUTLINES[name]
    for k in range(1, int(seg["labels"].max()) + 1):
        photo[K.mask_boundary(seg["labels"] == k)] = OUTLINES["colonies"]
    return photo


def legend_strip(width: int, colours: list[tuple[int, int, int]], height: int = 12) -> np.ndarray:
    """Swatches of equal width in the order of the legend."""
    at = np.minimum(np.arange(width) * len(colours) // max(width, 1), len(colours) - 1)
    return np.repeat(np.array(colours, np.uint8)[at][None], height, axis=0)


def qc_panels(rgb: np.ndarray, seg: dict, shadow: np.ndarray, panels: tuple[str, ...] = ("photo", "classes"), legend: bool = True) -> np.ndarray:
    """The chosen panels side by side, each above the swatches of its legend (``OUTLINES``, ``LEGEND``)."""
    known = {"photo": lambda: outlined(rgb, seg), "plain": lambda: show_rgb(rgb), "classes": lambda: class_panel(seg, shadow)}
    if bad := [p for p in panels if p not in known] or not panels:
        raise ValueError(f"unknown panels: {bad}")
    colours = {"photo": list(OUTLINES.values()), "plain": [(255, 255, 255)], "classes": list(PAINT)}
    drawn = []
    for name in panels:
        panel = known[name]()
        drawn.append(np.concatenate([panel, legend_strip(panel.shape[1], colours[name])]) if legend else panel)
    return np.concatenate(drawn, axis=1)


def show_rgb(rgb: np.ndarray, max_dim: int | None = None) -> np.ndarray:
    """A picture in 0..1 as bytes for ``png``, made smaller by area means where it is larger than ``max_dim``."""
    x = np.repeat(rgb[..., None], 3, axis=2) if rgb.ndim == 2 else rgb[..., :3]
    if max_dim and max(x.shape[:2]) > max_dim:
        x = K.resize_area(x, max_dim / max(x.shape[:2]))
    return np.rint(np.clip(x, 0, 1) * 255).astype(np.uint8)


def melanization_map(lab: np.ndarray, labels: np.ndarray, mm_per_px: float, mi_range=None, smooth_mm: float = 0.25, relief_smooth_mm: float = 1.5, taper_mm: float = 2.5, grid: int = 180) -> dict:
    """Smoothed darkness inside colonies, its range, ramp index, and a height field on a coarse grid."""
    inside = labels > 0
    mi = np.where(inside, K.gauss_blur(100 - lab[..., 0], max(0.6, smooth_mm / mm_per_px), inside), np.nan)
    if mi_range is None:
        lo, hi = np.quantile(mi[inside], [0.01, 0.99]) if inside.any() else (0.0, 1.0)
        mi_range = (float(np.floor(lo)), float(np.ceil(hi)))
    span = max(mi_range[1] - mi_range[0], 1e-9)
    index = np.where(inside, np.clip(np.floor((mi - mi_range[0]) / span * 99), 0, 99), -1).astype(int)
    relief = K.gauss_blur(100 - lab[..., 0], max(0.6, relief_smooth_mm / mm_per_px), inside)
    t = np.clip(K.edt_local(inside) * mm_per_px / taper_mm, 0, 1)
    height = np.where(inside, np.clip((np.nan_to_num(relief) - mi_range[0]) / span, 0, 1) * t * t * (3 - 2 * t), 0)
    step = max(1, int(np.ceil(max(lab.shape[:2]) / grid)))
    return {"MI": mi, "mi_range": mi_range, "ramp": melanin_ramp(), "index": index, "height": height[::step, ::step]}


def flat_map(m: dict, ground: tuple[int, int, int] = (245, 245, 245)) -> np.ndarray:
    """A darkness map from above, with its ramp along the right side (dark on top)."""
    ramp = np.rint(m["ramp"] * 255).astype(np.uint8)
    out = np.where((m["index"] >= 0)[..., None], ramp[np.maximum(m["index"], 0)], np.array(ground, np.uint8))
    h = out.shape[0]
    bar = np.repeat(ramp[99 - np.arange(h) * 100 // h][:, None], max(4, out.shape[1] // 25), axis=1)
    return np.concatenate([out, np.full((h, 4, 3), 255, np.uint8), bar], axis=1)


def relief_map(m: dict, tilt: float = 0.5, lift: float = 60.0, scale: int = 3, ground: tuple[int, int, int] = (245, 245, 245)) -> np.ndarray:
    """The darkness landscape seen obliquely: rows from the back to the front, each hiding what is behind it."""
    height = m["height"]
    step = int(np.ceil(m["index"].shape[0] / height.shape[0]))
    index = m["index"][::step, ::step][: height.shape[0], : height.shape[1]]
    colour = np.where((index >= 0)[..., None], m["ramp"][np.clip(index, 0, 99)] * 255, np.array(ground, float))
    # light from the left
    slope = np.gradient(height * lift, axis=1)
    colour = np.clip(colour * (1 + 0.15 * np.tanh(slope))[..., None], 0, 255).astype(np.uint8)
    h, w = height.shape
    top = int(lift) + 1
    out = np.full((top + int(h * tilt) + 1, w, 3), 255, np.uint8)
    rows = np.arange(out.shape[0])[:, None]
    for y in range(h):
        base = top + int(y * tilt)
        crest = base - np.rint(height[y] * lift).astype(int)
        wall = (rows >= crest[None, :]) & (rows <= base)
        out = np.where(wall[..., None], colour[y][None], out)
    return np.repeat(np.repeat(out, scale, axis=0), scale, axis=1)


def profile_points(profiles: DataFrame, colour_by: str = "colony_id", facet_by: str | None = None) -> DataFrame:
    """Tidy rows for ribbons: series, facet, x (mid_mm), y (MI_mean), lo, hi."""
    facet = F.col(facet_by).cast("string") if facet_by else F.lit("all")
    return profiles.select(F.col(colour_by).cast("string").alias("series"), facet.alias("facet"), F.col("mid_mm").alias("x"), F.col("MI_mean").alias("y"), F.col("MI_lo").alias("lo"), F.col("MI_hi").alias("hi")).orderBy("facet", "series", "x")


def darkness_field(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi of the darkness of colony pixels: the range of a map's ramp."""
    mi = 100 - F.col("L")
    return pixels.groupBy(*keys).agg(F.floor(F.percentile(mi, F.lit(0.01))).alias("lo"), F.ceil(F.percentile(mi, F.lit(0.99))).alias("hi"))
