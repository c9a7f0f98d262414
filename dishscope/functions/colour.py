"""Colour expressions: sRGB, CIE Lab (D65) and what follows from them, as Columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sRGB and CIE standards.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
CLIPPED = 254.5 / 255
SPECULAR_L = 97.0

_CUT, _SLOPE = (6 / 29) ** 3, 3 * (6 / 29) ** 2
XYZ_TO_RGB = tuple(tuple(float(v) for v in row) for row in np.linalg.inv(np.array(RGB_TO_XYZ)))


def linear(v: Column) -> Column:
    """sRGB to linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def companded(v: Column) -> Column:
    """Linear light to sRGB."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.lit(1.055) * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def _f(t: Column) -> Column:
    return F.when(t > _CUT, F.pow(t, F.lit(1 / 3))).otherwise(t / _SLOPE + 4 / 29)


def _f_inverse(t: Column) -> Column:
    return F.when(t > 6 / 29, t * t * t).otherwise(F.lit(_SLOPE) * (t - 4 / 29))


def srgb_to_xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lr, lg, lb = linear(r), linear(g), linear(b)
    x, y, z = (m[0] * lr + m[1] * lg + m[2] * lb for m in RGB_TO_XYZ)
    return x, y, z


def xyz_to_lab(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    fx, fy, fz = _f(x / WHITE[0]), _f(y / WHITE[1]), _f(z / WHITE[2])
    return 116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz)


def srgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return xyz_to_lab(*srgb_to_xyz(r, g, b))


def lab_to_srgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Linear values are cut to [0, 1] before they are companded."""
    fy = (lightness + 16.0) / 116.0
    x, y, z = _f_inverse(fy + a / 500.0) * WHITE[0], _f_inverse(fy) * WHITE[1], _f_inverse(fy - b / 200.0) * WHITE[2]
    r, g, bl = (companded(F.least(F.greatest(m[0] * x + m[1] * y + m[2] * z, F.lit(0.0)), F.lit(1.0))) for m in XYZ_TO_RGB)
    return r, g, bl


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue(a: Column, b: Column) -> Column:
    """Degrees in [0, 360)."""
    h = F.degrees(F.atan2(b, a))
    return F.when(h < 0, h + 360.0).otherwise(h)


def delta_e(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """CIE 1976 colour difference."""
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(one[1:], two[1:], strict=True)), (one[0] - two[0]) * (one[0] - two[0])))


def grey(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3.0 * 255.0


def darkness(lightness: Column) -> Column:
    """The darkness index, 100 - L*."""
    return 100.0 - lightness


def clipped(r: Column, g: Column, b: Column) -> Column:
    return (r >= CLIPPED) | (g >= CLIPPED) | (b >= CLIPPED)


def specular(lightness: Column, over: Column) -> Column:
    return (lightness > SPECULAR_L) | over


def block_id(x: Column, y: Column, mm_per_px: Column | float, block_mm: float = 0.5) -> Column:
    scale = mm_per_px if isinstance(mm_per_px, Column) else F.lit(mm_per_px)
    return F.floor(x * scale / block_mm) * 100_000 + F.floor(y * scale / block_mm)


# The same over numpy planes, for the raster kernels.


def np_linear(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((np.maximum(v, 0) + 0.055) / 1.055) ** 2.4)


def np_companded(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * np.maximum(v, 1e-12) ** (1 / 2.4) - 0.055)


def np_lab(rgb: np.ndarray) -> np.ndarray:
    t = np_linear(rgb) @ np.array(RGB_TO_XYZ).T / np.array(WHITE)
    f = np.where(t > _CUT, np.cbrt(t), t / _SLOPE + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def np_srgb(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    xyz = np.where(f > 6 / 29, f**3, _SLOPE * (f - 4 / 29)) * np.array(WHITE)
    return np_companded(np.clip(xyz @ np.array(XYZ_TO_RGB).T, 0, 1))
