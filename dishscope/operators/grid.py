"""Neighbourhoods on pixel grids as window expressions: the relational forms of the raster kernels.

A grid has key columns and integer y, x; every window is partitioned by the keys
and a row or a column, so no task holds more than one line of one plate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bands
from .kernels import gauss_radius


def _line(keys: list[str], along: str, r: int):
    across = "x" if along == "y" else "y"
    return Window.partitionBy(*keys, across).orderBy(along).rowsBetween(-r, r)


def box_blur(grid: DataFrame, keys: list[str], value: str, r: int, passes: int = 3, out: str = "blur") -> DataFrame:
    """Mean over columns, then rows, cut at the edges, ``passes`` times; the grid must be full."""
    c: str | Column = value
    for k in range(passes):
        grid = grid.withColumn(f"_v{k}", F.avg(c).over(_line(keys, "y", r))).withColumn(out, F.avg(f"_v{k}").over(_line(keys, "x", r))).drop(f"_v{k}")
        c = out
    return grid


def box_sum(grid: DataFrame, keys: list[str], value: str, r: int, out: str = "box") -> DataFrame:
    return grid.withColumn("_v", F.sum(value).over(_line(keys, "y", r))).withColumn(out, F.sum("_v").over(_line(keys, "x", r))).drop("_v")


def box_mean(grid: DataFrame, keys: list[str], value: str, r: int, weight: str | None = None, out: str = "mean") -> DataFrame:
    if r <= 0:
        return grid.withColumn(out, F.col(value))
    if weight is None:
        return box_blur(grid, keys, value, r, 1, out)
    g = grid.withColumn("_xw", F.when(F.col(weight) > 0, F.col(value) * F.col(weight)).otherwise(0.0))
    g = box_sum(box_sum(g, keys, "_xw", r, "_num"), keys, weight, r, "_den")
    return g.withColumn(out, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))).drop("_xw", "_num", "_den")


def gauss_blur(grid: DataFrame, keys: list[str], value: str, sigma: float, out: str = "blur", weight: str | None = None) -> DataFrame:
    """Three box means; with a weight, of the weighted values over those of the weights, null where there are none near."""
    if sigma <= 0.5:
        return grid.withColumn(out, F.col(value))
    r = gauss_radius(sigma)
    if weight is None:
        return box_blur(grid, keys, value, r, 3, out)
    g = grid.withColumn("_xw", F.when(F.col(weight) > 0, F.col(value) * F.col(weight)).otherwise(0.0))
    g = box_blur(box_blur(g, keys, "_xw", r, 3, "_num"), keys, weight, r, 3, "_den")
    return g.withColumn(out, F.when(F.col("_den") >= 1e-6, F.col("_num") / F.col("_den"))).drop("_xw", "_num", "_den")


def local_sd(grid: DataFrame, keys: list[str], value: str, r: int, out: str = "sd") -> DataFrame:
    g = box_mean(grid.withColumn("_sq", F.col(value) * F.col(value)), keys, "_sq", r, None, "_m2")
    g = box_mean(g, keys, value, r, None, "_m1")
    return g.withColumn(out, F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)))).drop("_sq", "_m1", "_m2")


def _sides(keys: list[str], mask: str) -> list[Column]:
    """The mask of the four neighbours; outside counts as false."""
    wy, wx = Window.partitionBy(*keys, "x").orderBy("y"), Window.partitionBy(*keys, "y").orderBy("x")
    return [F.coalesce(f(mask).over(w), F.lit(False)) for w in (wy, wx) for f in (F.lag, F.lead)]


def mask_boundary(grid: DataFrame, keys: list[str], mask: str, out: str = "boundary") -> DataFrame:
    a, b, c, d = _sides(keys, mask)
    return grid.withColumn(out, F.col(mask) & ~(a & b & c & d))


def perimeter(grid: DataFrame, keys: list[str], mask: str) -> DataFrame:
    """keys, perimeter_px."""
    names = [f"_s{i}" for i in range(4)]
    g = grid.select(*keys, mask, *[s.alias(n) for s, n in zip(_sides(keys, mask), names, strict=True)])
    edges = sum((F.when(F.col(mask) & ~F.col(n), 1).otherwise(0) for n in names[1:]), F.when(F.col(mask) & ~F.col(names[0]), 1).otherwise(0))
    return g.groupBy(*keys).agg((F.sum(edges) * (math.pi / 4)).alias("perimeter_px"))


def area_resize(grid: DataFrame, keys: list[str], values: list[str], factor: float) -> DataFrame:
    """keys, y, x, means of the pixels whose centre is in each cell of the smaller grid (sizes rounded half to even); y, x from 0."""
    size = grid.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    g = grid.join(F.broadcast(size), keys) if keys else grid.crossJoin(F.broadcast(size))  # a row a plate
    cell = lambda c, n: F.least(F.floor((F.col(c) + 0.5) * F.greatest(F.bround(F.col(n) * F.lit(factor)), F.lit(1.0)) / F.col(n)), F.greatest(F.bround(F.col(n) * F.lit(factor)), F.lit(1.0)) - 1).cast("int")
    return g.groupBy(*keys, cell("y", "_h").alias("y"), cell("x", "_w").alias("x")).agg(*[F.avg(v).alias(v) for v in values])


def resize_nearest(grid: DataFrame, keys: list[str], height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Rows of the nearest pixel for every cell of the new grid; y, x from 0."""
    spark = grid.sparkSession
    at = lambda c, n, m: F.least(F.greatest(F.ceil((F.col(c) + 0.5) * m / n), F.lit(1)), F.lit(m)) - 1
    cells = spark.range(new_height * new_width).select((F.col("id") / new_width).cast("int").alias("y"), (F.col("id") % new_width).cast("int").alias("x"))
    cells = cells.select("y", "x", at("y", new_height, height).cast("int").alias("_y"), at("x", new_width, width).cast("int").alias("_x"))
    return grid.withColumnRenamed("y", "_y").withColumnRenamed("x", "_x").join(cells, ["_y", "_x"]).drop("_y", "_x")


def edt(grid: DataFrame, keys: list[str], mask: str, out: str = "dist") -> DataFrame:
    """Exact distance to the nearest false pixel, band by band."""
    return bands.edt(grid, keys, mask, out)


def label_components(grid: DataFrame, keys: list[str], mask: str, connectivity: int = 8, out: str = "label") -> DataFrame:
    """Components of each plate, numbered by first appearance down the columns, band by band."""
    return bands.label_components(grid, keys, mask, connectivity, out)


def bilinear(grid: DataFrame, keys: list[str], points: DataFrame, value: str, out: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Points (keys, px, py, and columns to keep) with the value between their four pixels; null outside."""
    own = [*keys, *(keep or []), "px", "py"]
    p = points.select(*own, F.floor("px").cast("int").alias("_x"), F.floor("py").cast("int").alias("_y"), F.monotonically_increasing_id().alias("_id"))
    corner = lambda dx, dy: F.struct(
        (F.col("_x") + dx).alias("x"), (F.col("_y") + dy).alias("y"), ((F.col("px") - F.col("_x")) if dx else (1 - F.col("px") + F.col("_x"))).alias("_u"), ((F.col("py") - F.col("_y")) if dy else (1 - F.col("py") + F.col("_y"))).alias("_w")
    )
    corners = F.array(*[corner(dx, dy) for dx in (0, 1) for dy in (0, 1)])
    parts = p.select(*own, "_id", F.explode(corners).alias("c")).select(*own, "_id", "c.*").filter("_u * _w > 0")
    met = parts.join(grid.select(*keys, "x", "y", value), [*keys, "x", "y"], "left")
    sums = met.groupBy(*own, "_id").agg(F.sum(F.col("_u") * F.col("_w") * F.col(value)).alias(out), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_all"))
    return sums.select(*own, F.when(F.col("_n") == F.col("_all"), F.col(out)).alias(out))
