"""Plate layouts: where colonies are expected."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("x_rel", T.DoubleType()), T.StructField("y_rel", T.DoubleType())])


@dataclass(frozen=True)
class Layout:
    """Expected positions in units of the dish radius, x to the right and y down."""

    positions: tuple[tuple[str, float, float], ...]
    centre: str = "bacteria"
    radius_mm: float | None = None
    search_frac: float = 0.4
    extra: dict = field(default_factory=dict, compare=False)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.positions), SCHEMA)

    def pixels(self, dish: dict) -> list[tuple[str, float, float]]:
        """(id, x, y) in pixels of a dish (x, y, r_outer, mm_per_px)."""
        out = []
        for name, u, v in self.positions:
            r = math.hypot(u, v)
            k = self.radius_mm / dish["mm_per_px"] / (r * dish["r_outer"]) if self.radius_mm is not None and r > 0 else 1.0
            out.append((name, dish["x"] + u * k * dish["r_outer"], dish["y"] + v * k * dish["r_outer"]))
        return out

    def summary(self) -> str:
        where = ", ".join(f"{n} ({u:.2f}, {v:.2f})" for n, u, v in self.positions)
        return f"layout of {len(self.positions)} colonies, centre {self.centre}: {where}"


def plate_layout(n_colonies: int = 4, radius_frac: float = 0.45, radius_mm: float | None = None, start_deg: float = -135, rotation_deg: float = 0, centre: str = "bacteria", ids=None, positions=None, search_frac: float = 0.4) -> Layout:
    if centre not in ("bacteria", "none", "fungus"):
        raise ValueError("centre is bacteria, none or fungus")
    turn = math.radians(rotation_deg)
    if positions is not None:
        cos, sin = math.cos(turn), math.sin(turn)
        spots = [(str(i), x * cos - y * sin, x * sin + y * cos) for i, x, y in positions]
    else:
        if ids is None:
            ids = ["TL", "TR", "BR", "BL"] if n_colonies == 4 and start_deg == -135 else [f"C{i + 1}" for i in range(n_colonies)]
        if len(ids) != n_colonies:
            raise ValueError("one id for each colony is needed")
        angles = [math.radians(start_deg + 360.0 * i / n_colonies) + turn for i in range(n_colonies)]
        spots = [(i, radius_frac * math.cos(a), radius_frac * math.sin(a)) for i, a in zip(ids, angles, strict=True)]
    if len({s[0] for s in spots}) < len(spots):
        raise ValueError("ids must differ")
    return Layout(tuple(spots), centre, radius_mm, search_frac)


def expected_positions(dishes: DataFrame, layout: Layout) -> DataFrame:
    """A row per plate and colony: colony_id, expected_x, expected_y, from columns x, y, r_outer, mm_per_px."""
    spots = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for i, u, v in layout.positions])
    rows = dishes.select("*", F.explode(spots).alias("_p"))
    r = F.sqrt(F.col("_p.u") * F.col("_p.u") + F.col("_p.v") * F.col("_p.v"))
    k: Column = F.lit(1.0)
    if layout.radius_mm is not None:
        k = F.when(r > 0, F.lit(float(layout.radius_mm)) / F.col("mm_per_px") / (r * F.col("r_outer"))).otherwise(1.0)
    return rows.select(*dishes.columns, F.col("_p.id").alias("colony_id"), (F.col("x") + F.col("_p.u") * k * F.col("r_outer")).alias("expected_x"), (F.col("y") + F.col("_p.v") * k * F.col("r_outer")).alias("expected_y"))


def centre_of_treatment(treatment: Column) -> Column:
    """none for missing treatments and controls, bacteria otherwise."""
    return F.when(F.coalesce(F.lower(treatment), F.lit("")).isin("", "na", "control", "ctrl"), "none").otherwise("bacteria")


def layout_by_treatment(row: dict | None, **options) -> Layout:
    value = (row or {}).get("treatment")
    missing = value is None or (isinstance(value, float) and math.isnan(value)) or str(value).lower() in ("", "control", "ctrl")
    return plate_layout(centre="none" if missing else "bacteria", **options)
