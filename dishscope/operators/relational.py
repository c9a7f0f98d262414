"""Metadata, position bias, and unions: the relational layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_NAME = r"(?i)\.(jpe?g|png|tiff?|heic)$"
METADATA = T.StructType([T.StructField(n, T.IntegerType() if n in ("day", "replicate") else T.StringType()) for n in ("file", "plate_id", "treatment", "bacterium", "zymo_strain", "medium", "day", "replicate", "photo_date", "notes")])
BIASED = ("delta_MI_facing", "growth_inhibition_pct")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path of the image files directly in a folder, by name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    return found.filter(base_name(F.col("path")).rlike(IMAGE_NAME)).orderBy(base_name(F.col("path")))


def treatment_of(name: Column, patterns: dict[str, str] | None, default: str | None = None) -> Column:
    """The last treatment whose pattern is in the name, else the default."""
    out = F.lit(default).cast("string")
    for treatment, pattern in (patterns or {}).items():
        out = F.when(name.rlike(f"(?i){pattern}"), F.lit(treatment)).otherwise(out)
    return out


def metadata_sheet(files: DataFrame, treatment: str | None = None, patterns: dict[str, str] | None = None, extra: dict | None = None, path: str = "path") -> DataFrame:
    """A metadata row for each file path."""
    name = base_name(F.col(path))
    columns = {n: F.lit(None).cast(METADATA[n].dataType) for n in METADATA.names}
    columns |= {"file": name, "plate_id": stem(F.col(path)), "treatment": treatment_of(name, patterns, treatment)}
    columns |= {k: F.lit(v) for k, v in (extra or {}).items()}
    return files.select(*[c.alias(n) for n, c in columns.items()])


def write_metadata(sheet: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with missing values left blank; refuses to replace a sheet unless told."""
    sheet.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with its own columns; the known ones get their types."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    return raw.select(*[F.expr(f"try_cast(`{c}` AS {METADATA[c].dataType.simpleString()})").alias(c) if c in METADATA.names else F.col(f"`{c}`") for c in raw.columns])


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def attach_metadata(results: DataFrame, metadata: DataFrame, key: str, order: str) -> DataFrame:
    """Left join on the first metadata row of a key; columns the results already have are not replaced."""
    new = [c for c in metadata.columns if c not in results.columns and c != order]
    rows = first_rows(metadata.filter(F.col(key).isNotNull()), key, order).select(key, *[c for c in new if c != key])
    return results.join(rows, key, "left").select(*results.columns, *[c for c in new if c != key])


def union_fill(*parts: DataFrame | None) -> DataFrame:
    """Rows of all parts; columns in the order they first appear, nulls where a part lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for p in parts if p is not None])


def correct_facing_bias(colonies: DataFrame, control: str = "control", group: str = "treatment", variables: tuple[str, ...] = BIASED) -> DataFrame:
    """<variable>_corrected: less the mean of the same position over control plates."""
    if group not in colonies.columns or colonies.filter(F.col(group) == control).isEmpty():
        raise ValueError(f"no rows with {group} = {control}")
    own = [v for v in variables if v in colonies.columns]
    bias = colonies.filter(F.col(group) == control).groupBy("colony_id").agg(*[F.avg(v).alias(f"_{v}") for v in own])
    joined = colonies.join(F.broadcast(bias), "colony_id", "left")  # a row a position
    return joined.select(*colonies.columns, *[(F.col(v) - F.col(f"_{v}")).alias(f"{v}_corrected") for v in own])


def pixels_in_regions(pixels: DataFrame, regions: list[tuple[str, float, float, float]]) -> DataFrame:
    """class and the pixels' columns for every circle (class, x, y, r) and pixel in it; a pixel in two circles counts twice."""
    circles = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(r)).alias("r")) for c, x, y, r in regions])
    inside = lambda t: (F.col("x") - t["x"]) * (F.col("x") - t["x"]) + (F.col("y") - t["y"]) * (F.col("y") - t["y"]) <= t["r"] * t["r"]
    return pixels.select("*", F.explode(F.filter(circles, inside)).alias("_t")).select(F.col("_t.class").alias("class"), *pixels.columns)


def with_truth(measured: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both with the same keys; columns that both have get the suffixes _measured and _truth."""
    both = [c for c in measured.columns if c in truth.columns and c not in keys]
    name = lambda df, suffix: df.select(*[F.col(c).alias(f"{c}_{suffix}" if c in both else c) for c in df.columns])
    return name(measured, "measured").join(name(truth, "truth"), keys)
