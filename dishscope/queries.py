"""Queries over the driver's tables, each with the same question in SQL.

The tables stand in for plates: lineitem's l_quantity / 50, l_discount / 0.1 and
l_tax / 0.08 are pixels' r, g, b; embeddings is a picture of 500 or more rows of 64
pixels; events are colony positions; customers are plates, orders their colonies.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colour as C
from .functions import robust
from .operators import bootstrap, grid, layout, relational, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("plate"), (F.col("l_quantity") / 50.0).alias("r"), (F.col("l_discount") / 0.1).alias("g"), (F.col("l_tax") / 0.08).alias("b"))


def lab_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    light, a, b = C.srgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return p.select("l_orderkey", "l_linenumber", "plate", "r", "g", F.col("b").alias("bl"), light.alias("L"), a.alias("a"), b.alias("b"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("y"), "label", F.posexplode("embedding").alias("x", "v")).select("y", "x", "label", F.col("v").cast("double").alias("v"))


_PIXELS = "SELECT l_orderkey, l_linenumber, l_returnflag AS plate, l_quantity / 50.0::DOUBLE AS r, l_discount / 0.1::DOUBLE AS g, l_tax / 0.08::DOUBLE AS b FROM lineitem"
_LIN = lambda v: f"(CASE WHEN {v} <= 0.04045::DOUBLE THEN {v} / 12.92::DOUBLE ELSE pow(({v} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
_F = lambda t: f"(CASE WHEN {t} > {(6 / 29) ** 3!r}::DOUBLE THEN pow({t}, {1 / 3!r}::DOUBLE) ELSE {t} / {3 * (6 / 29) ** 2!r}::DOUBLE + {4 / 29!r}::DOUBLE END)"
_XYZ = ", ".join(f"({m[0]}::DOUBLE * lr + {m[1]}::DOUBLE * lg + {m[2]}::DOUBLE * lb) / {w}::DOUBLE AS t{n}" for m, w, n in zip(C.RGB_TO_XYZ, C.WHITE, "xyz", strict=True))
_LAB = f"""px AS ({_PIXELS}), lin AS (SELECT *, {_LIN("r")} AS lr, {_LIN("g")} AS lg, {_LIN("b")} AS lb FROM px),
xyz AS (SELECT *, {_XYZ} FROM lin), f AS (SELECT *, {_F("tx")} AS fx, {_F("ty")} AS fy, {_F("tz")} AS fz FROM xyz),
lab AS (SELECT l_orderkey, l_linenumber, plate, r, g, b AS bl, 116 * fy - 16 AS L, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f)"""
_PLANE = "plane AS (SELECT CAST(vec_id AS INTEGER) AS y, label, CAST(i - 1 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i))"


@query(f"WITH {_LAB} SELECT l_orderkey, l_linenumber, round(L, 6) + 0.0 AS L, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM lab")
def srgb_to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lab_pixels(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", *[rounded(F.col(c)).alias(c) for c in ("L", "a", "b")])


_COMP = lambda v: f"(CASE WHEN {v} <= 0.0031308::DOUBLE THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({v}, {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END)"
_INV = lambda t: f"(CASE WHEN {t} > {6 / 29!r}::DOUBLE THEN {t} * {t} * {t} ELSE {3 * (6 / 29) ** 2!r}::DOUBLE * ({t} - {4 / 29!r}::DOUBLE) END)"
_RGB = ", ".join(f"least(greatest({m[0]!r}::DOUBLE * x + {m[1]!r}::DOUBLE * y + {m[2]!r}::DOUBLE * z, 0.0::DOUBLE), 1.0::DOUBLE) AS l{n}" for m, n in zip(C.XYZ_TO_RGB, "rgb", strict=True))


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * 2.0::DOUBLE AS L, (l_discount - 0.05::DOUBLE) * 800 AS a, (l_tax - 0.04::DOUBLE) * 1000 AS b FROM lineitem),
t AS (SELECT *, (L + 16) / 116 AS fy FROM s), u AS (SELECT *, fy + a / 500 AS fx, fy - b / 200 AS fz FROM t),
v AS (SELECT l_orderkey, l_linenumber, {_INV("fx")} * {C.WHITE[0]}::DOUBLE AS x, {_INV("fy")} AS y, {_INV("fz")} * {C.WHITE[2]}::DOUBLE AS z FROM u), w AS (SELECT *, {_RGB} FROM v)
SELECT l_orderkey, l_linenumber, round({_COMP("lr")}, 6) + 0.0 AS r, round({_COMP("lg")}, 6) + 0.0 AS g, round({_COMP("lb")}, 6) + 0.0 AS b FROM w""")
def lab_to_srgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    r, g, b = C.lab_to_srgb(F.col("l_quantity") * 2.0, (F.col("l_discount") - 0.05) * 800.0, (F.col("l_tax") - 0.04) * 1000.0)
    return li.select("l_orderkey", "l_linenumber", rounded(r).alias("r"), rounded(g).alias("g"), rounded(b).alias("b"))


@query(f"""WITH {_LAB}, h AS (SELECT *, degrees(atan2(b, a)) AS h, sqrt(a * a + b * b) AS c FROM lab)
SELECT l_orderkey, l_linenumber, round(c, 6) + 0.0 AS chroma, CASE WHEN c > 1 THEN round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 6) + 0.0 END AS hue FROM h""")
def chroma_hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma and hue of every pixel; a hue that rounding alone decides is left out."""
    p = lab_pixels(spark, sf_dir)
    c = C.chroma(F.col("a"), F.col("b"))
    return p.select("l_orderkey", "l_linenumber", rounded(c).alias("chroma"), F.when(c > 1, rounded(C.hue(F.col("a"), F.col("b")))).alias("hue"))


@query(f"""WITH {_LAB}, m AS (SELECT plate, avg(L) AS mL, avg(a) AS ma, avg(b) AS mb FROM lab GROUP BY plate)
SELECT plate, count(*) AS n, round(avg(sqrt(pow(L - mL, 2) + pow(a - ma, 2) + pow(b - mb, 2))), 6) AS mean_delta_e, round(max(sqrt(pow(L - mL, 2) + pow(a - ma, 2) + pow(b - mb, 2))), 6) AS max_delta_e
FROM lab JOIN m USING (plate) GROUP BY plate""")
def delta_e76(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lab_pixels(spark, sf_dir).select("plate", "L", "a", "b")
    m = p.groupBy("plate").agg(F.avg("L").alias("mL"), F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    d = C.delta_e((F.col("L"), F.col("a"), F.col("b")), (F.col("mL"), F.col("ma"), F.col("mb")))
    return p.join(F.broadcast(m), "plate").groupBy("plate").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(d)).alias("mean_delta_e"), rounded(F.max(d)).alias("max_delta_e"))


@query(f"""WITH {_LAB} SELECT plate, count(*) AS n, round(avg(CASE WHEN r >= {C.CLIPPED!r} OR g >= {C.CLIPPED!r} OR bl >= {C.CLIPPED!r} THEN 1.0 ELSE 0.0 END), 6) AS clipped,
round(avg(CASE WHEN L > 97 OR r >= {C.CLIPPED!r} OR g >= {C.CLIPPED!r} OR bl >= {C.CLIPPED!r} THEN 1.0 ELSE 0.0 END), 6) AS specular, round(avg((r + g + bl) / 3 * 255), 6) AS gray, round(avg(100 - L), 6) AS darkness FROM lab GROUP BY plate""")
def clip_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lab_pixels(spark, sf_dir)
    over = C.clipped(F.col("r"), F.col("g"), F.col("bl"))
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return p.groupBy("plate").agg(F.count(F.lit(1)).alias("n"), rounded(one(over)).alias("clipped"), rounded(one(C.specular(F.col("L"), over))).alias("specular"), rounded(F.avg(C.grey(F.col("r"), F.col("g"), F.col("bl")))).alias("gray"), rounded(F.avg(C.darkness(F.col("L")))).alias("darkness"))


@query(f"""WITH {_PLANE}, s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM plane),
c AS (SELECT CAST(least(floor((y + 0.5) * round_even(h * 0.3::DOUBLE, 0) / h), round_even(h * 0.3::DOUBLE, 0) - 1) AS INTEGER) AS y, CAST(least(floor((x + 0.5) * round_even(w * 0.3::DOUBLE, 0) / w), round_even(w * 0.3::DOUBLE, 0) - 1) AS INTEGER) AS x, v FROM plane, s)
SELECT y, x, round(avg(v), 6) + 0.0 AS v FROM c GROUP BY y, x""")
def area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.area_resize(plane(spark, sf_dir), [], ["v"], 0.3).select("y", "x", rounded(F.col("v")).alias("v"))


def _blurred(passes: int, r: int) -> str:
    steps, last = [], "v"
    source = "plane"
    for k in range(passes):
        steps.append(f"a{k} AS (SELECT y, x, avg({last}) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM {source})")
        steps.append(f"b{k} AS (SELECT y, x, avg(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM a{k})")
        source, last = f"b{k}", "v"
    return f"WITH {_PLANE}, {', '.join(steps)} SELECT y, x, round(v, 6) + 0.0 AS v FROM {source}"


@query(_blurred(1, 2))
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.box_mean(plane(spark, sf_dir), [], "v", 2).select("y", "x", rounded(F.col("mean")).alias("v"))


@query(_blurred(3, 2))
def gauss_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.gauss_blur(plane(spark, sf_dir), [], "v", 2.4).select("y", "x", rounded(F.col("blur")).alias("v"))


@query(f"""WITH {_PLANE}, a AS (SELECT y, x, avg(v) OVER w AS m1, avg(v * v) OVER w AS m2 FROM plane WINDOW w AS (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT y, x, avg(m1) OVER w AS m1, avg(m2) OVER w AS m2 FROM a WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT y, x, round(sqrt(greatest(m2 - m1 * m1, 0.0)), 6) AS sd FROM b""")
def local_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.local_sd(plane(spark, sf_dir), [], "v", 2).select("y", "x", rounded(F.col("sd")).alias("sd"))


_SIDES = "coalesce(lag(m) OVER c, false) AS n1, coalesce(lead(m) OVER c, false) AS n2, coalesce(lag(m) OVER r, false) AS n3, coalesce(lead(m) OVER r, false) AS n4"
_MASK = f"{_PLANE}, k AS (SELECT y, x, label, v > 0 AS m FROM plane), s AS (SELECT y, x, label, m, {_SIDES} FROM k WINDOW c AS (PARTITION BY x ORDER BY y), r AS (PARTITION BY y ORDER BY x))"


@query(f"WITH {_MASK} SELECT y, CAST(count(*) FILTER (WHERE m) AS BIGINT) AS inside, CAST(count(*) FILTER (WHERE m AND NOT (n1 AND n2 AND n3 AND n4)) AS BIGINT) AS boundary FROM s GROUP BY y")
def mask_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.mask_boundary(plane(spark, sf_dir).withColumn("m", F.col("v") > 0), [], "m")
    return g.groupBy("y").agg(F.count(F.when(F.col("m"), 1)).alias("inside"), F.count(F.when(F.col("boundary"), 1)).alias("boundary"))


@query(f"WITH {_MASK} SELECT round(sum(CASE WHEN m THEN (NOT n1)::INT + (NOT n2)::INT + (NOT n3)::INT + (NOT n4)::INT ELSE 0 END) * {math.pi / 4!r}::DOUBLE, 6) AS perimeter_px FROM s")
def perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.perimeter(plane(spark, sf_dir).withColumn("m", F.col("v") > 0), [], "m")
    return g.select(rounded(F.col("perimeter_px")).alias("perimeter_px"))


@query(f"""WITH {_PLANE}, k AS (SELECT y, x, v > -0.15 AS m FROM plane), u AS (SELECT y, x, m, max(CASE WHEN NOT m THEN y END) OVER (PARTITION BY x ORDER BY y ROWS UNBOUNDED PRECEDING) AS up, min(CASE WHEN NOT m THEN y END) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM k),
g AS (SELECT y, x, m, least(coalesce(y - up, 1000000), coalesce(down - y, 1000000)) AS g FROM u)
SELECT a.y, a.x, round(sqrt(CAST(min((a.x - b.x) * (a.x - b.x) + CAST(b.g AS BIGINT) * b.g) AS DOUBLE)), 6) AS dist FROM g a JOIN g b ON a.y = b.y GROUP BY a.y, a.x""")
def edt_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.edt(plane(spark, sf_dir).select("y", "x", (F.col("v") > -0.15).alias("m")), [], "m")
    return g.select("y", "x", rounded(F.col("dist")).alias("dist"))


@query(f"""WITH {_LAB}, e AS (SELECT plate, min(L) AS lo, max(L) AS hi FROM lab GROUP BY plate),
b AS (SELECT plate, lo, hi, least(floor((L - lo) / ((hi - lo) / 256)), 255) AS bin FROM lab JOIN e USING (plate)), h AS (SELECT plate, lo, hi, bin, count(*) AS n, lo + (bin + 0.5) * ((hi - lo) / 256) AS mid FROM b GROUP BY plate, lo, hi, bin),
c AS (SELECT *, sum(n) OVER u AS w, sum(n * mid) OVER u AS m, sum(n) OVER p AS tw, sum(n * mid) OVER p AS tm FROM h WINDOW u AS (PARTITION BY plate ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY plate)),
s AS (SELECT *, CASE WHEN tw > w THEN pow(tm * w / tw - m, 2) / (w * (tw - w)) ELSE 0 END AS between_var FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY between_var DESC, bin) AS k FROM s)
SELECT plate, round(lo + (bin + 1) * ((hi - lo) / 256), 4) AS threshold FROM t WHERE k = 1""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.otsu(lab_pixels(spark, sf_dir), ["plate"], "L").select("plate", rounded(F.col("threshold"), 4).alias("threshold"))


@query(f"""WITH {_LAB}, m AS (SELECT plate, median(L) AS med FROM lab GROUP BY plate)
SELECT plate, round(med, 6) AS med, round(1.4826 * median(abs(L - med)), 6) AS mad, round(quantile_cont(L, 0.05), 6) AS q05, round(quantile_cont(L, 0.95), 6) AS q95, round(stddev_samp(L), 6) AS sd FROM lab JOIN m USING (plate) GROUP BY plate, med""")
def robust_agar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lab_pixels(spark, sf_dir).select("plate", "L")
    more = p.groupBy("plate").agg(rounded(robust.quantile("L", 0.05)).alias("q05"), rounded(robust.quantile("L", 0.95)).alias("q95"), rounded(F.stddev_samp("L")).alias("sd"))
    return robust.with_mad(p, ["plate"], "L").join(more, "plate").select("plate", rounded(F.col("med")).alias("med"), rounded(F.col("mad")).alias("mad"), "q05", "q95", "sd")


@query(f"""WITH {_LAB}, h AS (SELECT plate, CAST(floor(L / 2) AS BIGINT) AS i, CAST(floor(a / 2) AS BIGINT) AS j, CAST(floor(b / 2) AS BIGINT) AS k, count(*) AS n FROM lab GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY n DESC, i || ' ' || j || ' ' || k) AS t FROM h) SELECT plate, (i + 0.5::DOUBLE) * 2 AS L, (j + 0.5::DOUBLE) * 2 AS a, (k + 0.5::DOUBLE) * 2 AS b, n FROM r WHERE t = 1""")
def color_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.colour_mode(lab_pixels(spark, sf_dir), ["plate"])


@query("""WITH b AS (SELECT event_type AS colony_id, user_id AS block, sum(value) AS s, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY colony_id ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY colony_id) AS nb, sum(n) OVER (PARTITION BY colony_id) AS rows_ FROM b), u AS (SELECT * FROM i WHERE nb >= 3 AND rows_ >= 2),
d AS (SELECT colony_id, i AS d, nb, rep FROM u, range(0, 200) t(rep)), k AS (SELECT colony_id, rep, CAST(('0x' || substr(md5('1|' || rep || '|' || d), 1, 8)) AS BIGINT) % nb AS i FROM d),
m AS (SELECT k.colony_id, rep, sum(s) / sum(n) AS m FROM k JOIN u ON k.colony_id = u.colony_id AND k.i = u.i GROUP BY k.colony_id, rep)
SELECT colony_id, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY colony_id""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("colony_id"), F.col("user_id").alias("block"), "value")
    b = bootstrap.block_bootstrap(e, ["colony_id"], "block", "value", 200)
    return b.select("colony_id", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"))


_COLONIES = "c AS (SELECT event_id, event_type AS colony_id, CASE WHEN user_id % 3 = 0 THEN 'control' ELSE 'bacteria' END AS treatment, value AS delta_MI_facing FROM events)"


@query(f"WITH {_COLONIES}, b AS (SELECT colony_id, avg(delta_MI_facing) AS m FROM c WHERE treatment = 'control' GROUP BY colony_id) SELECT event_id, c.colony_id, treatment, round(delta_MI_facing - m, 6) + 0.0 AS corrected FROM c LEFT JOIN b ON c.colony_id = b.colony_id")
def facing_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("colony_id"), F.when(F.col("user_id") % 3 == 0, "control").otherwise("bacteria").alias("treatment"), F.col("value").alias("delta_MI_facing"))
    c = relational.correct_facing_bias(e)
    return c.select("event_id", "colony_id", "treatment", rounded(F.col("delta_MI_facing_corrected")).alias("corrected"))


_GROUPED = "o AS (SELECT c_mktsegment AS g, c_custkey AS p, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT g, p, count(*) AS n, avg(v) AS mean, var_samp(v) AS var_ FROM o GROUP BY g, p)"


def _plate_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return stats.plate_sums(o.join(c, "o_custkey"), "o_totalprice", "c_mktsegment", "o_custkey")


@query(f'WITH {_GROUPED} SELECT g AS "group", count(*) AS n_plates, CAST(sum(n) AS BIGINT) AS n_colonies, round(avg(mean), 4) AS mean, round(stddev_samp(mean), 4) AS sd_between_plates, round(avg(sqrt(var_)), 4) AS sd_within_plates FROM s GROUP BY g')
def group_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: plates with their groups, colonies' means by plate, then by group."""
    d = stats.group_descriptives(_plate_sums(spark, sf_dir))
    return d.select("group", "n_plates", "n_colonies", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "sd_between_plates", "sd_within_plates")])


@query(f"""WITH {_GROUPED}, h AS (SELECT *, CASE WHEN g IN ('AUTOMOBILE', 'BUILDING') THEN 'first' ELSE 'other' END AS half FROM s),
m AS (SELECT avg(mean) FILTER (WHERE half = 'first') AS a, avg(mean) FILTER (WHERE half = 'other') AS b, var_samp(mean) FILTER (WHERE half = 'first') AS va, var_samp(mean) FILTER (WHERE half = 'other') AS vb, count(*) FILTER (WHERE half = 'first') AS na, count(*) FILTER (WHERE half = 'other') AS nb FROM h)
SELECT 'other' AS term, round(b - a, 4) AS estimate, round(sqrt(va / na + vb / nb), 4) AS se, round((b - a) / sqrt(va / na + vb / nb), 6) AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df FROM m""")
def plate_means_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plate means of two groups of segments."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    half = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "first").otherwise("other")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), half.alias("half"))
    r = stats.compare(o.join(c, "o_custkey"), "o_totalprice", "half", "o_custkey", method="means").coefficients[0]
    return spark.createDataFrame([(r["term"], round(r["estimate"], 4), round(r["se"], 4), round(r["t"], 6), round(r["df"], 4))], "term string, estimate double, se double, t double, df double")


@query("""WITH m AS (SELECT o_custkey AS plate_id, o_orderpriority AS treatment, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT c_custkey AS plate_id, c_mktsegment, treatment FROM customer LEFT JOIN m ON c_custkey = plate_id AND k = 1""")
def metadata_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plate_id"), "c_mktsegment")
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plate_id"), F.col("o_orderpriority").alias("treatment"), "o_orderkey")
    return relational.attach_metadata(c, m, "plate_id", "o_orderkey")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(NULL AS BIGINT) AS supp, 'nation' AS part FROM nation UNION ALL SELECT r_regionkey, r_name, NULL, 'region' FROM region UNION ALL SELECT s_nationkey, NULL, s_suppkey, 'supplier' FROM supplier""")
def union_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("part"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("part"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("id"), F.col("s_suppkey").cast("long").alias("supp"), F.lit("supplier").alias("part"))
    return relational.union_fill(n, r, None, s)


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS file FROM pages), t AS (SELECT page_id, file, regexp_replace(file, '\.[^.]*$', '') AS plate_id, CASE WHEN regexp_matches(file, '(?i)html') THEN 'bacteria' WHEN regexp_matches(file, '(?i)[13579]') THEN 'control' END AS treatment FROM p)
SELECT page_id, file, plate_id, treatment, CASE WHEN coalesce(lower(treatment), '') IN ('', 'na', 'control', 'ctrl') THEN 'none' ELSE 'bacteria' END AS centre FROM t""")
def metadata_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    files = p.select("page_id", F.col("url").alias("path"))
    name = relational.base_name(F.col("path"))
    treatment = relational.treatment_of(name, {"control": "[13579]", "bacteria": "html"})
    out = files.select("page_id", name.alias("file"), relational.stem(F.col("path")).alias("plate_id"), treatment.alias("treatment"))
    return out.withColumn("centre", layout.centre_of_treatment(F.col("treatment")))


@query(f"""WITH d AS (SELECT c_custkey AS plate_id, 100.0::DOUBLE + c_nationkey AS x, 200.0::DOUBLE AS y, 50.0::DOUBLE AS r FROM customer), p AS (SELECT * FROM (VALUES ('TL', -135.0), ('TR', -45.0), ('BR', 45.0), ('BL', 135.0)) v(id, deg))
SELECT plate_id, id AS colony_id, round(x + 0.45 * cos(radians(deg)) * r, 6) AS expected_x, round(y + 0.45 * sin(radians(deg)) * r, 6) AS expected_y FROM d, p""")
def layout_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plate_id"), (F.col("c_nationkey") + 100.0).alias("x"), F.lit(200.0).alias("y"), F.lit(50.0).alias("r_outer"), F.lit(0.9).alias("mm_per_px"))
    e = layout.expected_positions(d, layout.plate_layout())
    return e.select("plate_id", "colony_id", rounded(F.col("expected_x")).alias("expected_x"), rounded(F.col("expected_y")).alias("expected_y"))


@query()
def simulated_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole analyses of two simulated plates: a row per colony."""
    from .plans.batch import Settings, analyze
    from .sources.images import simulated_images

    images = simulated_images(spark, [{"plate_id": "sim_1", "width": 360, "height": 480, "seed": 1}, {"plate_id": "sim_2", "width": 360, "height": 480, "seed": 2, "facing_darkening": 6}])
    return analyze(images, settings=Settings()).colonies.select("plate_id", "colony_id", "detected", "area_mm2", "MI_mean", "MI_lo", "MI_hi", "delta_MI_facing", "gap_bacteria_mm")


from . import engine_queries  # noqa: E402,F401  it adds its queries to these
