"""Group comparison of colony measures with plates as the unit of replication."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_tail(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


@dataclass
class Comparison:
    method: str
    coefficients: list[dict]
    icc: float | None
    descriptives: DataFrame
    note: str | None = None


def plate_sums(colonies: DataFrame, response: str, group: str, plate: str) -> DataFrame:
    """group, plate, n, mean, ss: what every comparison needs of a plate."""
    rows = colonies.filter(F.col(response).isNotNull() & ~F.isnan(F.col(response).cast("double")))
    y = F.col(response).cast("double")
    return rows.groupBy(F.col(group).alias("group"), F.col(plate).alias("plate")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), (F.coalesce(F.var_samp(y), F.lit(0.0)) * (F.count(F.lit(1)) - 1)).alias("ss"))


def group_descriptives(sums: DataFrame) -> DataFrame:
    """group, n_plates, n_colonies, mean (of plate means), sd_between_plates, sd_within_plates (mean of the plates')."""
    within = F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1)))
    return sums.groupBy("group").agg(F.count(F.lit(1)).alias("n_plates"), F.sum("n").alias("n_colonies"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd_between_plates"), F.avg(within).alias("sd_within_plates"))


@dataclass
class Cells:
    """What a mixed model needs of plates: for each group and number of colonies a plate, sums over its plates.

    Plate means are taken less ``origin``, so squares stay small.  There are as many
    cells as groups times different plate sizes, however many plates.
    """

    origin: float
    rows: list[dict]

    @classmethod
    def of(cls, sums: DataFrame) -> Cells:
        origin = sums.agg(F.avg("mean")).first()[0] or 0.0
        y = F.col("mean") - F.lit(origin)
        cells = sums.groupBy("group", "n").agg(F.count(F.lit(1)).alias("k"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum("ss").alias("ss"))
        return cls(origin, [r.asDict() for r in cells.orderBy("group", "n").collect()])

    def at(self, theta: float, levels: list[str]) -> tuple[float, float, dict[str, tuple[float, float]]]:
        """(deviance, residual variance, mean and weight by group) of REML at a ratio of variances."""
        total, rss, logdet, means = sum(c["n"] * c["k"] for c in self.rows), sum(c["ss"] for c in self.rows), 0.0, {}
        for g in levels:
            own = [(c["n"] / (1 + theta * c["n"]), c) for c in self.rows if c["group"] == g]
            w, wy = sum(v * c["k"] for v, c in own), sum(v * c["sy"] for v, c in own)
            rss += sum(v * c["syy"] for v, c in own) - wy * wy / w
            logdet += math.log(w) + sum(c["k"] * math.log1p(theta * c["n"]) for _, c in own)
            means[g] = (self.origin + wy / w, w)
        free = total - len(levels)
        return free * math.log(rss / free) + logdet, rss / free, means


def _mixed(cells: Cells, levels: list[str]) -> tuple[list[dict], float]:
    """REML of y ~ group + (1 | plate), profiled over the ratio of variances on ever finer grids; groups do not share parameters but it."""
    lo, step, n, best = -12.0, 0.05, 401, 0.0
    for _ in range(4):
        logs = [lo + step * i for i in range(n)]
        deviance = [(round(cells.at(t, levels)[0], 9), i) for i, t in enumerate([0.0, *map(math.exp, logs)])]
        i = min(deviance)[1]
        best, middle = (0.0, -12.0) if i == 0 else (math.exp(logs[i - 1]), logs[i - 1])
        step, n = step / 100, 201
        lo = middle - 100 * step
    _, s2, means = cells.at(best, levels)
    df = sum(c["k"] for c in cells.rows) - len(levels)
    rows = []
    base, wb = means[levels[0]]
    for g in levels[1:]:
        m, w = means[g]
        est, se = m - base, math.sqrt(s2 * (1 / w + 1 / wb))
        rows.append({"term": g, "estimate": est, "se": se, "t": est / se, "ci_lo": est - Z95 * se, "ci_hi": est + Z95 * se, "df": df, "p": t_tail(est / se, df)})
    return rows, best / (1 + best)


def compare(colonies: DataFrame, response: str = "MI_mean", group: str = "treatment", plate: str = "plate_id", reference: str | None = None, method: str = "auto") -> Comparison:
    """Mixed model (three or more plates in every group) or plate means; the first level is the reference, else the first by name.

    Plates are summed up where they are: the driver gets a row for each group, and for
    each group and plate size.
    """
    sums = plate_sums(colonies, response, group, plate)
    described = group_descriptives(sums)
    sums = sums.filter(F.col("group").isNotNull())
    found = sums.groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.avg("mean").alias("mean"), F.var_samp("mean").alias("var")).collect()
    by = {r["group"]: r for r in found}
    levels = sorted(by)
    if reference is not None:
        if reference not in levels:
            raise ValueError(f"no group {reference}")
        levels = [reference, *[g for g in levels if g != reference]]
    if len(levels) < 2:
        raise ValueError("two groups are needed")
    if method == "mixed" or (method == "auto" and min(r["k"] for r in by.values()) >= 3):
        rows, icc = _mixed(Cells.of(sums), levels)
        return Comparison("mixed", rows, icc, described)
    if len(levels) == 2:
        a, b = (by[g] for g in levels)
        if a["var"] is None or b["var"] is None or not a["var"] + b["var"] > 0:
            return Comparison("welch", [], None, described, "too few plates for a test")
        va, vb = a["var"] / a["k"], b["var"] / b["k"]
        se, est = math.sqrt(va + vb), b["mean"] - a["mean"]
        df = (va + vb) ** 2 / (va**2 / (a["k"] - 1) + vb**2 / (b["k"] - 1))
        q = t_quantile(0.975, df)
        return Comparison("welch", [{"term": levels[1], "estimate": est, "se": se, "t": est / se, "ci_lo": est - q * se, "ci_hi": est + q * se, "df": df, "p": t_tail(est / se, df)}], None, described)
    n = sum(r["k"] for r in found)
    grand = sum(r["k"] * r["mean"] for r in found) / n
    between = sum(r["k"] * (r["mean"] - grand) ** 2 for r in found)
    rest = sum((r["var"] or 0.0) * (r["k"] - 1) for r in found)
    d1, d2 = len(levels) - 1, n - len(levels)
    f = (between / d1) / (rest / d2) if d2 > 0 and rest > 0 else float("nan")
    return Comparison("anova", [{"term": group, "df": d1, "sum_sq": between, "mean_sq": between / d1, "f": f, "p": f_tail(f, d1, d2) if f == f else float("nan")}, {"term": "residuals", "df": d2, "sum_sq": rest, "mean_sq": rest / d2 if d2 else float("nan"), "f": None, "p": None}], None, described)
