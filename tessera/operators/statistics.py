"""Non-parametric statistics as aggregations: chi-square, odds, ranks, Kruskal-Wallis, Dunn, Spearman, multiple testing.

Statistics are DataFrame expressions. p-values that need erfc or the incomplete gamma function are vectorised Arrow UDFs over result rows
(few), never over data rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators.ordering import Ordered, durable


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """two-sided p of a standard normal z."""
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction (Lentz) above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        c = b + step / c
        d = 1 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """upper tail of chi-square with df degrees of freedom."""
    return pd.Series([None if pd.isna(v) or not k or k <= 0 else upper_gamma(k / 2, v / 2) for v, k in zip(x, df)], dtype="float64")


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b): a continued fraction (Lentz), on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 10_000):
        before = total
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(total - before) <= 1e-16 * abs(total):
            break
    return scale * total


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """two-sided p of Student's t with df degrees of freedom."""
    return pd.Series([None if pd.isna(v) or not k or k <= 0 else beta_share(k / 2, 0.5, k / (k + v * v)) if math.isfinite(v) else 0.0 for v, k in zip(t, df)], dtype="float64")


def adjust(rows: DataFrame, p: str, by: Sequence[str], name: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg step-up over each group: the least of p * m / rank from here to the greatest p, capped at 1. A null p is not counted and stays null."""
    by = list(by)
    sizes = rows.groupBy(*by).agg(F.count(p).alias("m_")).withColumnsRenamed({c: f"by_{i}_" for i, c in enumerate(by)})
    counted = rows.join(sizes, [F.col(c).eqNullSafe(F.col(f"by_{i}_")) for i, c in enumerate(by)]).drop(*(f"by_{i}_" for i in range(len(by))))
    apart = counted.withColumn("apart_", F.xxhash64(*(c for c, kind in rows.dtypes if not kind.startswith("map"))))  # many rows may share a p
    down = Ordered(apart, by, [F.desc_nulls_last(p), "apart_"]).scan(place_=("sum", None))
    rank = F.when(F.col(p).isNotNull(), F.col("m_") + 1 - F.col("place_"))
    scanned = down.scan(**{name: ("min", F.least(F.lit(1.0), F.coalesce(F.col(p) * F.col("m_") / rank, F.lit(1.0))))}).rows
    return scanned.withColumn(name, F.when(F.col(p).isNotNull(), F.col(name))).drop("m_", "apart_", "place_")


def contingency(rows: DataFrame, row: str, col: str) -> DataFrame:
    """Observed counts of all combinations of the values met, zeros included: (row, col, o)."""
    counts = rows.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.count("*").cast("double").alias("o"))
    return complete_cells(counts)


def complete_cells(counts: DataFrame) -> DataFrame:
    """All combinations of labels: both sides are lists of categories."""
    cells = counts.select("row").distinct().crossJoin(F.broadcast(counts.select("col").distinct()))
    return cells.join(counts, ["row", "col"], "left").na.fill(0.0, ["o"])


def expected(cells: DataFrame) -> DataFrame:
    """(row, col, o, e, r, k, n): expected counts and margins."""
    sums = cells.withColumn("r", F.sum("o").over(Window.partitionBy("row"))).withColumn("k", F.sum("o").over(Window.partitionBy("col")))
    total = cells.agg(F.sum("o").alias("n"))
    return sums.crossJoin(F.broadcast(total)).withColumn("e", F.col("r") * F.col("k") / F.col("n"))


def chi_square(cells: DataFrame, correct: bool = False) -> DataFrame:
    """M1: one row: chi2, df, v (Cramer), p. correct: Yates' correction, in 2 x 2 tables only."""
    t = expected(cells)
    delta = F.abs(F.col("o") - F.col("e"))
    plain = delta * delta / F.col("e")
    less = delta - F.least(F.lit(0.5), delta)
    sums = t.agg(
        F.sum(F.when(F.col("e") > 0, plain)).alias("plain"), F.sum(F.when(F.col("e") > 0, less * less / F.col("e"))).alias("yates"),
        F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("cols"), F.max("n").alias("n"),
    )
    df = (F.col("rows") - 1) * (F.col("cols") - 1)
    chi = F.when(F.lit(correct) & (df == 1), F.col("yates")).otherwise(F.col("plain"))
    least = F.least("rows", "cols") - 1
    v = F.when((least > 0) & (F.col("n") > 0), F.sqrt(chi / (F.col("n") * least)))
    return sums.select(F.round(chi, 4).alias("chi2"), df.cast("long").alias("df"), F.round(v, 4).alias("v"), F.round(chi2_p(chi, df.cast("long")), 6).alias("p"))


def residuals(cells: DataFrame) -> DataFrame:
    """M1: standardised residuals (o - e) / sqrt(e (1 - r/n)(1 - k/n)), 4 decimals."""
    t = expected(cells)
    spread = F.col("e") * (1 - F.col("r") / F.col("n")) * (1 - F.col("k") / F.col("n"))
    return t.select("row", "col", F.col("o").cast("long").alias("o"), F.round(F.when(spread > 0, (F.col("o") - F.col("e")) / F.sqrt(spread)), 4).alias("residual"))


def odds_ratio(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """M2: a..d of the 2 x 2 table of two conditions, the odds ratio and its Wald interval at 95 %. Null where a cell is 0."""
    kept = rows.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    sums = kept.agg(*(F.count_if(c).cast("double").alias(n) for n, c in (("a", F.col("x") & F.col("y")), ("b", F.col("x") & ~F.col("y")), ("c", ~F.col("x") & F.col("y")), ("d", ~F.col("x") & ~F.col("y")))))
    a, b, c, d = map(F.col, "abcd")
    whole = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    ratio = a * d / (b * c)
    wide = 1.96 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    shown = lambda v: F.round(F.when(whole, v), 4)
    return sums.select(*(F.col(n).cast("long").alias(n) for n in "abcd"), shown(ratio).alias("odds_ratio"), shown(F.exp(F.log(ratio) - wide)).alias("low"), shown(F.exp(F.log(ratio) + wide)).alias("high"))


def proportion(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    """M2: share of `flag` in percent for each group, with 1.96 standard errors."""
    sums = rows.groupBy(by).agg(F.count(flag).alias("n"), F.avg(flag.cast("double")).alias("p"))
    wide = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return sums.select(by, "n", F.round(100 * F.col("p"), 4).alias("percent"), F.round(100 * wide, 4).alias("error"))


def ellipse(rows: DataFrame, by: str, x: str, y: str, level: float) -> DataFrame:
    """(by, n, mx, my, major, minor, angle): the ellipse that holds `level` of a bivariate normal with the group's means and covariance. One aggregation."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by)
    sums = both.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("c")).where("n > 2")
    half, apart = (F.col("vx") + F.col("vy")) / 2, F.col("vx") - F.col("vy")
    gap = F.sqrt(apart * apart / 4 + F.col("c") * F.col("c"))
    scale = -2 * math.log(1 - level)  # the chi-square quantile of two degrees of freedom
    axis = lambda value: F.round(F.sqrt(scale * value), 6)
    angle = F.round(F.atan2(half + gap - F.col("vx"), F.col("c")), 6)
    return sums.select(by, "n", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"), axis(half + gap).alias("major"), axis(F.greatest(half - gap, F.lit(0.0))).alias("minor"), angle.alias("angle"))


def ranked(rows: DataFrame, value: str, by: Sequence[str] = (), name: str = "r") -> DataFrame:
    """Average ranks over the table or within groups, from distinct values and their counts: a running sum over range partitions, since a continuous variable has as many
    distinct values as rows. Rows with a null value or group are left out."""
    by = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("t_"))
    counts = Ordered(counts, by, [value]).scan(upto_=("sum", F.col("t_"))).rows
    ranks = counts.withColumn(name, F.col("upto_") - (F.col("t_") - 1) / 2.0).drop("upto_")
    return rows.join(ranks, [*by, value])


def kruskal(rows: DataFrame, value: str, group: str) -> DataFrame:
    """M3: one row: n, k, df, h (tie-corrected), p. Null h below 6 values or 2 groups."""
    r = ranked(rows.where(F.col(group).isNotNull()).select(group, value), value)
    sums = r.groupBy(group).agg(F.count("*").alias("n_g"), F.sum("r").alias("r_g"))
    ties = r.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    total = sums.agg(F.sum("n_g").alias("n"), F.count("*").alias("k"), F.sum(F.col("r_g") * F.col("r_g") / F.col("n_g")).alias("s"))
    n = F.col("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    ok = (F.col("n") >= 6) & (F.col("k") >= 2)
    found = total.crossJoin(F.broadcast(ties)).withColumn("h_", F.when(ok, h))
    p = chi2_p(F.col("h_"), F.col("k") - 1)
    return found.select("n", "k", (F.col("k") - 1).alias("df"), F.round("h_", 4).alias("h"), F.round(p, 6).alias("p"))


def dunn(rows: DataFrame, value: str, group: str) -> DataFrame:
    """M4: (a, b, z) for each pair of groups, tie-corrected, 4 decimals; p-values by `normal_p` and `adjust`."""
    r = ranked(rows.where(F.col(group).isNotNull()).select(group, value), value)
    sums = r.groupBy(group).agg(F.count("*").cast("double").alias("n_g"), F.avg("r").alias("mean"))
    ties = r.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    left = sums.select(F.col(group).alias("a"), F.col("n_g").alias("na"), F.col("mean").alias("ma"))
    right = sums.select(F.col(group).alias("b"), F.col("n_g").alias("nb"), F.col("mean").alias("mb"))
    pairs = left.join(F.broadcast(right), F.col("a") < F.col("b")).crossJoin(F.broadcast(ties))  # pairs of labels
    n = F.col("n")
    spread = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("na") + 1 / F.col("nb"))
    return pairs.select("a", "b", F.round((F.col("ma") - F.col("mb")) / F.sqrt(spread), 4).alias("z"))


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 2) -> DataFrame:
    """M5: rank correlation over rows where both are known, for each group with at least `least` of them; p by Student's t, and its stars."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = ranked(ranked(both, x, by, "rx").drop("t_"), y, by, "ry")
    grouped = r.groupBy(*by) if by else r.groupBy()
    found = grouped.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho_")).where(F.col("n") >= least)
    left = F.col("n") - 2
    t = F.when(F.abs("rho_") < 1, F.col("rho_") * F.sqrt(left / (1 - F.col("rho_") * F.col("rho_")))).when(F.col("rho_").isNotNull(), F.lit(math.inf))
    tested = found.withColumn("p_", t_p(t, left))
    return tested.select(*by, "n", F.round("rho_", 4).alias("rho"), F.round("p_", 6).alias("p"), stars(F.col("p_")).alias("stars"))


def spearman_matrix(rows: DataFrame, columns: Sequence[str], least: int = 30) -> DataFrame:
    """M5: (x, y, n, rho, p, stars) for each pair of columns, complete cases of the pair, variables with at least `least` known values."""
    counts = rows.agg(*(F.count(c).alias(c) for c in columns)).first()
    kept = [c for c in columns if counts[c] >= least]
    parts = [spearman(rows, a, b).select(F.lit(a).alias("x"), F.lit(b).alias("y"), "n", "rho", "p", "stars") for i, a in enumerate(kept) for b in kept[i + 1 :]]
    out = rows.sparkSession.createDataFrame([], "x string, y string, n long, rho double, p double, stars string")
    for part in parts:
        out = out.unionByName(part)
    return out


def stars(p: Column) -> Column:
    """Significance marks of a p-value, null without one."""
    return F.when(p.isNull(), None).when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def loess(rows: DataFrame, by: Sequence[str], x: str, y: str, span: float = 0.7, points: int = 80, decimals: int = 6) -> DataFrame:
    """(by.., n, point, x, fit): local quadratic regression of y on x with tricube weights, at `points` even places of each group's range. The neighbourhood of a place
    reaches to its q-th nearest row, q = floor(span n), one at least. Rows with a null or non-finite x, y or a null group are left out. Where fewer than three
    values of x have weight the curve is a line through two, or a mean; where none has (all are at the end of the reach) it is null.

    The q-th nearest distance is the least reach of any q rows that follow each other in x, so ranks (range partitions) and an equi-join of ranks give it. Fits are
    closed forms of moments, which combine before the shuffle: `points` terms for each distinct x, and no task holds a group."""
    by = list(by)
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("x_", "y_"))
    kept = rows.select(*by, F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")).where(finite)
    for c in by:
        kept = kept.where(F.col(c).isNotNull())
    cells = durable(kept.groupBy(*by, "x_").agg(F.count("*").alias("c_"), F.sum("y_").alias("s_")))
    reach = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * span + 1e-5))
    groups = durable(cells.groupBy(*by).agg(F.sum("c_").alias("n"), F.min("x_").alias("lo_"), F.max("x_").alias("hi_")).withColumn("q_", reach))
    own = groups.alias("g")
    same = lambda left: [F.col(f"{left}.{c}") == F.col(f"g.{c}") for c in by] or F.lit(True)
    scanned = Ordered(cells, by, ["x_"]).scan(upto=("sum", F.col("c_"))).rows
    ranked_ = scanned.select(*by, "x_", F.explode(F.sequence(F.col("upto") - F.col("c_") + 1, F.col("upto"))).alias("rank_"))
    ends = ranked_.alias("r").join(own, same("r")).select(*(F.col(f"r.{c}") for c in by), F.col("x_").alias("end_"), (F.col("rank_") - F.col("q_") + 1).alias("rank_"))
    runs = ranked_.join(ends.where("rank_ > 0"), [*by, "rank_"]).groupBy(*by, "x_", "end_").agg(F.lit(0))
    place = F.col("lo_") + (F.col("hi_") - F.col("lo_")) * F.col("point") / max(1, points - 1)
    at_all = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    placed = runs.alias("r").join(own, same("r")).select(*(F.col(f"r.{c}") for c in by), "n", "lo_", "hi_", "x_", "end_", at_all).withColumn("x0_", place)
    widths = durable(placed.groupBy(*by, "n", "point", "x0_").agg(F.min(F.greatest(F.col("x0_") - F.col("x_"), F.col("end_") - F.col("x0_"))).alias("h_")))
    grid = widths.groupBy(*by).agg(F.collect_list(F.struct("point", "x0_", "h_")).alias("grid_")).alias("g")  # `points` entries
    met = cells.alias("r").join(grid, same("r")).select(*(F.col(f"r.{c}") for c in by), "x_", "c_", "s_", F.explode("grid_").alias("p_")).select("*", "p_.*")
    d = F.abs(F.col("x_") - F.col("x0_"))
    met = met.where((d < F.col("h_")) | (d == 0))
    cube = lambda z: z * z * z
    weight = F.when(F.col("h_") > 0, cube(1 - cube(d / F.col("h_")))).otherwise(1.0)
    u = F.when(F.col("h_") > 0, (F.col("x_") - F.col("x0_")) / F.col("h_")).otherwise(0.0)
    power = lambda k: F.col("u_") ** k if k else F.lit(1.0)
    weighed = met.withColumn("w_", weight).withColumn("u_", u)
    sums = weighed.groupBy(*by, "point").agg(
        F.count("*").alias("m_"), *(F.sum(F.col("w_") * F.col("c_") * power(k)).alias(f"s{k}") for k in range(5)), *(F.sum(F.col("w_") * F.col("s_") * power(k)).alias(f"t{k}") for k in range(3))
    )
    whole = "s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)"
    curve = F.expr(f"(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / nullif({whole}, 0)")
    line = F.expr("(t0 * s2 - s1 * t1) / nullif(s0 * s2 - s1 * s1, 0)")
    fit = F.coalesce(F.when(F.col("m_") > 2, curve), F.when(F.col("m_") > 1, line), F.col("t0") / F.col("s0"))
    return widths.join(sums, [*by, "point"], "left").select(*by, "n", "point", F.round("x0_", decimals).alias("x"), F.round(fit, decimals).alias("fit"))
