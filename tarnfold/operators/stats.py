"""Rank statistics and tables (A1-A22). Global ranks run over distinct values with counts, cut into ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """A1, P7."""
    p = [F.round(F.expr(f"percentile({value}, {q})"), 6).alias(n) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))]
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), *p, F.max(value).alias("max"))


#: Ranges of values that a global order is cut into; each is a task's window.
RANGES = 64


def ranged(rows: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """`rows` plus _range: which of about equal parts of all rows, in the order of a number or time, a row lies in."""
    edges = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10000).alias("_edges"))
    return rows.crossJoin(F.broadcast(edges)).withColumn("_range", F.expr(f"size(filter(coalesce(_edges, array()), x -> x < {order}))")).drop("_edges")


def running(rows: DataFrame, order: str, value: str, name: str, *within: str, ranges: int = RANGES) -> DataFrame:
    """`rows` plus `name`: the sum of `value` over rows of the same `within` that come before in `order`, which is unique there.

    A prefix sum in two levels: over ranges, of which there are few, and inside each. No task orders all rows.
    """
    cut = ranged(rows, order, ranges)
    sums = cut.groupBy(*within, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in within], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*within, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within] + [F.col("_range") == F.col("_r")]
    return cut.join(sums, same).withColumn(name, F.col("_start") + F.col("_inner")).select(*rows.columns, name)


def median(rows: DataFrame, value: str, few: int = 100_000) -> float | None:
    """The exact median of a number as `percentile` gives it, by counting, or None without values.

    `percentile` holds all distinct values in one task. Here approximate quantiles bracket the middle rank, counts below, on
    and between them tell where it lies, and so on there until `few` rows are left. Edges are values of the table and each is
    settled by its count, so equal values don't hold it up and a bracket that misses costs a round, never the result.
    """
    v = F.col("v")
    # The sum keeps comparisons from the file reader, whose statistics may leave NaN out.
    some = rows.select((F.col(value).cast("double") + 0.0).alias("v")).where("v is not null")
    total = n = some.count()
    if not total:
        return None
    rest, below, high = some, 0, None
    while high is None:
        if n > few:
            at = (total // 2 - below + 0.5) / n
            lo, hi = rest.agg(F.percentile_approx("v", [max(at - 2e-4, 0.0), min(at + 2e-4, 1.0)], 10000)).first()[0]
            parts = [v < lo, v == lo, (v > lo) & (v < hi), (v > lo) & (v == hi), v > hi]
            counts = rest.agg(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(parts)]).first()
            pieces = list(zip(counts, (None, lo, None, hi, None), parts, strict=True))
        else:
            pieces = [(r["n"], r["v"], None) for r in rest.groupBy("v").agg(F.count("*").alias("n")).sort("v").collect()]
        for n, high, part in pieces:
            if below + n > total // 2:
                break
            below += n
        else:
            raise ValueError(f"the values of {value} changed between two passes")
        if high is None:
            rest = rest.where(part)
    low = high if below <= (total - 1) // 2 else some.where(v < high).agg(F.max("v")).first()[0]
    return 0.5 * low + 0.5 * high


def value_ranks(rows: DataFrame, value: str, *within: str) -> DataFrame:
    """(within, value, ties, rank): the average rank of each distinct value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count("*").alias("ties"))
    return running(counts, value, "ties", "rank", *within).withColumn("rank", F.col("rank") + (F.col("ties") + 1) / 2)


def _on(a: DataFrame, b: DataFrame, value: str, within: tuple[str, ...]) -> DataFrame:
    return a.join(b, [*within, value])


def kruskal_wallis(rows: DataFrame, group: str, value: str, least: int = 1) -> DataFrame:
    """A3: H with tie correction, epsilon squared, groups and rows; groups under `least` rows are left out."""
    big = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("k")).where(F.col("k") >= least)
    rows = rows.join(big.select(group), group, "left_semi")
    ranks = value_ranks(rows, value)
    sums = _on(rows.groupBy(group, value).agg(F.count("*").alias("m")), ranks, value, ()).groupBy(group).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rank")).alias("r"))
    total = sums.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    ties = ranks.agg(F.sum(F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")).alias("t"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    out = total.join(F.broadcast(ties)).withColumn("h", h)
    return out.select("groups", "n", F.round("h", 6).alias("h"), F.round((F.col("h") - F.col("groups") + 1) / (n - F.col("groups")), 6).alias("epsilon2"))


def mann_whitney(rows: DataFrame, flag: Column, value: str, *within: str) -> DataFrame:
    """U of the flagged rows, Cliff's delta and the corrected normal deviate, per `within`."""
    rows = rows.withColumn("_flag", flag).where(F.col(value).isNotNull() & F.col("_flag").isNotNull())
    ranks = value_ranks(rows, value, *within)
    per = rows.groupBy(*within, value).agg(F.count_if("_flag").alias("_a"), F.count_if(~F.col("_flag")).alias("_b"))
    s = _on(per, ranks, value, within).groupBy(*within).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum(F.col("_a") * F.col("rank")).alias("r"), F.sum(F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")).alias("t"))
    s = s.where("n1 > 0 and n2 > 0").withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = F.col("n1") + F.col("n2")
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("t") / (n * (n - 1))))
    z = F.try_divide(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2.0) - 0.5, sigma)
    return s.select(*within, "n1", "n2", F.round("u", 4).alias("u"), F.round(2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1, 6).alias("delta"), F.round(z, 6).alias("z"))


def effect_label(delta: Column) -> Column:
    """A7."""
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").otherwise("large")


def bh_fdr(rows: DataFrame, p: str) -> DataFrame:
    """Benjamini-Hochberg; null p-values have null q and don't count.

    Equal p-values have one q, so ranks are those of distinct values; the least later value is taken over ranges first.
    """
    kinds = rows.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    total = kinds.agg(F.sum("_n").alias("_m"))
    raw = running(kinds, "_p", "_n", "_before").crossJoin(F.broadcast(total)).withColumn("_raw", F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_n")))
    cut = ranged(raw, "_p")
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    least = cut.groupBy("_range").agg(F.min("_raw").alias("_least")).withColumn("_least", F.min("_least").over(later))
    inner = F.min("_raw").over(Window.partitionBy("_range").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    q = cut.withColumn("_inner", inner).join(least, "_range").select("_p", F.round(F.least("_inner", "_least", F.lit(1.0)), 6).alias("q"))
    return rows.join(q, F.col(p) == F.col("_p"), "left").drop("_p")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks over rows that have both."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("m"))
    rank = lambda c: running(rows.groupBy(c).agg(F.sum("m").alias("t")), c, "t", "_r").select(c, (F.col("_r") + (F.col("t") + 1) / 2).alias(f"_{c}"))
    r = rows.join(rank(x), x).join(rank(y), y)
    a, b, m = F.col(f"_{x}"), F.col(f"_{y}"), F.col("m")
    s = r.agg(F.sum("m").alias("n"), F.sum(m * a).alias("sa"), F.sum(m * b).alias("sb"), F.sum(m * a * b).alias("ab"), F.sum(m * a * a).alias("aa"), F.sum(m * b * b).alias("bb"))
    rho = F.expr("try_divide(n * ab - sa * sb, sqrt((n * aa - sa * sa) * (n * bb - sb * sb)))")
    return s.select("n", F.round(rho, 6).alias("rho"))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The statistic and degrees of freedom of the contingency table, without correction, from its filled cells alone."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("rb"))
    part = F.col("o").cast("double") * F.col("o") / (F.col("ra").cast("double") * F.col("rb"))
    out = cells.join(ra, a).join(rb, b).agg(F.sum("o").alias("n"), F.sum(part).alias("_q"))
    kinds = ra.agg(F.count("*").alias("_a")).crossJoin(rb.agg(F.count("*").alias("_b")))
    return out.crossJoin(kinds).select("n", F.round(F.col("n") * (F.col("_q") - 1), 6).alias("chi2"), ((F.col("_a") - 1) * (F.col("_b") - 1)).alias("df"))


def normal_p(z: float) -> float:
    """Two-sided p-value of a normal deviate."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p(x: float, df: int) -> float:
    """Upper tail of chi-square by the incomplete gamma function: a series below, a continued fraction above."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def quantile_bins(rows: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Right-closed bins at distinct quantile edges; equal values stay together."""
    edges = rows.agg(F.expr(f"array_sort(array_distinct(percentile({value}, array({', '.join(str(i / bins) for i in range(1, bins))}))))").alias("_edges"))
    out = rows.crossJoin(F.broadcast(edges))
    return out.withColumn(name, F.expr(f"size(filter(_edges, x -> x < {value}))")).drop("_edges")


def regression_metrics(rows: DataFrame, y: str, guess: str, *by: str) -> DataFrame:
    """ML1, ML7: mean absolute error, root mean square error and R2."""
    e = F.col(y) - F.col(guess)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*")), 6).alias("r2"))


def ecdf(rows: DataFrame, value: str) -> DataFrame:
    """Share of rows up to each distinct value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    rows = running(counts, value, "n", "_before").crossJoin(F.broadcast(total))
    return rows.select(value, "n", F.round((F.col("_before") + F.col("n")) / F.col("_total"), 8).alias("ecdf"))


def pareto(rows: DataFrame, value: str) -> DataFrame:
    """Counts of values from the most frequent down and their running share."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cumulative", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 8))


def field_quality(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Nulls, blanks and distinct values of every field, in one aggregation."""
    parts = []
    for f in fields:
        s = F.col(f).cast("string")
        parts += [F.struct(F.lit(f).alias("field"), F.count_if(F.col(f).isNull()).alias("nulls"), F.count_if(F.trim(s) == "").alias("blanks"), F.countDistinct(f).alias("kinds"), F.count("*").alias("rows"))]
    return rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
