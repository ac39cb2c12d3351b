"""Leak-safe features, splits, models and their checks (M1-M11, ML1, ML2, ML4, ML6-ML8, X2-X5, A19-A20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_share(*cols: str, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone, the same on every engine with MD5."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / 4294967296.0


def group_split(rows: DataFrame, group: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """M7: all rows of a group in one split, by the group's hash."""
    h = hash_share(group)
    return rows.withColumn("split", F.when(h < train, "train").when(h < train + valid, "valid").otherwise("test"))


def stratified_split(rows: DataFrame, key: str, stratum: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """M6: the same shares within each stratum, by rank of a hash."""
    w = Window.partitionBy(stratum).orderBy(hash_share(key), key)
    share = (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy(stratum))
    return rows.withColumn("split", F.when(share < train, "train").when(share < train + valid, "valid").otherwise("test"))


def split_leaks(rows: DataFrame, group: str) -> DataFrame:
    """M8: groups, and groups that are in several splits."""
    return rows.groupBy(group).agg(F.countDistinct("split").alias("k")).agg(F.count("*").alias("groups"), F.count_if(F.col("k") > 1).alias("leaks"))


def split_drift(rows: DataFrame, value: str) -> DataFrame:
    """Size, median and its shift against all rows, per split."""
    whole = rows.agg(F.expr(f"percentile({value}, 0.5)").alias("all_median"))
    per = rows.groupBy("split").agg(F.count("*").alias("n"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.75) - percentile({value}, 0.25)").alias("iqr"))
    return per.crossJoin(F.broadcast(whole)).select("split", "n", F.round("median", 4).alias("median"), F.round("iqr", 4).alias("iqr"), F.round(F.col("median") - F.col("all_median"), 4).alias("shift"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, share: float, least: int) -> DataFrame:
    """In each stratum the first by hash, at least `least` of them."""
    n = F.count("*").over(Window.partitionBy(stratum))
    quota = F.greatest(F.lit(least), F.floor(n * share))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_share(key), key))
    return rows.withColumn("_q", quota).withColumn("_n", nth).where("_n <= _q").drop("_q", "_n")


class Assembler:
    """M9 in part: medians, indicators and frequent levels learned from training rows only; transform() adds plain columns."""

    def __init__(self, numeric: list[str], categorical: list[str], least: int = 20) -> None:
        self.numeric, self.categorical, self.least = numeric, categorical, least
        self.medians: dict[str, float] = {}
        self.levels: dict[str, list[str]] = {}

    def fit(self, train: DataFrame) -> Assembler:
        row = train.agg(*[F.expr(f"percentile({c}, 0.5)").alias(c) for c in self.numeric]).first()
        self.medians = {c: row[c] for c in self.numeric}
        for c in self.categorical:
            rows = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") >= self.least).collect()
            self.levels[c] = sorted(r[c] for r in rows)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        out = {}
        for c in self.numeric:
            out[f"{c}_missing"] = F.col(c).isNull().cast("int")
            out[f"{c}_filled"] = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
        for c in self.categorical:
            known = self.levels[c]
            for level in known:
                out[f"{c}={level}"] = F.coalesce((F.col(c) == level).cast("int"), F.lit(0))
            out[f"{c}=other"] = (~F.coalesce(F.col(c).isin(known), F.lit(False))).cast("int")
        return rows.withColumns(out)

    def feature_names(self) -> list[str]:
        return [f"{c}{s}" for c in self.numeric for s in ("_missing", "_filled")] + [f"{c}={v}" for c in self.categorical for v in (*self.levels[c], "other")]


def evaluate(train: DataFrame, rows: DataFrame, features: list[str], y: str, kind: str = "ridge", **params) -> DataFrame:
    """ML2, ML4: fit on `train`, add `guess` to `rows`: dummy_mean, dummy_median, ridge, forest or boosted trees."""
    if kind.startswith("dummy"):
        how = F.avg(y) if kind == "dummy_mean" else F.expr(f"percentile({y}, 0.5)")
        return rows.withColumn("guess", F.lit(train.agg(how).first()[0]))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    make = {"ridge": lambda: LinearRegression(labelCol=y, elasticNetParam=0.0, regParam=params.pop("regParam", 1.0), **params), "forest": lambda: RandomForestRegressor(labelCol=y, seed=42, **params), "boosted": lambda: GBTRegressor(labelCol=y, seed=42, **params)}[kind]
    vectors = VectorAssembler(inputCols=features, outputCol="features")
    model = make().setPredictionCol("guess").fit(vectors.transform(train))
    return model.transform(vectors.transform(rows)).drop("features")


def bootstrap(rows: DataFrame, key: str, value: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """ML6, X2 in part: the mean of `value` in each round of resampling by Poisson weights that a hash of key and round draws."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    weight = sum(((F.col("u") >= s).cast("int") for s in steps), F.lit(0))
    drawn = rows.select(key, value).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("u", u).withColumn("w", weight)
    return drawn.groupBy("round").agg(F.round(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")), 6).alias("mean"))


def permutation_gain(rows: DataFrame, guess: Column, y: str, columns: list[str], key: str, seed: int = 42) -> DataFrame:
    """How much the mean absolute error grows when `columns` jointly come from another row, by two orders of hashes."""
    place = lambda s: F.row_number().over(Window.orderBy(hash_share(key, seed=s), key))
    a = rows.withColumn("_at", place(seed)).withColumn("_before", F.abs(F.col(y) - guess)).drop(*columns)
    b = rows.select(*columns, place(seed + 1).alias("_at"))
    both = a.join(b, "_at").withColumn("_after", F.abs(F.col(y) - guess))
    return both.agg(F.count("*").alias("n"), F.round(F.avg("_before"), 6).alias("mae"), F.round(F.avg("_after") - F.avg("_before"), 6).alias("gain"))


def winsorised(rows: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values clipped to two of their quantiles."""
    edge = rows.agg(F.expr(f"percentile({value}, {low})").alias("_lo"), F.expr(f"percentile({value}, {high})").alias("_hi"))
    return rows.crossJoin(F.broadcast(edge)).withColumn(value, F.least(F.greatest(value, "_lo"), "_hi")).drop("_lo", "_hi")


def blacklist(columns: list[str], names: list[str], patterns: list[str]) -> list[str]:
    """Columns that must not be features."""
    import re

    return [c for c in columns if c in names or any(re.search(p, c) for p in patterns)]


def joined(base: DataFrame, others: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """M2: a chain of left joins that never multiplies rows; each side must be unique by its keys."""
    return reduce(lambda a, o: a.join(o[0].dropDuplicates(o[1]), o[1], "left"), others, base)
