"""Cell comparisons, column diagnostics, group tables, histories, filled samples, encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.exprs import trim_u


def cell_changes(before: DataFrame, after: DataFrame, key: str, registered: DataFrame) -> DataFrame:
    """C4: per column how many cells differ, and how many of these in rows whose key `registered` lacks.

    Texts are compared trimmed, nulls as empty texts; rows of one side only count as changed in every column.
    """
    kinds = dict(before.dtypes)
    columns = [c for c in before.columns if c != key]
    view = lambda c: F.coalesce(trim_u(F.col(c)), F.lit("")) if kinds[c] == "string" else F.col(c)
    side = lambda rows, s: rows.select(key, F.lit(True).alias(f"{s}_there"), *[view(c).alias(f"{s}_{i}") for i, c in enumerate(columns)])
    both = side(before, "old").join(side(after, "new"), key, "full").join(registered.select(key, F.lit(True).alias("known")).distinct(), key, "left")
    alone = F.col("old_there").isNull() | F.col("new_there").isNull()
    flags = [alone | ~F.col(f"old_{i}").eqNullSafe(F.col(f"new_{i}")) for i in range(len(columns))]
    one = both.agg(F.array(*[F.struct(F.lit(c).alias("field"), F.count_if(f).alias("changed"), F.count_if(f & F.col("known").isNull()).alias("unregistered")) for c, f in zip(columns, flags, strict=True)]).alias("all"))
    return one.select(F.inline("all"))


def column_diagnostics(rows: DataFrame, columns: list[str], rare: int = 20, constant: float = 0.99) -> DataFrame:
    """Per column the share of blanks, its values, the share of the most frequent one, whether that is nearly all,
    and how many values are rarer than `rare` with their share of all rows. Blanks are null or white space."""
    cells = rows.unpivot([], [F.col(c).cast("string").alias(c) for c in columns], "field", "value") if columns else None
    cells = cells.withColumn("value", F.when(trim_u(F.col("value")) != "", F.col("value")))
    counts = cells.groupBy("field", "value").agg(F.count("*").alias("n"))
    filled, few = F.col("value").isNotNull(), F.col("value").isNotNull() & (F.col("n") < rare)
    out = counts.groupBy("field").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("blank"), F.count_if(filled).alias("levels"),
        F.max(F.when(filled, F.col("n"))).alias("top"), F.count_if(few).alias("rare_levels"), F.coalesce(F.sum(F.when(few, F.col("n"))), F.lit(0)).alias("few"),
    )
    share = F.try_divide(F.col("top"), F.col("n") - F.col("blank"))
    return out.select("field", F.round(F.col("blank") / F.col("n"), 6).alias("missing"), "levels", F.round(share, 6).alias("top_share"), (share >= constant).cast("int").alias("nearly_constant"), "rare_levels", F.round(F.col("few") / F.col("n"), 6).alias("rare_share"))


def group_table(rows: DataFrame, group: str, value: str, least: int = 30, missing: str = "缺失") -> DataFrame:
    """A2: size, quartiles and their distance of each group with `least` values; a list counts for each of its distinct
    items and a null group is `missing`."""
    many = dict(rows.dtypes)[group].startswith("array")
    g = F.explode(F.array_distinct(group)) if many else F.coalesce(F.col(group).cast("string"), F.lit(missing))
    per = rows.where(F.col(value).isNotNull()).select(g.alias("level"), F.col(value).cast("double").alias("v")).where("level is not null").groupBy("level")
    out = per.agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).where(F.col("n") >= least)
    return out.select("level", "n", *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("p25", "median", "p75"))], F.round(F.col("q")[2] - F.col("q")[0], 4).alias("iqr"))


def profile_history(snapshots: DataFrame, rows: DataFrame, entity: str, time: str, job: str) -> DataFrame:
    """Runs of one profile over an entity's consistent snapshots: version, span, snapshots, and distinct jobs of `rows`
    (entity, time, job) at these snapshots."""
    w = Window.partitionBy(entity).orderBy(time)
    some = snapshots.where("state = 'CONSISTENT'").select(entity, time, F.coalesce("profile", F.lit("")).alias("profile"))
    start = (~F.col("profile").eqNullSafe(F.lag("profile").over(w))).cast("int")
    runs = some.withColumn("_s", start).withColumn("version", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    jobs = rows.select(entity, time, F.col(job).alias("_j")).join(runs.select(entity, time, "version"), [entity, time]).groupBy(entity, "version").agg(F.count_distinct("_j").alias("jobs"))
    spans = runs.groupBy(entity, "version").agg(F.min("profile").alias("profile"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("snapshots"))
    return spans.join(jobs, [entity, "version"], "left").select(entity, "version", "profile", "first_time", "last_time", "snapshots", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def filled_sample(rows: DataFrame, strata: list[tuple[str, Column]], key: str, size: int, filler: str = "filled") -> DataFrame:
    """Size // strata rows of each stratum, the first by key that no stratum before took, then rows by key until there
    are `size`. Keys are unique. The driver holds the keys of the sample, `size` at most."""
    each, taken, parts = max(1, size // max(1, len(strata))), [], []
    for name, mask in [*strata, (filler, F.lit(True))]:
        k = min(each, size - len(taken)) if name != filler else size - len(taken)
        got = [r[0] for r in rows.where(mask & F.col(key).isNotNull() & ~F.col(key).isin(taken)).select(key).orderBy(key).limit(k).collect()] if k > 0 else []
        taken += got
        parts.append((name, got))
    stratum = reduce(lambda c, p: F.when(F.col(key).isin(p[1]), F.lit(p[0])).otherwise(c), [p for p in parts if p[1]], F.lit(None).cast("string"))
    return rows.where(F.col(key).isin(taken)).withColumn("stratum", stratum)


def rank_robustness(a: DataFrame, b: DataFrame, item: str, score: str, tops: tuple[int, ...] = (10, 20)) -> DataFrame:
    """One row: items of both rankings, for each k how many stand among the first k of both, and Spearman's
    correlation of the places of shared items. Rankings are of dictionary items, few against the rows they count."""
    place = lambda rows, name: rows.select(item, F.row_number().over(Window.orderBy(F.desc(score), item)).alias(name))
    both = place(a, "x").join(place(b, "y"), item)
    again = both.select("x", "y", F.row_number().over(Window.orderBy("x")).alias("rx"), F.row_number().over(Window.orderBy("y")).alias("ry"))
    rho = F.when(F.count("*") >= 2, F.round(F.corr("rx", "ry"), 6))
    return again.agg(F.count("*").alias("shared"), *[F.count_if((F.col("x") <= k) & (F.col("y") <= k)).alias(f"top{k}") for k in tops], rho.alias("spearman"))


@dataclass
class Encoder:
    """An encoder that is there (PASS) or the reason why not (NOT_RUN); no vector is ever made up."""

    status: str
    load: Callable | None = None
    dims: int = 0
    reason: str = ""


def load_encoder(load: Callable[[], Callable[[list[str]], list]]) -> Encoder:
    """Tries `load` once on the driver; it returns a function from texts to vectors."""
    try:
        return Encoder("PASS", load, len(load()(["probe"])[0]))
    except Exception as error:  # whatever keeps a model from loading is its reason
        return Encoder("NOT_RUN", reason=f"{type(error).__name__}: {error}")


def encode_texts(rows: DataFrame, key: str, text: str, encoder: Encoder) -> DataFrame:
    """(key, vector) of each row; each task loads the encoder once, blank texts are not encoded and have no vector."""
    if encoder.status != "PASS":
        raise RuntimeError(f"the encoder is {encoder.status}: {encoder.reason}")
    load, dims = encoder.load, encoder.dims

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for b in batches:
            at = [i for i, t in enumerate(b["t"]) if t is not None and t.strip()]
            vectors: list = [None] * len(b)
            if at:
                encode = encode or load()
                for i, v in zip(at, encode([b["t"].iloc[i].strip() for i in at]), strict=True):
                    if len(v) != dims:
                        raise ValueError(f"a vector has {len(v)} numbers instead of {dims}")
                    vectors[i] = list(map(float, v))
            yield pd.DataFrame({key: b[key], "vector": vectors})

    return rows.select(key, F.col(text).alias("t")).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, vector array<float>")
