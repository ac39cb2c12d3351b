"""Segments, gap-tier episodes, panels, sweeps and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.exprs import days_between
from tarnfold.operators.versions import run_number

TIERS = ("T1", "T2", "T3")


def forward_fill(value: Column, entity: list[str], order: list[str]) -> Column:
    """L1: the last value that isn't null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def segments(rows: DataFrame, entity: str, key: str, start: str, end: str, tie: str) -> DataFrame:
    """L2: runs of equal `key` in order of `start`; each null key is a run of its own."""
    w = Window.partitionBy(entity).orderBy(start, tie)
    rows = rows.withColumn("_new", run_number(F.col(key), [entity], [start, tie]))
    rows = rows.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.groupBy(entity, "segment").agg(F.min(start).alias("segment_start"), F.max(end).alias("segment_end"), F.count("*").alias("rows"))


def gap_tier(gap: Column, threshold: Column | float = 7) -> Column:
    """T1 from the threshold on, T2 above 0, T3 otherwise and for a null gap."""
    return F.when(gap >= threshold, "T1").when(gap > 0, "T2").otherwise("T3")


def assign_episodes(segs: DataFrame, entity: list[str], start: str, end: str, tie: str, threshold: Column | float = 7, calendar: bool = False) -> DataFrame:
    """Gap to the previous end, its tier, and strict (T1) and relaxed (T1, T2) episode numbers.

    Gaps are exact days or, with `calendar`, whole days. The first segment of an entity has no gap and an empty tier.
    """
    w = Window.partitionBy(*entity).orderBy(start, tie)
    last = F.lag(end).over(w)
    gap = F.datediff(F.col(start), last) if calendar else days_between(F.col(start), last)
    rows = segs.withColumn("gap_days", gap)
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("tier", F.when(first, "").otherwise(gap_tier(F.col("gap_days"), threshold)))
    grow = w.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda *tiers: (1 + F.sum(F.when(F.col("tier").isin(*tiers), 1).otherwise(0)).over(grow)).cast("long")
    return rows.withColumn("strict_no", count("T1")).withColumn("relaxed_no", count("T1", "T2"))


def episodes(assigned: DataFrame, entity: str, number: str, start: str, end: str) -> DataFrame:
    """One row an episode with its span, segments, and how many of its gaps are of each tier."""
    tiers = [F.count_if(F.col("tier") == t).alias(f"n_{t.lower()}") for t in TIERS]
    out = assigned.groupBy(entity, number).agg(F.min(start).alias("episode_start"), F.max(end).alias("episode_end"), F.count("*").alias("segments"), *tiers)
    return out.withColumn("days", (F.datediff("episode_end", "episode_start") + 1).cast("long"))


def daily_panel(intervals: DataFrame, keys: list[str], start: str, end: str, most_rows: int | None = 20_000_000) -> DataFrame:
    """A row a day and interval, both ends included; reversed intervals have none. More than `most_rows` is an error."""
    days = F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 1 day"))
    rows = intervals.where(F.to_date(end) >= F.to_date(start))
    if most_rows is not None:
        total = rows.agg(F.sum(F.datediff(end, start) + 1)).first()[0] or 0
        if total > most_rows:
            raise ValueError(f"the panel would have {total} rows, more than {most_rows}")
    return rows.select(*keys, F.explode(days).alias("day"))


def active_series(intervals: DataFrame, start: str, end: str, cap: bool = False) -> DataFrame:
    """Per day of the span the arrivals, the exits (the day after an end) and the number active.

    Never a row a day and interval: two events an interval are counted by day, and the running sum is over days.
    """
    rows = intervals.select(F.to_date(start).alias("s"), F.to_date(end).alias("e")).where("e >= s")
    events = rows.select(F.col("s").alias("day"), F.lit(1).alias("a"), F.lit(0).alias("c")).unionAll(rows.select(F.date_add("e", 1), F.lit(0), F.lit(1)))
    daily = events.groupBy("day").agg(F.sum("a").alias("new"), F.sum("c").alias("ended"))
    span = rows.agg(F.min("s").alias("lo"), F.max("e").alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = spine.join(daily, "day", "left").na.fill(0, ["new", "ended"])
    return out.withColumn("active", F.sum(F.col("new") - F.col("ended")).over(w))


def merged_intervals(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """An entity's intervals of days, those that overlap or touch made one: (entity, _s, _e)."""
    rows = intervals.select(entity, F.to_date(start).alias("_s"), F.to_date(end).alias("_e")).where("_e >= _s")
    w = Window.partitionBy(entity).orderBy("_s", "_e")
    rows = rows.withColumn("_to", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_no", F.count_if(F.col("_to").isNull() | (F.col("_s") > F.date_add("_to", 1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(entity, "_no").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_no")


def daily_actives(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Per day with any the intervals and the distinct entities that are active, by two sweeps, without a panel."""
    rows = active_series(intervals, start, end).select("day", F.col("active").alias("rows"))
    one = active_series(merged_intervals(intervals, entity, start, end), "_s", "_e").select("day", F.col("active").alias("entities"))
    return rows.join(one, "day").where("rows > 0")


def rolling(rows: DataFrame, value: str, order: str, before: int, after: int, kind: str, name: str) -> DataFrame:
    """Rolling mean or median over rows of a daily series."""
    w = Window.orderBy(order).rowsBetween(-before, after)
    c = F.avg(value) if kind == "mean" else F.expr(f"percentile({value}, 0.5)")
    return rows.withColumn(name, F.round(c.over(w), 6))


def period_table(rows: DataFrame, time: str, unit: str, value: str, small: int = 30) -> DataFrame:
    """Count, mean and quartiles by month, quarter or week; windows under `small` rows are marked."""
    out = rows.groupBy(F.to_date(F.date_trunc(unit, time)).alias("period")).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), *[F.round(F.expr(f"percentile({value}, {p})"), 4).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)]
    )
    return out.withColumn("small", (F.col("n") < small).cast("int"))


def temporal_split(rows: DataFrame, time: str, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """Split of each day such that a day is never divided; bounds are the first days at which the shares are reached, exclusive."""
    daily = rows.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")
    daily = daily.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    first = lambda share: F.min(F.when(F.col("cum") >= share * F.col("total"), F.col("day"))).over(Window.partitionBy())
    return daily.withColumn("split", F.when(F.col("day") < first(train), "train").when(F.col("day") < first(valid), "valid").otherwise("test")).select("day", "n", "split")


def top_share(rows: DataFrame, value: str, k: int) -> DataFrame:
    """Share of non-null rows that the k most frequent values cover."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), value)))
    return ranked.agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.sum(F.when(F.col("place") <= k, F.col("n")).otherwise(0)).alias("top")).withColumn("share", F.round(F.col("top") / F.col("total"), 6))
