"""Bitemporal versioning: snapshots, run-length versions, histories, change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.exprs import canonical, days_between, signature


def collapse_snapshots(rows: DataFrame, keys: list[str], created: str, tie: list[str], fields: list[str], groups: dict[str, str] | None = None) -> DataFrame:
    """V3: one row a key (entity, time): the fields of the first row by (created, tie), counts, distinct groups, first created."""
    first = F.min_by(F.struct(*fields), F.struct(created, *tie)).alias("_first")
    # Sizes of small sets instead of distinct counts, which would make a copy of every row for each.
    counts = [F.size(F.collect_set(c)).cast("long").alias(n) for n, c in (groups or {}).items()]
    out = rows.groupBy(*keys).agg(F.count("*").alias("record_count"), *counts, F.min(created).alias("first_created"), first)
    return out.select(*keys, "record_count", *(groups or {}), "first_created", *[F.col("_first")[f].alias(f) for f in fields])


def snapshot_conflicts(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """V4: keys whose rows disagree, with the names of the fields that do; null is a value of its own."""
    kinds = [F.countDistinct(F.struct(f)).alias(f"_{f}") for f in fields]
    out = rows.groupBy(*keys).agg(F.count("*").alias("record_count"), *kinds)
    names = F.array_compact(F.array(*[F.when(F.col(f"_{f}") > 1, F.lit(f)) for f in fields]))
    return out.withColumn("fields", F.array_join(names, ",")).where("fields <> ''").select(*keys, "record_count", "fields")


def run_number(value: Column, entity: list[str], order: list[str]) -> Column:
    """V5: number of the run of equal neighbouring values; a null never equals its neighbour."""
    w = Window.partitionBy(*entity).orderBy(*order)
    new = F.when(F.coalesce(value == F.lag(value).over(w), F.lit(False)), 0).otherwise(1)
    return new


def assign_versions(rows: DataFrame, entity: list[str], order: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """V2, V5, V6: for each level (name -> fields) a run number per entity, all over one sort; fields are signed in canonical form."""
    w = Window.partitionBy(*entity).orderBy(*order)
    kinds = dict(rows.dtypes)
    for name, fields in levels.items():
        rows = rows.withColumn(f"_sig_{name}", signature(*[canonical(F.col(f), kinds[f]) for f in fields]))
    for name in levels:
        rows = rows.withColumn(f"_new_{name}", run_number(F.col(f"_sig_{name}"), entity, order))
    for name in levels:
        rows = rows.withColumn(name, F.sum(f"_new_{name}").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.drop(*[f"_sig_{n}" for n in levels], *[f"_new_{n}" for n in levels])


def version_history(versioned: DataFrame, entity: str, time: str, tie: str, core: str, full: str | None, state: list[str]) -> DataFrame:
    """A row per (entity, core version): first, last and next time, duration, gap, counts, last state, is_final."""
    last = F.max_by(F.struct(*state), F.struct(time, tie)).alias("_last")
    fulls = [F.countDistinct(full).alias("full_count")] if full else []
    out = versioned.groupBy(entity, core).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("obs_count"), *fulls, last)
    w = Window.partitionBy(entity).orderBy(core)
    out = out.withColumn("next_time", F.lead("first_time").over(w))
    return out.select(
        entity, core, "first_time", "last_time", "next_time", "obs_count", *(["full_count"] if full else []),
        days_between(F.col("last_time"), F.col("first_time")).alias("duration_days"),
        days_between(F.col("next_time"), F.col("last_time")).alias("gap_days"),
        F.col("next_time").isNull().cast("int").alias("is_final"),
        *[F.col("_last")[s].alias(s) for s in state],
    )


def final_versions(history: DataFrame) -> DataFrame:
    """V10."""
    return history.where("is_final = 1")


def change_events(states: DataFrame, entity: str, version: str, time: str, fields: list[str]) -> DataFrame:
    """V8, V9: one row per changed field between neighbouring versions; null to null is no change."""
    w = Window.partitionBy(entity).orderBy(version)
    old = F.lag(F.struct(F.col(version).alias("_v"), *fields)).over(w)
    rows = states.withColumn("_old", old).where("_old is not null")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col("_old")[f].cast("string").alias("old_value"), F.col(f).cast("string").alias("new_value")) for f in fields])
    rows = rows.select(entity, F.col("_old._v").alias("old_version"), F.col(version).alias("new_version"), F.col(time).alias("change_time"), F.explode(pairs).alias("x"))
    return rows.where("not (x.old_value <=> x.new_value)").select(entity, "old_version", "new_version", "change_time", "x.*")


def change_lists(states: DataFrame, entity: str, version: str, fields: list[str]) -> DataFrame:
    """V8: per version the names and the number of fields that differ from the version before, and a flag a field."""
    w = Window.partitionBy(entity).orderBy(version)
    old = F.lag(F.struct(*fields)).over(w)
    rows = states.withColumn("_old", old)
    differs = [F.col("_old").isNotNull() & ~F.col("_old")[f].eqNullSafe(F.col(f)) for f in fields]
    rows = rows.withColumn("changed", F.array_compact(F.array(*[F.when(d, F.lit(f)) for d, f in zip(differs, fields, strict=True)])))
    flags = [F.array_contains("changed", f).cast("int").alias(f"{f}_changed") for f in fields]
    return rows.select(entity, version, F.array_join("changed", ",").alias("changed_list"), F.size("changed").alias("changed_count"), *flags)


def multi_value_stats(rows: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """Per field how many entities had more than one value over time, and the largest number of values."""
    long = rows.unpivot([entity], fields, "field", "value")
    per = long.groupBy("field", entity).agg(F.countDistinct("value").alias("k"))
    return per.groupBy("field").agg(F.count_if(F.col("k") > 1).alias("entities"), F.max("k").alias("most"))


def version_summary(versioned: DataFrame, entity: str, core: str, full: str) -> DataFrame:
    """V12."""
    return versioned.groupBy(entity).agg(F.count("*").alias("obs_count"), F.max(core).alias("core_versions"), F.max(full).alias("full_versions"))


def reverted_versions(history: DataFrame, entity: str, version: str, state: list[str]) -> DataFrame:
    """Entities that return to an earlier state, with the versions that do."""
    w = Window.partitionBy(entity, *state).orderBy(version)
    again = history.withColumn("_nth", F.row_number().over(w)).where("_nth > 1")
    return again.groupBy(entity).agg(F.count("*").alias("repeats"), F.array_join(F.array_sort(F.collect_list(version)), ",").alias("revert_versions"))


def time_order_problems(history: DataFrame, entity: str, version: str) -> DataFrame:
    """Violations per rule; every rule's row is there, with 0 if it holds."""
    w = Window.partitionBy(entity).orderBy(version)
    rows = history.withColumns({
        "_next": F.lead(version).over(w),
        "_prev_last": F.lag("last_time").over(w),
        "_max": F.max(version).over(Window.partitionBy(entity)),
        "_n": F.count("*").over(Window.partitionBy(entity)),
    })
    rules = {
        "last before first": F.col("last_time") < F.col("first_time"),
        "next not after last": F.col("next_time") <= F.col("last_time"),
        "versions not contiguous": F.col("_next").isNotNull() & (F.col("_next") != F.col(version) + 1),
        "overlap with previous": F.col("_prev_last") >= F.col("first_time"),
        "count is not the last number": (F.col(version) == F.col("_max")) & (F.col("_n") != F.col("_max")),
        "final is not last": (F.col("is_final") == 1) != (F.col(version) == F.col("_max")),
        "final has a next": (F.col("is_final") == 1) & F.col("next_time").isNotNull(),
        "negative duration": F.col("duration_days") < 0,
    }
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer comparison of two derivations: rows on one side only and fields that differ."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), on, "full_outer")
    differs = [(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f) for f in fields]
    both = both.select("_l", "_r", *differs)
    return both.agg(F.count("*").alias("compared"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), *[F.count_if(f).alias(f"{f}_differs") for f in fields])


def first_last(rows: DataFrame, entity: str, order: list[str], field: str) -> DataFrame:
    """First and last non-null value per entity and the drift between them."""
    some = F.when(F.col(field).isNotNull(), F.struct(*order))
    out = rows.groupBy(entity).agg(F.min_by(field, some).alias("first_value"), F.max_by(field, some).alias("last_value"))
    return out.withColumn("drift", F.round(F.col("last_value") - F.col("first_value"), 6))
