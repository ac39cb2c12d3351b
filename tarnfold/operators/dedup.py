"""Grouping, membership relations and ranked survivorship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.exprs import count_map


def membership(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hits per combination; rows with a null key are left out."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("hits"))


def membership_sets(members: DataFrame, entity: str, group: str, item: str) -> DataFrame:
    """Sorted sets, distinct counts, hits and stable JSON counts per entity, in one aggregation of the relation."""
    rows = members.groupBy(entity).agg(F.collect_list(F.struct(group, item, "hits")).alias("_m"))
    rows = rows.withColumns({"_g": F.array_sort(F.array_distinct(F.col(f"_m.{group}"))), "_i": F.array_sort(F.array_distinct(F.col(f"_m.{item}")))})
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, m: s + m["hits"])
    pairs = F.transform("_g", lambda g: F.struct(g.alias(group), total(F.filter("_m", lambda m: m[group] == g)).alias("n")))
    return rows.select(
        entity, F.array_join("_g", "|").alias("groups"), F.array_join("_i", "|").alias("items"), F.size("_g").cast("long").alias("n_groups"),
        F.size("_i").cast("long").alias("n_items"), total(F.col("_m")).alias("hits"), count_map(pairs).alias("group_counts"),
    )


def conflict_summary(rows: DataFrame, entity: str, fields: list[str], key_fields: list[str]) -> DataFrame:
    """How many fields of an entity disagree, and whether a key field does, in one pass."""
    per = rows.groupBy(entity).agg(F.count("*").alias("records"), *[(F.countDistinct(f) > 1).cast("int").alias(f"_{f}") for f in fields])
    total = reduce(lambda a, b: a + b, [F.col(f"_{f}") for f in fields])
    keyed = F.greatest(*[F.col(f"_{f}") for f in key_fields]) if len(key_fields) > 1 else F.col(f"_{key_fields[0]}")
    return per.select(entity, "records", total.alias("conflict_fields"), keyed.alias("key_conflict"))


def survivors(rows: DataFrame, entity: str, levels: dict[str, Column], tie: list[str]) -> DataFrame:
    """The best row of an entity by levels, largest first and nulls last, then by `tie` ascending.

    `reason` is "single" for an entity of one row, else the first level at which the best row is alone, else "order".
    """
    names = list(levels)
    rows = rows.withColumns({f"_{n}": c for n, c in levels.items()})
    order = [F.col(f"_{n}").desc_nulls_last() for n in names]
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(entity).orderBy(*order, *tie)))
    rows = rows.withColumn("_size", F.count("*").over(Window.partitionBy(entity)))
    for i, n in enumerate(names):
        rows = rows.withColumn(f"_alone_{n}", F.count("*").over(Window.partitionBy(entity, *[f"_{x}" for x in names[: i + 1]])) == 1)
    best = rows.where("_rank = 1")
    reason = reduce(lambda rest, n: F.when(F.col(f"_alone_{n}"), F.lit(n)).otherwise(rest), reversed(names), F.lit("order"))
    best = best.withColumn("reason", F.when(F.col("_size") == 1, "single").otherwise(reason)).withColumn("records", F.col("_size"))
    return best.drop("_rank", "_size", *[f"_{n}" for n in names], *[f"_alone_{n}" for n in names])


def primary_item(members: DataFrame, entity: str, item: str) -> DataFrame:
    """The item with most hits, the first in order among equals."""
    w = Window.partitionBy(entity).orderBy(F.desc("hits"), item)
    return members.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def union_of_lists(rows: DataFrame, entity: str, lists: str) -> DataFrame:
    """The sorted distinct union of an entity's list cells."""
    return rows.select(entity, F.explode_outer(lists).alias("_x")).groupBy(entity).agg(F.array_sort(F.collect_set("_x")).alias(lists))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key of both sides; a new row wins a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def pending(tasks: DataFrame, done: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct tasks that no list of finished keys has."""
    finished = reduce(lambda a, b: a.union(b), [d.select(*keys) for d in done])
    return tasks.select(*keys).distinct().join(finished.distinct(), keys, "left_anti")
