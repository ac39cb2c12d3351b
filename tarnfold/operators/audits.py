"""Audits of mappings, tags, text changes, samples and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mapping_conflicts(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs of which a side has several partners, labelled: 'both', 'left to many' or 'right to many'.

    A pair with both faults is 'both'. Nulls take no part.
    """
    pairs = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right).distinct()
    many = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c, F.lit(True).alias(f"_{c}"))
    out = pairs.join(many(left), left, "left").join(many(right), right, "left")
    label = F.when(F.col(f"_{left}") & F.col(f"_{right}"), "both").when(F.col(f"_{left}"), "left to many").when(F.col(f"_{right}"), "right to many")
    return out.select(left, right, label.alias("conflict")).where("conflict is not null")


def vocabulary(rows: DataFrame, column: str, separators: str) -> DataFrame:
    """Distinct trimmed non-empty parts of a multi-valued column with the number of rows that hold each."""
    parts = F.array_distinct(F.transform(F.split(column, separators), lambda x: F.trim(x)))
    return rows.select(F.explode(parts).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n_rows"))


def link_tokens(c: Column) -> Column:
    """Tokens of a list in loose notation: all web addresses in it, else the non-empty parts between commas, semicolons, bars."""
    links = F.regexp_extract_all(c, F.lit(r"""(https?://[^\s"',;|\]]+)"""), F.lit(1))
    parts = F.filter(F.transform(F.split(c, r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.size(links) > 0, links).otherwise(parts)


def mapped_tags(tokens: Column, tags: dict[str, str]) -> Column:
    """Tags of file names at the end of tokens, once each, in the order of `tags`; unknown names give none."""
    names = F.transform(tokens, lambda x: F.regexp_extract(x, r"([^/?#]+)\.[A-Za-z]+(?:[?#].*)?$", 1))
    found = [F.when(F.array_contains(names, name), F.lit(tag)) for name, tag in tags.items()]
    return F.array_distinct(F.array_compact(F.array(*found)))


def exclusive_class(tags: Column, first: str, second: str) -> Column:
    """One of four classes that exclude each other: both, only one of two tags, or neither."""
    a, b = F.array_contains(tags, first), F.array_contains(tags, second)
    return F.when(a & b, "both").when(a, f"only {first}").when(b, f"only {second}").otherwise("neither")


def hit_rate_by_month(rows: DataFrame, time: str, hit: Column) -> DataFrame:
    """Rows, hits and their share in every month between the first and the last; a month without rows has 0, 0 and null."""
    found = rows.groupBy(F.trunc(time, "month").alias("month")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    ends = found.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    out = months.join(found, "month", "left").fillna(0, ["n", "hits"])
    return out.withColumn("share", F.when(F.col("n") > 0, F.round(F.col("hits") / F.col("n"), 8)))


def safe_time_features(rows: DataFrame, entity: str, time: str, tie: str) -> DataFrame:
    """Features known when a row is published: month, day of the week (Monday 0), days since the row before, rows before."""
    w = Window.partitionBy(entity).orderBy(time, tie)
    gap = F.datediff(time, F.lag(time).over(w)).cast("long")
    return rows.select(tie, F.month(time).cast("long").alias("month"), F.weekday(time).cast("long").alias("weekday"), gap.alias("gap_days"), (F.row_number().over(w) - 1).cast("long").alias("rows_before"))


def encode_once(rows: DataFrame, text: str, encode, cache: DataFrame | None = None) -> DataFrame:
    """`rows` plus text_hash and vector: each distinct non-empty text is encoded once, unless `cache` has its hash.

    `encode` maps (text_hash, text) to (text_hash, vector); `cache` has the same columns. Empty texts have no vector.
    """
    rows = rows.withColumn("text_hash", F.when(F.trim(text) != "", F.sha2(F.col(text), 256)))
    todo = rows.where("text_hash is not null").groupBy("text_hash").agg(F.min(text).alias("text"))
    if cache is not None:
        todo = todo.join(cache, "text_hash", "left_anti")
    vectors = encode(todo)
    if cache is not None:
        vectors = vectors.unionByName(cache)
    return rows.join(vectors, "text_hash", "left")


def truncation(rows: DataFrame, length: Column, limits: list[int], *by: str) -> DataFrame:
    """Per group and limit: rows, rows longer than the limit, and the share of all length that lies beyond it."""
    one = rows.select(*by, length.alias("length")).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("length").alias("total"), *(F.count_if(F.col("length") > m).alias(f"over{m}") for m in limits), *(F.sum(F.greatest(F.col("length") - m, F.lit(0))).alias(f"cut{m}") for m in limits)
    )
    cells = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("limit"), F.col(f"over{m}").alias("n_over"), F.col(f"cut{m}").alias("cut")) for m in limits)))
    return one.select(*by, "n", "total", cells.alias("x")).select(*by, "x.limit", "n", "x.n_over", F.round(F.col("x.cut") / F.col("total"), 8).alias("cut_share"))


def text_changes(rows: DataFrame, entity: list[str], order: str, tokens: Column) -> DataFrame:
    """Of each row and the one before it of its entity: lengths, rate of change, terms added, removed, and their Jaccard.

    An entity is one window: its history should be bounded. A row with null tokens has null counts, and the one after it drops out.
    """
    w = Window.partitionBy(*entity).orderBy(order)
    rows = rows.select(order, F.array_distinct(tokens).alias("now"), *entity).withColumn("was", F.lag("now").over(w)).where("was is not null")
    both, either = F.size(F.array_intersect("now", "was")), F.size(F.array_union("now", "was"))
    out = rows.select(order, F.size("was").cast("long").alias("n_was"), F.size("now").cast("long").alias("n_now"), both.cast("long").alias("n_both"), either.cast("long").alias("n_either"))
    rate = F.when(F.col("n_was") > 0, F.round((F.col("n_now") - F.col("n_was")) / F.col("n_was"), 8))
    share = F.when(F.col("n_either") > 0, F.round(F.col("n_both") / F.col("n_either"), 8))
    added, removed = F.col("n_now") - F.col("n_both"), F.col("n_was") - F.col("n_both")
    return out.select(order, "n_was", "n_now", added.alias("added"), removed.alias("removed"), rate.alias("rate"), share.alias("jaccard"))


def classified(rules: list[tuple[str, Column]], default: str) -> Column:
    """The label of the first rule that holds; a rule that is null doesn't."""
    return reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules), F.lit(default))


def nearest_to_quantiles(rows: DataFrame, value: str, key: str, quantiles: list[float], k: int) -> DataFrame:
    """For each quantile the k rows whose value is nearest to it, ties by key: a sample to review."""
    at = rows.agg(F.percentile(value, F.array(*map(F.lit, quantiles)))).first()[0] or []
    cuts = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(x).alias("at")) for q, x in zip(quantiles, at, strict=False)))
    if not at:
        return rows.select(F.lit(0.0).alias("q"), key, F.lit(0).cast("long").alias("nth")).limit(0)
    near = rows.where(F.col(value).isNotNull()).select(key, value, F.explode(cuts).alias("x")).select("x.q", key, F.abs(F.col(value) - F.col("x.at")).alias("distance"))
    # Spark keeps the first k of each window before the shuffle.
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("distance", key))).where(F.col("nth") <= k)
    return near.select("q", key, F.col("nth").cast("long").alias("nth"))


def first_stratum_sample(rows: DataFrame, strata: list[tuple[str, Column]], key: str, k: int) -> DataFrame:
    """At most k rows of each stratum by hash of the key; a row belongs to the first stratum that takes it."""
    rows = rows.withColumn("stratum", classified(strata, "")).where("stratum <> ''")
    order = Window.partitionBy("stratum").orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.select("stratum", key).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("stratum", key, F.col("nth").cast("long").alias("nth"))


def median_difference_within(rows: DataFrame, flag: Column, value: str, category: str, least: int = 10) -> DataFrame:
    """Per category with `least` rows on either side: medians of flagged and other rows and their difference."""
    one = rows.where(F.col(value).isNotNull()).withColumn("_f", flag).groupBy(category).agg(
        F.count_if("_f").alias("n_with"), F.count_if(~F.col("_f")).alias("n_without"),
        F.percentile(F.when(F.col("_f"), F.col(value)), F.lit(0.5)).alias("a"), F.percentile(F.when(~F.col("_f"), F.col(value)), F.lit(0.5)).alias("b"),
    )
    return one.where((F.col("n_with") >= least) & (F.col("n_without") >= least)).select(category, "n_with", "n_without", F.round(F.col("a") - F.col("b"), 4).alias("difference"))


def rank_overlap(rows: DataFrame, item: str, a: Column, b: Column, tops: list[int]) -> DataFrame:
    """How many items stand among the first k of two rankings at once, for each k."""
    place = lambda c, name: rows.select(item, c.alias("_v")).orderBy(F.desc("_v"), item).limit(max(tops)).select(item, F.row_number().over(Window.orderBy(F.desc("_v"), item)).alias(name))
    ranked = place(a, "ra").join(place(b, "rb"), item)
    one = ranked.agg(*(F.count_if((F.col("ra") <= k) & (F.col("rb") <= k)).alias(f"k{k}") for k in tops))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("top"), F.col(f"k{k}").alias("shared")) for k in tops))).alias("x")).select("x.*")


def tag_overlap(members: DataFrame, entity: str, tag: str, top: int) -> DataFrame:
    """Pairs of the `top` most frequent tags: entities with both, with either, and their Jaccard."""
    members = members.select(entity, tag).distinct()
    counts = members.groupBy(tag).agg(F.count("*").alias("n")).orderBy(F.desc("n"), tag).limit(top)
    sets = members.join(F.broadcast(counts.select(tag)), tag).groupBy(entity).agg(F.array_sort(F.collect_set(tag)).alias("s"))
    # At most `top` tags an entity, so the pairs of one row are bounded.
    pairs = sets.groupBy("s").agg(F.count("*").alias("w")).select("w", F.col("s"), F.explode("s").alias("a")).select("w", "a", F.explode(F.expr("filter(s, x -> x > a)")).alias("b"))
    both = pairs.groupBy("a", "b").agg(F.sum("w").alias("n_both"))
    sized = lambda c: F.broadcast(counts.select(F.col(tag).alias(c), F.col("n").alias(f"n_{c}")))
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return both.join(sized("a"), "a").join(sized("b"), "b").select("a", "b", "n_both", either.alias("n_either"), F.round(F.col("n_both") / either, 8).alias("jaccard"))


def column_shares(rows: DataFrame, group: Column, category: str) -> DataFrame:
    """Share of each category within the rows of each group, and rows: how two selections differ."""
    counts = rows.groupBy(group.alias("part"), category).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("part")), 8))


def extremes(rows: DataFrame, value: str, key: str, k: int, verdict: Column) -> DataFrame:
    """The k rows with the least and the k with the largest value, ties by key, each with a verdict."""
    rows = rows.where(F.col(value).isNotNull())
    low, high = rows.orderBy(value, key).limit(k), rows.orderBy(F.desc(value), key).limit(k)
    both = low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))
    return both.select("side", key, value, verdict.alias("verdict"))
