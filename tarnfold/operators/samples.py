"""Entities, analysis samples, coverage tables and audits of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.exprs import trim_u
from tarnfold.operators import dedup, lifecycle, stats

#: The level of each education.
EDUCATION = {"不限": 0, "大专": 1, "本科": 2, "硕士": 3, "博士": 4}


def search_url(c: Column, allowed: list[str], host: str, path: str, page: Column | None = None, keep_page: bool = False) -> Column:
    """One form of a search's URL: its host and path, allowed parameters in their order, no first page, one encoding.

    Of a parameter that is given twice the last counts; empty ones go. `page` replaces the page; without it the page
    goes unless `keep_page`, and then if it is no number over 1.
    """
    t = trim_u(F.coalesce(c, F.lit("")))
    query = F.regexp_extract(F.regexp_replace(t, "#.*$", ""), r"\?(.*)$", 1)
    decoded = lambda x: trim_u(F.coalesce(F.try_url_decode(x), x))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(trim_u(F.substring_index(x, "=", 1)).alias("k"), decoded(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))

    def joined(of: Column) -> Column:
        out = []
        for name in allowed:
            value = F.try_element_at(_values(of, name), F.lit(-1))
            if name == "page":
                number = page if page is not None else value.try_cast("long") if keep_page else F.lit(None).cast("long")
                value = F.when(number > 1, number.cast("string"))
            out.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), F.url_encode(value))))
        return F.concat_ws("&", *out)

    scheme = F.lower(F.coalesce(F.nullif(F.regexp_extract(t, "(?i)^([a-z][a-z0-9+.-]*)://", 1), F.lit("")), F.lit("https")))
    netloc = F.lower(F.regexp_extract(t, "(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1))
    base = F.regexp_replace(F.lit(host), r"^www\.", "")
    kept = F.element_at(F.transform(F.array(pairs), joined), 1)
    out = F.concat(scheme, F.lit("://"), F.when(F.contains(netloc, base), netloc).otherwise(F.lit(host)), F.lit(path))
    return F.when(kept != "", F.concat(out, F.lit("?"), kept)).otherwise(out)


def _values(pairs: Column, name: str) -> Column:
    return F.transform(F.filter(pairs, lambda p: (p["k"] == name) & (p["v"] != "")), lambda p: p["v"])


def url_structure(rows: DataFrame, url: str) -> DataFrame:
    """Rows by scheme and host, how many of them have a fragment, and how many white space around."""
    u = F.coalesce(F.col(url), F.lit(""))
    scheme = F.lower(F.regexp_extract(u, "(?i)^([a-z][a-z0-9+.-]*):", 1))
    host = F.regexp_extract(u, "(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    return rows.groupBy(scheme.alias("scheme"), host.alias("host")).agg(F.count("*").alias("n"), F.count_if(u.rlike("#.")).alias("fragments"), F.count_if(u != trim_u(u)).alias("spaced"))


def localized(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed; a name that isn't there is an error."""
    if missing := sorted(set(names) - set(rows.columns)):
        raise ValueError(f"no columns {', '.join(missing)}")
    return rows.withColumnsRenamed(names)


def blanks_to_null(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """`rows` with null for blank texts, other texts as they are, and (field, blanks, nulls) before the change."""
    counts = [F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).isNotNull() & (trim_u(F.col(c)) == "")).alias("blanks"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns]
    report = rows.agg(F.array(*counts).alias("x")).select(F.inline("x"))
    return rows.withColumns({c: F.when(trim_u(F.col(c)) != "", F.col(c)) for c in columns}), report


def repair_report(before: DataFrame, after: DataFrame, key: str, fields: list[str], audited: DataFrame, residual: Column) -> DataFrame:
    """One row of what must hold after a repair of `fields`: rows as before, audited rows alone changed, in those fields.

    `audited` has the keys of the repaired rows, `residual` says of a row after it that it is still odd.
    """
    others = [c for c in before.columns if c not in (key, *fields)]
    a = before.select(key, F.struct(*fields).alias("_old"), F.struct(*others).alias("_was") if others else F.lit(0).alias("_was"))
    b = after.select(key, F.struct(*fields).alias("_new"), F.struct(*others).alias("_is") if others else F.lit(0).alias("_is"), F.coalesce(residual, F.lit(False)).alias("_odd"))
    both = a.join(b, key, "full_outer").join(audited.select(key).distinct().withColumn("_audited", F.lit(True)), key, "left")
    one_side = F.col("_old").isNull() | F.col("_new").isNull()
    differs = ~one_side & ~F.col("_old").eqNullSafe(F.col("_new"))
    touched = F.coalesce("_audited", F.lit(False))
    out = both.agg(
        F.count_if(one_side).alias("rows_differ"), F.count_if("_odd").alias("residual"), F.count_if(differs & ~touched).alias("untouched_changed"),
        F.count_if(~one_side & ~F.col("_was").eqNullSafe(F.col("_is"))).alias("others_changed"), F.count_if(touched & ~differs).alias("audited_unchanged"),
    )
    return out.withColumn("passes", (F.greatest("rows_differ", "residual", "untouched_changed", "others_changed", "audited_unchanged") == 0).cast("int"))


def unique_hints(rows: DataFrame, entity: str, field: str, key: str, lost: Column) -> DataFrame:
    """C11: per entity with lost values: how many, the one value that its other rows have, and the first row that has it."""
    filled = ~lost & (trim_u(F.coalesce(F.col(field), F.lit(""))) != "")
    value = F.when(filled, trim_u(F.col(field)))
    out = rows.groupBy(entity).agg(F.count_if(lost).alias("lost"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.min(F.when(filled, F.col(key))).alias("_first")).where("lost > 0")
    one = F.col("_lo") == F.col("_hi")
    basis = F.when(F.col("_lo").isNull(), "none").when(one, "unique").otherwise("several")
    return out.select(entity, "lost", F.when(one, F.col("_lo")).alias("value"), F.when(one, F.col("_first")).alias("example"), basis.alias("basis"))


def token_audit(rows: DataFrame, key: str, tokens: Column, known: list[str]) -> DataFrame:
    """C14: tokens with rows, the first row that has one, and whether the vocabulary lacks it."""
    long = rows.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    out = long.groupBy("token").agg(F.count("*").alias("n"), F.min(key).alias("example"))
    return out.withColumn("unknown", (~F.col("token").isin(*known)).cast("int"))


def token_combinations(rows: DataFrame, tokens: Column) -> DataFrame:
    """C14: the sets of tokens, in order, with their rows."""
    return rows.groupBy(F.array_join(F.array_sort(F.array_distinct(tokens)), "+").alias("combination")).agg(F.count("*").alias("n"))


def simple_range(c: Column, unit: str = "/天") -> dict[str, Column]:
    """C17: both ends of a range a-b, or a lone whole number twice."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit(unit), F.lit(""))
    number = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit("")).cast("double")
    one = number(r"^(\d+)$", 1)
    return {"low": F.coalesce(number(r"(\d+)-(\d+)", 1), one), "high": F.coalesce(number(r"(\d+)-(\d+)", 2), one)}


def ordinal(c: Column, levels: dict[str, int] = EDUCATION) -> Column:
    """The level of a name; null for others."""
    return F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])[trim_u(c)]


def class_breaks(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.45, 0.70, 0.85, 0.95)) -> DataFrame:
    """`rows` plus class: 0 for nothing, else by breaks at quantiles of the positive values, rounded up, equal ones once."""
    positive = F.when(F.col(value) > 0, F.col(value))
    cuts = rows.agg(F.percentile(positive, list(shares)).alias("_q"))
    cuts = cuts.select(F.array_sort(F.array_distinct(F.filter(F.transform("_q", lambda x: F.ceil(x)), lambda x: x > 1))).alias("_cuts"))
    at = F.size(F.filter("_cuts", lambda x: x <= F.col(value))) + 1
    return rows.crossJoin(F.broadcast(cuts)).withColumn("class", F.when(F.col(value) > 0, at).otherwise(0)).drop("_cuts")


def assembled(base: DataFrame, key: str, sides: list[DataFrame]) -> DataFrame:
    """The representative rows with left joins on the entity; a side that has a key twice is an error when it is run."""
    def once(side: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return side.withColumn(key, F.when(n > 1, F.raise_error(F.concat(F.lit("several rows of "), F.col(key).cast("string")))).otherwise(F.col(key)))

    return reduce(lambda a, side: a.join(once(side), key, "left"), sides, base)


def latest_entities(versioned: DataFrame, entity: str, version: str, levels: dict[str, Column], tie: list[str]) -> DataFrame:
    """Of each entity's rows of its last version the best one."""
    last = versioned.withColumn("_last", F.max(version).over(Window.partitionBy(entity))).where(F.col(version) == F.col("_last")).drop("_last")
    return dedup.survivors(last, entity, levels, tie)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, to be none."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def trim_sensitivity(intervals: DataFrame, start: str, end: str, share: float = 0.99) -> DataFrame:
    """The daily series with all intervals and without the longest, their sums, means and largest, and Spearman's rho."""
    rows = intervals.withColumn("_len", F.datediff(end, start) + 1).where("_len >= 1")
    cut = rows.agg(F.percentile("_len", share).alias("_cut"))
    kept = rows.crossJoin(F.broadcast(cut)).where("_len <= _cut")
    a = lifecycle.active_series(rows, start, end).select("day", F.col("active").alias("a"))
    b = lifecycle.active_series(kept, start, end).select("day", F.col("active").alias("b"))
    both = a.join(b, "day", "left").na.fill(0, ["b"])
    rho = stats.spearman(both, "a", "b").select("rho")
    sums = both.agg(F.count("*").alias("days"), F.sum("a").alias("all_days"), F.sum("b").alias("kept_days"), F.max("a").alias("all_most"), F.max("b").alias("kept_most"))
    return sums.crossJoin(rho).crossJoin(cut.select(F.round("_cut", 1).alias("cutoff")))


def with_episodes(assigned: DataFrame, entity: str, number: str, start: str, end: str) -> DataFrame:
    """Every segment with its episode's span, number of segments and place in it, over one sort."""
    w = Window.partitionBy(entity, number)
    nth = F.row_number().over(w.orderBy(start, end))
    return assigned.withColumns({"episode_start": F.min(start).over(w), "episode_end": F.max(end).over(w), "segments": F.count("*").over(w), "nth": nth})


def leakage_audit(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Each field with what is known of its time (`before`, `after` or `unknown`), its filled rows, and whether it may be used."""
    parts = [F.struct(F.lit(f).alias("field"), F.lit(when).alias("known"), F.count(f).alias("filled"), F.lit(int(when == "before")).alias("usable")) for f, when in fields.items()]
    return rows.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def valid_target(mid: Column, status: Column, negotiable: Column, anomaly: Column) -> Column:
    """M1: a target that was parsed, isn't open, isn't missing and has no anomaly."""
    return F.coalesce((negotiable == 0) & (status == "已解析") & mid.isNotNull() & (trim_u(F.coalesce(anomaly, F.lit(""))) == ""), F.lit(False))


def sample_funnel(rows: DataFrame, status: str, negotiable: str, anomaly: str) -> DataFrame:
    """M3: the steps from all rows to the sample, and whether they add up."""
    odd = trim_u(F.coalesce(F.col(anomaly), F.lit(""))) != ""
    one = rows.agg(F.count("*").alias("total"), F.count_if(F.col(negotiable) == 1).alias("negotiable"), F.count_if(F.col(status) == "已解析").alias("_parsed"), F.count_if(odd).alias("anomalous"))
    one = one.withColumns({"unparsed": F.col("total") - F.col("negotiable") - F.col("_parsed"), "sample": F.col("_parsed") - F.col("anomalous")})
    adds = F.col("sample") + F.col("negotiable") + F.col("anomalous") + F.col("unparsed") == F.col("total")
    return one.select("total", "negotiable", "unparsed", "anomalous", "sample", adds.cast("int").alias("adds_up"))


def level_coverage(rows: DataFrame, fields: list[str], thresholds: tuple[int, ...]) -> DataFrame:
    """M5: per field and threshold the levels with so many rows, all levels, and the share of filled rows that they cover."""
    counts = rows.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], fields, "field", "level").where("level is not null").groupBy("field", "level").agg(F.count("*").alias("n"))
    grid = counts.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    big = F.col("n") >= F.col("threshold")
    out = grid.groupBy("field", "threshold").agg(F.count("*").alias("levels"), F.count_if(big).alias("kept"), F.sum("n").alias("_all"), F.sum(F.when(big, F.col("n")).otherwise(0)).alias("_kept"))
    return out.select("field", "threshold", "levels", "kept", F.round(F.col("_kept") / F.col("_all"), 6).alias("covered"))


def frequent_items(members: DataFrame, entity: str, item: str, train: DataFrame, least: int) -> DataFrame:
    """Items that at least `least` training entities have, with how many do."""
    n = members.join(train.select(entity).distinct(), entity, "left_semi").groupBy(item).agg(F.countDistinct(entity).alias("n"))
    return n.where(F.col("n") >= least)


def with_vectors(rows: DataFrame, key: str, vectors: DataFrame, vector: str, width: int, order: str) -> DataFrame:
    """Each row's vector, that of the last row by `order` where a key has several, zeros where it has none."""
    last = vectors.groupBy(key).agg(F.max_by(vector, order).alias(vector))
    kind = dict(vectors.dtypes)[vector]
    zeros = F.array_repeat(F.lit(0.0), width).cast(kind)
    return rows.join(last, key, "left").withColumns({"found": F.col(vector).isNotNull().cast("int"), vector: F.coalesce(vector, zeros)})


def pairwise_tests(rows: DataFrame, group: str, value: str, top: int = 8, least: int = 1) -> DataFrame:
    """Mann-Whitney, Cliff's delta and effect for each pair of the `top` groups by median, ranks within the pair.

    Pairs are made of the few chosen groups; a row takes part in `top` - 1 of them.
    """
    some = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    per = some.groupBy(group).agg(F.count("*").alias("_n"), F.percentile(value, 0.5).alias("_m")).where(F.col("_n") >= least)
    chosen = per.orderBy(F.desc("_m"), group).limit(top).select(F.col(group).alias("_g"), "_m")
    a, b = chosen.select(F.col("_g").alias("a"), F.col("_m").alias("_ma")), chosen.select(F.col("_g").alias("b"), F.col("_m").alias("_mb"))
    pairs = a.join(b, (F.col("_ma") > F.col("_mb")) | ((F.col("_ma") == F.col("_mb")) & (F.col("a") < F.col("b"))))
    long = some.join(F.broadcast(pairs.select("a", "b")), (F.col(group) == F.col("a")) | (F.col(group) == F.col("b")))
    out = stats.mann_whitney(long, F.col(group) == F.col("a"), value, "a", "b")
    return out.withColumn("effect", stats.effect_label(F.col("delta")))


def sample_overview(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Named counts of one pass, a row each."""
    return rows.agg(F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("long").alias("value")) for n, c in counts.items()]).alias("x")).select(F.inline("x"))


def quartile_association(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Kruskal-Wallis of `y` over the quartile bins of positive `x`, and Spearman's rho of both."""
    rows = rows.where((F.col(x) > 0) & F.col(y).isNotNull()).select(x, y)
    h = stats.kruskal_wallis(stats.quantile_bins(rows, x, 4, "_bin"), "_bin", y)
    return h.crossJoin(stats.spearman(rows, x, y).select("rho"))


def identity_stats(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Q4: rows, filled, missing, blank and distinct values of identity fields."""
    parts = [F.struct(F.lit(f).alias("field"), F.count("*").alias("rows"), F.count(f).alias("filled"), F.count_if(F.col(f).isNull()).alias("missing"), F.count_if(trim_u(F.col(f).cast("string")) == "").alias("blank"), F.countDistinct(f).alias("kinds")) for f in fields]
    return rows.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def list_profile(rows: DataFrame, lists: Column) -> DataFrame:
    """Q12: rows by how they fill a list field, its lengths, and how many distinct items it has."""
    rows = rows.select(lists.alias("x")).withColumn("k", F.size(F.coalesce("x", F.array().cast("array<string>"))))
    kinds = rows.select(F.explode("x").alias("item")).agg(F.countDistinct("item").alias("items"))
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("x").isNull()).alias("missing"), F.count_if(F.col("x").isNotNull() & (F.col("k") == 0)).alias("empty"), F.max("k").alias("most"), F.round(F.avg(F.when(F.col("k") > 0, F.col("k"))), 6).alias("mean"), F.expr("percentile(if(k > 0, k, null), 0.5)").alias("median"))
    return sizes.crossJoin(kinds)
