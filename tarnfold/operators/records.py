"""URLs, slot repair, structured parsing and organisations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.exprs import safe_ratio, trim_u

#: Query parameters that only track where a visit came from.
TRACKING = ("pcm", "from", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "ref", "referer", "share_token")


def normalize_url(c: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Lower-case scheme and host, https by default, no tracking parameters, no fragment; empty for nothing."""

    def parts(u: Column) -> Column:
        scheme = F.lower(F.coalesce(F.nullif(F.regexp_extract(u, "(?i)^([a-z][a-z0-9+.-]*):", 1), F.lit("")), F.lit("https")))
        host = F.lower(F.regexp_extract(u, "(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?]*)", 1))
        path = F.regexp_extract(u, "(?i)^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?]*)?([^?]*)", 1)
        return F.struct(scheme.alias("scheme"), host.alias("host"), path.alias("path"), F.regexp_extract(u, r"\?(.*)$", 1).alias("query"))

    def joined(p: Column) -> Column:
        kept = F.array_join(F.filter(F.split(p["query"], "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(*tracking)), "&")
        return F.concat(p["scheme"], F.lit(":"), F.when(p["host"] != "", F.concat(F.lit("//"), p["host"])).otherwise(""), p["path"], F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))

    # Each step is bound to a variable, so that no pattern runs twice a row.
    trimmed = F.array(F.regexp_replace(trim_u(F.coalesce(c, F.lit(""))), "#.*$", ""))
    out = F.transform(F.transform(trimmed, lambda u: F.when(u != "", parts(u))), lambda p: F.coalesce(joined(p), F.lit("")))
    return F.element_at(out, 1)


def last_segment(url: Column) -> Column:
    """U4: the last segment of the path."""
    return F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)/?$", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"\?(.*)$", 1)


def absolute_url(c: Column, base: str) -> Column:
    """Absolute, without query and fragment."""
    u = F.regexp_replace(trim_u(c), "[?#].*$", "")
    return F.when(u.rlike("^//"), F.concat(F.lit("https:"), u)).when(u.rlike("^/"), F.concat(F.lit(base), u)).otherwise(u)


def mapping_audit(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs, and how many values of a side have several on the other."""
    pairs = rows.select(left, right).dropna().distinct()
    a = pairs.groupBy(left).agg(F.count("*").alias("k")).agg(F.count("*").alias("lefts"), F.count_if(F.col("k") > 1).alias("left_to_many"), F.max("k").alias("most_right"))
    b = pairs.groupBy(right).agg(F.count("*").alias("k")).agg(F.count("*").alias("rights"), F.count_if(F.col("k") > 1).alias("right_to_many"), F.max("k").alias("most_left"))
    return a.crossJoin(b)


def parse_pay(c: Column, units: tuple[str, ...] = ("/天", "/日"), open_: tuple[str, ...] = ("面议", "薪资面议")) -> dict[str, Column]:
    """Low, high, middle, span, status, open flag and anomalies of a pay text such as 150-300/天.

    A text with one of the words `open_` is open; else its first two numbers count if it has one of the units.
    """
    t = trim_u(F.coalesce(c, F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    body = reduce(lambda x, u: F.replace(x, F.lit(u), F.lit("")), units, t)
    n = F.regexp_extract_all(body, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    negotiable = has(open_)
    ok = ~negotiable & has(units) & (F.size(n) > 0)
    low = F.when(ok, F.get(n, F.lit(0)).try_cast("double"))
    high = F.when(ok, F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(0))).try_cast("double"))
    odd = F.concat_ws("；", F.when(low > high, "上下限倒置"), F.when(low <= 0, "下限非正数"), F.when(high <= 0, "上限非正数"))
    return {"low": low, "high": high, "mid": (low + high) / 2, "span": high - low, "status": F.when(ok, "已解析").when(negotiable, "面议").otherwise("解析失败"), "negotiable": negotiable.cast("int"), "anomaly": odd}


def shape(c: Column) -> Column:
    """Digits as #."""
    return F.regexp_replace(c, "[0-9]+", "#")


def parse_scale(c: Column, bounds: tuple[int, ...] = (15, 50, 150, 500, 2000)) -> dict[str, Column]:
    """Low, high, middle and level of a head count such as 15-50人, 少于15人 or 2000人以上."""
    t = trim_u(F.coalesce(c, F.lit("")))
    between, under, over = r"^(\d+)\s*[-~]\s*(\d+)\s*人?$", r"^(?:少于|<)\s*(\d+)\s*人?$", r"^(\d+)\s*人?(?:以上|\+)$"
    num = lambda p, g: F.regexp_extract(t, p, g).try_cast("double")
    low = F.when(t.rlike(between), num(between, 1)).when(t.rlike(under), 0.0).when(t.rlike(over), num(over, 1))
    high = F.when(t.rlike(between), num(between, 2)).when(t.rlike(under), num(under, 1))
    mid = (low + high) / 2
    level = F.when(t.rlike(over) & (low >= bounds[-1]), len(bounds) + 1).when(t.rlike(under), 1).when(mid.isNotNull(), 1 + sum(((mid >= b).cast("int") for b in bounds), F.lit(0)))
    return {"low": low, "high": high, "mid": mid, "level": level, "known": (low.isNotNull()).cast("int")}


def normalize_city(c: Column) -> Column:
    """The first city of a list, without province and 市."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,，、;；|]"), lambda x: trim_u(x)), lambda x: x != "")
    one = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    one = F.regexp_replace(F.regexp_replace(one, r"^.*[/·-]\s*", ""), "^.*?(?:省|自治区)(.+)$", "$1")
    return F.regexp_replace(one, "市$", "")


def first_integer(c: Column, default: int | None = None) -> Column:
    """C18, P5."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(default).cast("int"))


def repair_slots(rows: DataFrame, nature: str, size: str, place: str, scale: str = r"^\d+-\d+人|人以上|^少于") -> DataFrame:
    """Three slots whose values slid one to the left: the class of the anomaly and the repaired values.

    FULL_SHIFT moves both, NATURE_ONLY the first, SIZE_ONLY the second; with the third slot filled nothing is repaired.
    """
    n, s, p = (trim_u(F.coalesce(F.col(x), F.lit(""))) for x in (nature, size, place))
    n_bad, s_bad = n.rlike(scale), (s != "") & ~s.rlike(scale)
    kind = F.when((n_bad | s_bad) & (p != ""), "NOT_REPAIRABLE").when(n_bad & s_bad, "FULL_SHIFT").when(n_bad, "NATURE_ONLY").when(s_bad, "SIZE_ONLY").otherwise("NONE")
    move_n, move_s = F.col("anomaly").isin("FULL_SHIFT", "NATURE_ONLY"), F.col("anomaly").isin("FULL_SHIFT", "SIZE_ONLY")
    out = rows.withColumn("anomaly", kind)
    return out.select(
        *[c for c in rows.columns if c not in (nature, size, place)], "anomaly",
        F.when(move_n, None).otherwise(F.col(nature)).alias(nature),
        F.when(move_n, F.col(nature)).when(move_s, None).otherwise(F.col(size)).alias(size),
        F.when(move_s, F.col(size)).otherwise(F.col(place)).alias(place),
    )


def half_width(c: Column) -> Column:
    """Full-width ASCII as plain ASCII, the wide blank as a blank."""
    wide = "".join(chr(i + 0xFEE0) for i in range(0x21, 0x7F)) + "　"
    return F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


def normalize_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(half_width(c), r"(?U)\s+", ""))


def fingerprint(c: Column) -> Column:
    """E2."""
    return F.substring(F.sha1(F.regexp_replace(c, r"(?U)\s+", "")), 1, 16)


def resolve_names(rows: DataFrame, name: str, place: str, profile: str, aliases: DataFrame | None = None) -> DataFrame:
    """One row a (name, place): method, confidence and whether it is formal, by a waterfall.

    No name: UNRESOLVED. An approved alias. A name in several places: MULTI_LOCATION_AMBIGUOUS. Names that share a
    profile: HIGH_CONFIDENCE_MATCH. Else EXACT_NORMALIZED_NAME, which with the alias is the only formal method.
    """
    rows = rows.withColumn("norm", normalize_name(F.coalesce(F.col(name), F.lit(""))))
    filled = F.when(trim_u(F.col(place).cast("string")) != "", F.col(place))
    places = rows.groupBy("norm").agg(F.countDistinct(filled).alias("places"))
    shared = rows.where("norm <> ''").withColumn("print", fingerprint(F.col(profile))).where("print is not null").groupBy("print").agg(F.countDistinct("norm").alias("k")).where("k > 1")
    sharing = rows.withColumn("print", fingerprint(F.col(profile))).join(shared, "print", "left_semi").select("norm").distinct().withColumn("shares", F.lit(True))
    out = rows.groupBy("norm", F.coalesce(F.col(place).cast("string"), F.lit("")).alias("place")).agg(F.count("*").alias("rows"))
    out = out.join(places, "norm").join(sharing, "norm", "left")
    out = out.join(aliases.select(normalize_name(F.col("alias")).alias("norm"), "canonical").dropDuplicates(["norm"]), "norm", "left") if aliases is not None else out.withColumn("canonical", F.lit(None).cast("string"))
    method = F.when(F.col("norm") == "", "UNRESOLVED").when(F.col("canonical").isNotNull(), "APPROVED_ALIAS").when(F.col("places") > 1, "MULTI_LOCATION_AMBIGUOUS").when(F.col("shares"), "HIGH_CONFIDENCE_MATCH").otherwise("EXACT_NORMALIZED_NAME")
    out = out.withColumn("method", method)
    confidence = F.when(F.col("method") == "UNRESOLVED", 0.0).when(F.col("method") == "MULTI_LOCATION_AMBIGUOUS", 0.7).when(F.col("method") == "HIGH_CONFIDENCE_MATCH", 0.9).when(F.col("method") == "APPROVED_ALIAS", 0.95).otherwise(1.0)
    return out.select("norm", "place", "rows", F.coalesce("canonical", "norm").alias("entity"), "method", confidence.alias("confidence"), F.col("method").isin("APPROVED_ALIAS", "EXACT_NORMALIZED_NAME").cast("int").alias("formal"))


def profile_snapshots(rows: DataFrame, entity: str, time: str, profile: str, job: str) -> DataFrame:
    """Per (entity, time) the profile with most support, the first in order among equals, and how sure that is."""
    support = rows.withColumn("_p", F.when(trim_u(F.col(profile)) != "", F.col(profile))).groupBy(entity, time, "_p").agg(F.countDistinct(job).alias("support"))
    best = F.max_by(F.struct("_p", "support"), F.struct(F.col("_p").isNotNull(), F.col("support"), (-F.xxhash64("_p"))))
    out = support.groupBy(entity, time).agg(best.alias("b"), F.count("_p").alias("candidates"), F.sum(F.when(F.col("_p").isNotNull(), F.col("support"))).alias("total"))
    state = F.when(F.col("candidates") == 0, "MISSING").when(F.col("candidates") == 1, "CONSISTENT").otherwise("AMBIGUOUS")
    return out.select(entity, time, state.alias("state"), "candidates", F.when(F.col("candidates") > 0, F.col("b.support")).alias("support"), F.round(safe_ratio(F.when(F.col("candidates") > 0, F.col("b.support")), F.col("total")), 6).alias("rate"), F.when(F.col("candidates") == 1, F.col("b._p")).alias("profile"))


def crossed_snapshots(snapshots: DataFrame, entity: str, time: str) -> DataFrame:
    """Changes between consistent profiles and the ambiguous snapshots between them.

    Instead of a range join a running count of ambiguous snapshots is taken at both ends.
    """
    w = Window.partitionBy(entity).orderBy(time)
    rows = snapshots.withColumn("seen", F.sum((F.col("state") == "AMBIGUOUS").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    some = rows.where("state = 'CONSISTENT'")
    some = some.withColumns({"old_profile": F.lag("profile").over(w), "old_time": F.lag(time).over(w), "was": F.lag("seen").over(w)})
    return some.where("old_profile is not null and old_profile <> profile").select(entity, "old_time", F.col(time).alias("new_time"), "old_profile", F.col("profile").alias("new_profile"), (F.col("seen") - F.col("was")).alias("crossed"))


def leaf_to_root(edges: DataFrame, child: str, parent: str, levels: int = 8, most: int = 256) -> DataFrame:
    """P10: the topmost ancestor of each child, by self-joins, `levels` at a time until none has a parent.

    Chains of more than `most` levels, so also cycles, are an error.
    """
    top = edges.select(F.col(child).alias("leaf"), F.col(parent).alias("top"))
    step = edges.select(F.col(child).alias("top"), F.col(parent).alias("further"))
    for _ in range(0, most, levels):
        top = reduce(lambda t, _: t.join(step, "top", "left").select("leaf", F.coalesce("further", "top").alias("top")), range(levels), top)
        if top.join(step, "top", "left_semi").isEmpty():
            return top
    raise ValueError(f"{child} and {parent} have a chain of more than {most} levels or a cycle")
