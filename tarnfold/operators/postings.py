"""Sections of a posting, requirement-first skills and profiles, text comparison and change classes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.exprs import count_map, trim_u
from tarnfold.operators.texts import boundary, clean_text

#: Headings of each kind of section.
HEADINGS = {
    "职责": "岗位职责 职位职责 工作职责 职责描述 主要职责 岗位描述 职位描述 工作内容 工作描述 你将负责 你会做 工作范围 职责说明".split(),
    "要求": "任职要求 岗位要求 职位要求 任职资格 职位资格 任职条件 岗位条件 岗位需求 申请要求 我们希望你 我们期待你 我们需要你 希望你 你需要具备 应聘要求 人员要求 任职条件要求".split(),
    "技能": "技能要求 技术要求 专业技能 技术栈 岗位技能 技术能力 技能需求".split(),
    "加分": "加分项 加分点 优先考虑 具备以下经验优先 有以下经验优先 优先条件 满足以下条件优先 加分".split(),
    "福利": "福利 你将获得 岗位福利 薪资福利 公司福利 团队福利 我们提供 实习福利 待遇 实习收获 你将得到".split(),
    "其他": "公司介绍 关于我们 团队介绍 联系方式 其他说明 备注 工作地点说明 招聘流程 投递说明 实习说明".split(),
}
#: Sections whose text is the requirement, those that are flagged, and the three scopes of a text.
REQUIREMENT, FLAGGED = ("要求", "技能", "加分"), ("职责", "要求", "技能", "加分", "福利")
SECTION, FALLBACK, EMPTY = "REQUIREMENT_SECTION", "FULL_TEXT_FALLBACK", "EMPTY_TEXT"
#: Business words of two of the company change classes.
GLOBAL_WORDS, TECH_WORDS = ("全球化", "出海", "海外", "国际化"), ("人工智能", "大数据", "云计算", "物联网", "区块链", "芯片")


def split_sections(c: Column, headings: dict[str, list[str]] = HEADINGS) -> Column:
    """A struct of `parts` (kind of section -> text), `status` and `found`, the number of headings.

    A heading stands at the start, behind a line's end, a mark or a blank, perhaps numbered, and before a colon or a
    line's end. Text before the first heading is in no section; texts of one kind are joined by line ends.
    """
    words = sorted((w for ws in headings.values() for w in ws), key=len, reverse=True)
    pattern = rf"(?U)(?:^|[\n。；;，,、\s])(?:\d{{1,2}}\s*[、.)）]\s*)?(?<heading>{'|'.join(map(re.escape, words))})\s*(?:[:：]|(?=\s*[\n])|$)"
    kind = F.create_map(*[F.lit(x) for k, ws in headings.items() for w in ws for x in (w, k)])
    pieces = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), pattern, "\u0001${heading}\u0002"), "\u0001")
    named = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(kind[F.substring_index(p, "\u0002", 1)].alias("kind"), trim_u(F.regexp_extract(p, "\u0002((?s).*)", 1)).alias("text")))
    text = lambda of, k: trim_u(F.array_join(F.transform(F.filter(of, lambda x: (x["kind"] == k) & (x["text"] != "")), lambda x: x["text"]), "\n"))

    def judged(of: Column) -> Column:
        parts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), text(of, F.lit(k)).alias("v")) for k in headings]), lambda x: x["v"] != ""))
        return F.struct(parts.alias("parts"), F.size(of).alias("found"))

    out = F.element_at(F.transform(F.array(named), judged), 1)
    has = lambda p, k: F.map_contains_key(p["parts"], k)
    recognised = lambda p: F.size(F.filter(F.array(*map(F.lit, FLAGGED)), lambda k: has(p, k))) > 0
    status = lambda p: F.when(has(p, "职责") & has(p, "要求"), "完整").when(recognised(p), "部分").otherwise("未识别")
    return F.element_at(F.transform(F.array(out), lambda p: F.struct(p["parts"].alias("parts"), p["found"].alias("found"), status(p).alias("status"))), 1)


def requirement_of(c: Column, sections: Column) -> Column:
    """T4: a struct (text, scope): the requirement sections of a text, else the whole text, else nothing."""
    joined = trim_u(F.array_join(F.array_compact(F.array(*[F.element_at(sections["parts"], k) for k in REQUIREMENT])), "\n"))
    blank = trim_u(F.coalesce(c, F.lit(""))) == ""
    scope = F.when(blank, EMPTY).when(joined != "", SECTION).otherwise(FALLBACK)
    return F.struct(F.when(blank, "").when(joined != "", joined).otherwise(c).alias("text"), scope.alias("scope"))


def text_counts(c: Column, tokens: Column) -> dict[str, Column]:
    """Tokens, lines that hold something, and characters without the white space around."""
    t = F.coalesce(c, F.lit(""))
    return {"n_tokens": F.coalesce(F.size(tokens), F.lit(0)), "n_paragraphs": F.size(F.filter(F.split(t, "\n"), lambda x: trim_u(x) != "")), "n_chars": F.length(trim_u(t))}


def compare_form(c: Column) -> Column:
    """Lower case without white space and common punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"""(?U)[\s　，。、；：,.;:!！?？"“”'‘’()（）\[\]【】~～—\-_]""", "")


def texts_identical(a: Column, b: Column) -> Column:
    return compare_form(a) == compare_form(b)


def consistent_direction(direction: Column, groups: Column, expected: dict[str, list[str]]) -> Column:
    """1 if one of the groups is among those that the direction stands for."""
    out = F.lit(0)
    for name, wanted in expected.items():
        out = F.when(direction == name, F.coalesce(F.arrays_overlap(groups, F.array(*map(F.lit, wanted))), F.lit(False)).cast("int") if wanted else F.lit(0)).otherwise(out)
    return out


def normalize_title(c: Column) -> Column:
    """Cleaned, brackets and bars as blanks, one blank between words, lower case."""
    plain = F.translate(clean_text(c), "（）【】()/|", "        ")
    return F.lower(trim_u(F.regexp_replace(plain, r"(?U)\s+", " ")))


def range_report(rows: DataFrame, columns: list[str], low: float = 0.0, high: float = 2.0) -> DataFrame:
    """Per column rows, filled, missing, infinite and out of range (NaN is missing), and whether it passes."""
    parts = []
    for name in columns:
        c = F.nullif(F.col(name).cast("double"), F.lit(float("nan")))
        endless = F.abs(c) == F.lit(float("inf"))
        parts.append(F.struct(F.lit(name).alias("field"), F.count("*").alias("rows"), F.count(c).alias("filled"), F.count_if(c.isNull()).alias("missing"), F.count_if(endless).alias("infinite"), F.count_if((c < low) | (c > high)).alias("outside")))
    out = rows.agg(F.array(*parts).alias("x")).select(F.inline("x"))
    return out.withColumn("passes", ((F.col("infinite") == 0) & (F.col("outside") == 0)).cast("int"))


def company_change_class(distance: Column, added: Column, removed: Column, ai: Column, llm: Column, p50: Column, p75: Column) -> Column:
    """The kind of change of a company's profile, by seven rules in order; a missing distance meets no threshold."""
    some = lambda x: F.size(F.coalesce(x, F.array().cast("array<string>"))) > 0
    of = lambda x, words: F.coalesce(F.arrays_overlap(x, F.array(*map(F.lit, words))), F.lit(False))
    far, near = F.coalesce(distance >= p75, F.lit(False)), F.coalesce(distance <= p50, F.lit(False))
    return (
        F.when((F.coalesce(ai, F.lit(0)) > 0) | (F.coalesce(llm, F.lit(0)) > 0), "AI/大模型方向强化候选").when(of(added, GLOBAL_WORDS), "全球化叙事变化候选")
        .when(some(added) & far, "业务范围扩展候选").when(some(removed) & far, "企业定位变化候选").when(some(added), "业务范围扩展候选")
        .when(of(removed, TECH_WORDS), "技术方向变化候选").when(near, "文字润色候选").otherwise("品牌宣传变化候选")
    )


def shared_histogram(rows: DataFrame, value: str, scope: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of each scope's values in the same equal bins; the last bin holds its upper edge."""
    step = (high - low) / bins
    rows = rows.where(F.col(value).between(low, high))
    at = F.least(F.floor((F.col(value) - low) / step).cast("int"), F.lit(bins - 1))
    return rows.groupBy(scope, at.alias("bin")).agg(F.count("*").alias("n"))


def scope_distribution(rows: DataFrame, value: str, scope: str, cut: Column) -> DataFrame:
    """Size, mean and quantiles of each scope with all rows and again without those that `cut` is true for."""
    both = rows.withColumn("rows_of", F.explode(F.when(F.coalesce(cut, F.lit(False)), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("uncut")))))
    p = [F.round(F.expr(f"percentile({value}, {q})"), 6).alias(n) for n, q in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))]
    return both.groupBy("rows_of", scope).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), *p)


def skills_in(c: Column, words: list[str]) -> Column:
    """K5, K9: the words of a list that a text has, in order."""
    low = F.lower(c)
    return F.array_sort(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)) & low.rlike(boundary(w)), F.lit(w)) for w in words])))


def by_family(skills: Column, families: dict[str, str]) -> Column:
    """K6: family -> its skills in order; families without one have an empty list."""
    names = sorted(set(families.values()))
    of = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    family = lambda n: F.array_sort(F.filter(skills, lambda s: of[s] == n))
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(family, names)))


def group_count(skills: Column, families: dict[str, str], groups: list[str]) -> Column:
    """K6: how many of the skills are in the groups."""
    wanted = [s for s, g in families.items() if g in groups]
    return F.size(F.array_intersect(skills, F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)


def posting_skills(rows: DataFrame, doc: str, text: str, words: list[str]) -> DataFrame:
    """K9: `rows` plus status, scope and skills: from the requirement sections, else from the whole text."""
    rows = rows.withColumn("_s", split_sections(F.col(text))).withColumn("_r", requirement_of(F.col(text), F.col("_s")))
    return rows.withColumns({"status": F.col("_s.status"), "scope": F.col("_r.scope"), "skills": skills_in(F.col("_r.text"), words)}).drop("_s", "_r")


def posting_profiles(rows: DataFrame, entity: str, version: str, families: dict[str, str]) -> DataFrame:
    """Per entity its last version's skills, their number, families and counts a family, and all that it ever had.

    One aggregation; the lists are bounded by the dictionary.
    """
    last = F.max_by(F.struct("skills", "scope"), F.col(version)).alias("_l")
    ever = rows.select(entity, version, "skills", "scope", F.explode_outer("skills").alias("_x"))
    out = ever.groupBy(entity).agg(last, F.array_sort(F.collect_set("_x")).alias("_ever"))
    buckets = by_family(F.col("_l.skills"), families)
    counts = F.transform(F.map_entries(buckets), lambda e: F.struct(e["key"].alias("family"), F.size(e["value"]).cast("long").alias("n")))
    return out.select(
        entity, F.col("_l.scope").alias("scope"), F.array_join("_l.skills", "|").alias("skills"), F.size("_l.skills").cast("long").alias("n_skills"),
        count_map(counts).alias("family_counts"), F.array_join("_ever", "|").alias("ever"), (F.size("_ever") > F.size("_l.skills")).cast("int").alias("lost_some"),
    )


def skill_frequency(rows: DataFrame, entity: str, families: dict[str, str], words: list[str], rare: int = 3) -> DataFrame:
    """Every word of the dictionary with its family, the entities that have it, their share, and whether it is rare."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(w, families.get(w)) for w in words], "skill string, family string")
    n = rows.select(entity, F.explode("skills").alias("skill")).groupBy("skill").agg(F.countDistinct(entity).alias("n"))
    total = rows.agg(F.countDistinct(entity).alias("total"))
    out = known.join(n, "skill", "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select("skill", "family", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") < rare).cast("int").alias("rare"))


def scope_table(rows: DataFrame) -> DataFrame:
    """Rows by scope and status of the sections, and the share of all rows."""
    return rows.groupBy("scope", "status").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def candidate_terms(rows: DataFrame, entity: str, text: str, known: list[str], stop: list[str], least: int = 3, top: int = 200) -> DataFrame:
    """The `top` Latin tokens that are in no dictionary, by entities that have them, with the three first entities."""
    tokens = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z][A-Za-z0-9+#.]*)"), 1))
    shut = F.array(*map(F.lit, sorted({w.lower() for w in [*known, *stop]})))
    terms = rows.select(entity, F.explode(tokens).alias("term")).where((F.length("term") >= least) & ~F.array_contains(shut, F.lower("term"))).distinct()
    # The three first by two sorts of small arrays, so that no task lists all entities of a term.
    salted = terms.groupBy("term", F.pmod(F.xxhash64(entity), F.lit(64)).alias("_salt")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(entity)), 1, 3).alias("first"))
    out = salted.groupBy("term").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 3).alias("first"))
    return out.orderBy(F.desc("n"), "term").limit(top).select("term", "n", F.array_join("first", "、").alias("examples"))


def scope_universe(rows: DataFrame, entity: str) -> DataFrame:
    """Entities of each scope and of those that can be used (all but empty ones)."""
    named = rows.select(entity, F.explode(F.when(F.col("scope") == EMPTY, F.array("scope")).otherwise(F.array("scope", F.lit("ALL_USABLE")))).alias("universe"))
    return named.groupBy("universe").agg(F.countDistinct(entity).alias("n"))


def in_scopes(members: DataFrame, scopes: list[str]) -> DataFrame:
    """Members of the scopes."""
    return members.where(F.col("scope").isin(*scopes))


def group_totals(members: DataFrame, entity: str, families: dict[str, str]) -> DataFrame:
    """Per group the distinct entities, the items, and the sum of the skills' entities, which counts some twice."""
    of = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    items = members.withColumn("family", of[F.col("skill")]).where("family is not null")
    per = items.groupBy("family", "skill").agg(F.count("*").alias("items"), F.countDistinct(entity).alias("k")).groupBy("family").agg(F.sum("items").alias("items"), F.sum("k").alias("naive"))
    return per.join(items.groupBy("family").agg(F.countDistinct(entity).alias("entities")), "family").select("family", "entities", "items", "naive")
