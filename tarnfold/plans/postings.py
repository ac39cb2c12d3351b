"""Queries on sections, skills and profiles of postings made from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import postings, texts
from tarnfold.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
FAMILIES = {"python": "language", "java": "language", "golang": "language", "sql": "data", "spark": "data", "excel": "office", "cobol": "language"}
WORDS = list(FAMILIES)
TEXTS = [
    "岗位职责：维护 SQL 报表\n任职要求：熟悉 Python 与 Spark\n1、加分项：golang，Rustlang", "任职要求：\n熟悉 java\n熟悉 Java", "维护 excel 报表，学习 sql 与 Kafka", "", "岗位职责：测试 java 服务，Kafka 优先\n公司介绍：小公司",
]

#: What each text is in words, by number, for the SQL.
_T = """p as (select p_partkey as id, p_size as version, p_partkey % 300 as entity, p_partkey % 5 as k from part),
f as (select * from (values (0, 'REQUIREMENT_SECTION', '完整', '维护 SQL 报表', '熟悉 Python 与 Spark', 'golang，Rustlang', ['golang', 'python', 'spark']), (1, 'REQUIREMENT_SECTION', '部分', null, '熟悉 java' || chr(10) || '熟悉 Java', null, ['java']),
  (2, 'FULL_TEXT_FALLBACK', '未识别', null, null, null, ['excel', 'sql']), (3, 'EMPTY_TEXT', '未识别', null, null, null, cast([] as varchar[])), (4, 'FULL_TEXT_FALLBACK', '部分', '测试 java 服务，Kafka 优先', null, null, ['java'])) t(k, scope, status, duty, need, plus, skills)),
j as (select p.*, f.* exclude (k) from p join f using (k)), m as (select *, unnest(skills) as skill from j),
fam as (select * from (values ('python', 'language'), ('java', 'language'), ('golang', 'language'), ('sql', 'data'), ('spark', 'data'), ('excel', 'office'), ('cobol', 'language')) t(skill, family))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _postings(spark, d):
    text = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("version"), (F.col("p_partkey") % 300).alias("entity"), text.alias("text"))


def _skilled(spark, d):
    return postings.posting_skills(_postings(spark, d), "id", "text", WORDS)


@query(f"with {_T} select id, duty, need, plus, status from j")
def section_split(spark, d):
    """T3."""
    s = postings.split_sections(F.col("text"))
    part = lambda k: F.element_at("s.parts", F.lit(k))
    return _postings(spark, d).withColumn("s", s).select("id", part("职责").alias("duty"), part("要求").alias("need"), part("加分").alias("plus"), "s.status")


@query(f"with {_T} select id, scope, array_to_string(skills, '|') as skills from j")
def requirement_skills(spark, d):
    """T4, K9."""
    return _skilled(spark, d).select("id", "scope", F.array_join("skills", "|").alias("skills"))


@query(r"select doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9+#.]*')) as n_tokens, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\s]'))) as n_paragraphs, length(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '')) as n_chars from documents")
def text_counts(spark, d):
    """T10."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    got = postings.text_counts(F.col("text"), texts.latin_tokens(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", *[c.cast("long").alias(n) for n, c in got.items()])


_FORM = r"regexp_replace(lower({}), '[\s，。、；：,.;:!！?？\"“”''‘’()（）\[\]【】~～—_-]', '', 'g')"


@query(f"with p as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as old from conversations) select conv_id, turn, cast({_FORM.format('text')} = {_FORM.format('old')} as integer) as same, cast({_FORM.format('text')} = {_FORM.format("' (' || text || ') ...!'")} as integer) as in_brackets from p where old is not null")
def same_wording(spark, d):
    """T11."""
    p = table(spark, d, "conversations").withColumn("old", F.expr("lag(text) over (partition by conv_id order by turn)")).where("old is not null")
    return p.select("conv_id", "turn", postings.texts_identical(F.col("text"), F.col("old")).cast("int").alias("same"), postings.texts_identical(F.col("text"), F.concat(F.lit(" ("), "text", F.lit(") ...!"))).cast("int").alias("in_brackets"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'data engineer p ' || p_size || ' remote' when 1 then '后端 开发 go' when 2 then 'qa' else '' end as title, case when p_partkey % 4 = 0 and p_partkey % 3 = 0 then 1 when p_partkey % 4 = 1 and p_partkey % 3 = 1 then 1 else 0 end as consistent from part")
def title_direction(spark, d):
    """A normalised title, the direction by its words, and whether the platform's groups agree."""
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat(F.lit(" Data  Engineer（P|"), F.col("p_size").cast("string"), F.lit("） /Remote"))).when(k == 1, "【后端】开发/Go").when(k == 2, "QA ")
    groups = F.array(F.element_at(F.array(*map(F.lit, ("data", "backend", "other"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    rows = table(spark, d, "part").select("p_partkey", postings.normalize_title(title).alias("title"), groups.alias("groups"))
    direction = texts.first_rule(F.col("title"), [("data", ["data", "sql"]), ("backend", ["后端", "java"])], "other")
    expected = {"data": ["data", "ai"], "backend": ["backend"], "other": []}
    return rows.select("p_partkey", "title", postings.consistent_direction(direction, F.col("groups"), expected).alias("consistent"))


@query("with v as (select value as a, case when event_id % 100 = 0 then 'infinity'::double when event_id % 100 = 1 then 'nan'::double when event_id % 100 = 2 then null else value / 100 end as b from events), w as (select a, case when isnan(b) then null else b end as b from v) select 'a' as field, count(*) as rows, count(a) as filled, count(*) - count(a) as missing, cast(0 as bigint) as infinite, count(*) filter (a < 0 or a > 100) as outside, cast(count(*) filter (a < 0 or a > 100) = 0 as integer) as passes from w union all select 'b', count(*), count(b), count(*) - count(b), count(*) filter (isinf(b)), count(*) filter (b < 0 or b > 100), cast(count(*) filter (isinf(b) or b < 0 or b > 100) = 0 as integer) from w")
def value_range_report(spark, d):
    """T30."""
    k = F.col("event_id") % 100
    b = F.when(k == 0, float("inf")).when(k == 1, float("nan")).when(k == 2, None).otherwise(F.col("value") / 100)
    return postings.range_report(table(spark, d, "events").select(F.col("value").alias("a"), b.alias("b")), ["a", "b"], 0.0, 100.0)


@query("""with e as (select event_id, event_id % 11 as k, case when event_id % 7 = 0 then null else value end as dist from events), q as (select quantile_cont(dist, 0.5) as p50, quantile_cont(dist, 0.75) as p75 from e)
select event_id, case when k = 0 then 'AI/大模型方向强化候选' when k = 1 then '全球化叙事变化候选' when k in (2, 3) and dist >= p75 then '业务范围扩展候选' when k in (4, 5) and dist >= p75 then '企业定位变化候选' when k in (2, 3) then '业务范围扩展候选' when k = 4 then '技术方向变化候选' when dist <= p50 then '文字润色候选' else '品牌宣传变化候选' end as kind from e, q""")
def company_changes(spark, d):
    """Classes of profile changes against quantiles of all distances."""
    k = F.col("event_id") % 11
    rows = table(spark, d, "events").select("event_id", k.alias("k"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("dist"))
    q = rows.agg(F.expr("percentile(dist, 0.5)").alias("p50"), F.expr("percentile(dist, 0.75)").alias("p75"))
    words = lambda *cases: F.coalesce(*[F.when(F.col("k") == i, F.array(F.lit(w))) for i, w in cases])
    kind = postings.company_change_class(F.col("dist"), words((1, "出海"), (2, "教育"), (3, "游戏")), words((4, "大数据"), (5, "地产")), (F.col("k") == 0).cast("int"), F.lit(0), F.col("p50"), F.col("p75"))
    return rows.crossJoin(F.broadcast(q)).select("event_id", kind.alias("kind"))


@query("with t as (select l_returnflag, l_discount as v from lineitem) select l_returnflag, least(cast(floor(v / 0.0125) as integer), 7) as bin, count(*) as n from t where v between 0 and 0.1 group by 1, 2")
def scope_histogram(spark, d):
    """One histogram's edges for all scopes."""
    return postings.shared_histogram(table(spark, d, "lineitem"), "l_discount", "l_returnflag", 0.0, 0.1, 8)


@query("with b as (select 'all' as rows_of, l_linestatus, l_quantity as v from lineitem union all select 'uncut', l_linestatus, l_quantity from lineitem where l_discount <= 0.05) select rows_of, l_linestatus, count(v) as n, round(avg(v), 6) as mean, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.75), 6) as p75, round(quantile_cont(v, 0.9), 6) as p90, round(quantile_cont(v, 0.95), 6) as p95 from b group by 1, 2")
def scope_distribution(spark, d):
    """Two scopes, with and without rows that were cut."""
    return postings.scope_distribution(table(spark, d, "lineitem"), "l_quantity", "l_linestatus", F.col("l_discount") > 0.05)


@query(f"""with {_T}, l as (select *, row_number() over (partition by entity order by version desc, id desc) as n from j), ever as (select entity, string_agg(distinct skill, '|' order by skill) as ever, count(distinct skill) as k from m group by 1),
fc as (select l.id, string_agg('"' || x.family || '":' || coalesce((select count(*) from fam where fam.family = x.family and list_contains(l.skills, fam.skill)), 0), ',' order by x.family) as c from l, (select distinct family from fam) x where l.n = 1 group by 1)
select l.entity, scope, array_to_string(skills, '|') as skills, len(skills) as n_skills, '{{' || fc.c || '}}' as family_counts, coalesce(ever, '') as ever, cast(coalesce(ever.k, 0) > len(skills) as integer) as lost_some from l join fc on fc.id = l.id left join ever on ever.entity = l.entity where l.n = 1""")
def posting_profile(spark, d):
    """K6, K10."""
    rows = _skilled(spark, d).withColumn("at", F.struct("version", "id"))
    return postings.posting_profiles(rows, "entity", "at", FAMILIES)


@query(f"with {_T} select fam.skill, family, count(distinct entity) as n, round(count(distinct entity) / cast((select count(distinct entity) from p) as double), 6) as share, cast(count(distinct entity) < 3 as integer) as rare from fam left join m on m.skill = fam.skill group by 1, 2")
def skill_frequency(spark, d):
    """K11."""
    return postings.skill_frequency(_skilled(spark, d), "entity", FAMILIES, WORDS)


@query(f"with {_T} select scope, status, count(*) as n, round(count(*) / cast((select count(*) from p) as double), 6) as share from j group by 1, 2")
def scope_crosstab(spark, d):
    """K12."""
    return postings.scope_table(_skilled(spark, d))


@query(f"with {_T}, x as (select distinct entity, case k when 0 then 'Rustlang' else 'Kafka' end as term from p where k in (0, 2, 4)), r as (select *, row_number() over (partition by term order by entity) as n from x) select term, count(*) as n, string_agg(cast(entity as varchar), '、' order by entity) filter (n <= 3) as examples from r group by 1")
def candidate_terms(spark, d):
    """K13."""
    return postings.candidate_terms(_postings(spark, d), "entity", "text", WORDS, ["the"])


@query(f"with {_T} select scope as universe, count(distinct entity) as n from j group by 1 union all select 'ALL_USABLE', count(distinct entity) from j where scope <> 'EMPTY_TEXT'")
def scope_universe(spark, d):
    """K15."""
    return postings.scope_universe(_skilled(spark, d), "entity")


@query(f"with {_T}, x as (select m.*, family from m join fam using (skill) where scope = 'REQUIREMENT_SECTION'), k as (select family, skill, count(distinct entity) as k from x group by 1, 2) select family, count(distinct entity) as entities, count(*) as items, (select cast(sum(k) as bigint) from k where k.family = x.family) as naive from x group by 1")
def group_totals(spark, d):
    """K15, K17."""
    members = _skilled(spark, d).select("entity", "scope", F.explode("skills").alias("skill"))
    return postings.group_totals(postings.in_scopes(members, [postings.SECTION]), "entity", FAMILIES)
