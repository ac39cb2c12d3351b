"""Queries on cell changes, diagnostics, group tables, histories, samples, encoders and the corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import corpus, diagnostics
from tarnfold.plans.analysis import _SNAP, _snapshots
from tarnfold.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with o as (select * from customer), n as (select c_custkey, case when c_custkey % 10 = 3 then ' ' || c_name || ' ' when c_custkey % 10 = 4 then 'x' else c_name end as c_name, case when c_custkey % 7 = 0 then null else c_nationkey end as c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey % 50 <> 1),
  j as (select o.c_custkey as k, n.c_custkey is null as gone, o.c_name is distinct from trim(n.c_name) as a, o.c_nationkey is distinct from n.c_nationkey as b from o left join n using (c_custkey)),
  f as (select k % 7 = 0 as known, unnest([{'f': 'c_name', 'd': gone or a}, {'f': 'c_nationkey', 'd': gone or b}, {'f': 'c_acctbal', 'd': gone}, {'f': 'c_mktsegment', 'd': gone}]) as x from j)
  select x.f as field, count(*) filter (x.d) as changed, count(*) filter (x.d and not known) as unregistered from f group by 1""")
def cell_changes(spark, d):
    """C4: with planted edits, of which blanks around a text are none, and rows that are gone."""
    old, k = table(spark, d, "customer"), F.col("c_custkey")
    new = old.where(k % 50 != 1).withColumns({"c_name": F.when(k % 10 == 3, F.concat(F.lit(" "), "c_name", F.lit(" "))).when(k % 10 == 4, "x").otherwise(F.col("c_name")), "c_nationkey": F.when(k % 7 != 0, F.col("c_nationkey"))})
    return diagnostics.cell_changes(old, new, "c_custkey", old.where(k % 7 == 0))


@query("""with c as (select 'lang' as field, case when doc_id % 9 = 0 then ' ' else lang end as value from documents union all select 'source', source from documents union all select 'same', case when doc_id = 5 then 'b' else 'a' end from documents),
  n as (select field, nullif(trim(value), '') as value, count(*) as n from c group by 1, 2)
  select field, round(coalesce(sum(n) filter (value is null), 0) / sum(n), 6) as missing, count(value) as levels, round(max(n) filter (value is not null) / sum(n) filter (value is not null), 6) as top_share,
  case when max(n) filter (value is not null) / sum(n) filter (value is not null) >= 0.99 then 1 else 0 end as nearly_constant, count(value) filter (n < 20) as rare_levels, round(coalesce(sum(n) filter (value is not null and n < 20), 0) / sum(n), 6) as rare_share from n group by field""")
def column_diagnostics(spark, d):
    """A19."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.when(k % 9 == 0, " ").otherwise(F.col("lang")).alias("lang"), "source", F.when(k == 5, "b").otherwise("a").alias("same"))
    return diagnostics.column_diagnostics(rows, ["lang", "source", "same"])


def _grouped(rows: str) -> str:
    return f"select level, count(*) as n, round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as median, round(quantile_cont(v, 0.75), 4) as p75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) as iqr from ({rows}) group by level having count(*) >= 30"


@query(_grouped("select case when p_partkey % 4 = 0 then '缺失' else p_brand end as level, p_retailprice as v from part where p_partkey % 11 <> 0"))
def group_table(spark, d):
    """A2: one level a row, without it a level of its own."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.when(k % 4 != 0, F.col("p_brand")).alias("g"), F.when(k % 11 != 0, F.col("p_retailprice")).alias("v"))
    return diagnostics.group_table(rows, "g", "v")


@query(_grouped("select unnest(list_distinct([p_type, split_part(p_name, ' ', 1), p_type])) as level, p_retailprice as v from part"))
def group_table_multi(spark, d):
    """A2: several levels a row."""
    rows = table(spark, d, "part").select(F.array("p_type", F.substring_index("p_name", " ", 1), "p_type").alias("g"), "p_retailprice")
    return diagnostics.group_table(rows, "g", "p_retailprice")


@query(f"""with {_SNAP}, c as (select * from sn where state = 'CONSISTENT'), m as (select *, case when profile is not distinct from lag(profile) over (partition by user_id order by h) then 0 else 1 end as s from c),
  v as (select *, sum(s) over (partition by user_id order by h rows unbounded preceding)::bigint as version from m),
  j as (select v.user_id, version, count(distinct e.event_id) as jobs from v join events e on e.user_id = v.user_id and date_trunc('hour', e.ts) = v.h where e.event_type <> 'view' group by 1, 2)
  select v.user_id, v.version, min(profile) as profile, min(h) as first_time, max(h) as last_time, count(*) as snapshots, any_value(j.jobs) as jobs from v join j on j.user_id = v.user_id and j.version = v.version group by 1, 2""")
def profile_history(spark, d):
    """E10."""
    rows = table(spark, d, "events").where("event_type <> 'view'").withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return diagnostics.profile_history(_snapshots(spark, d), rows, "user_id", "h", "event_id")


@query("""with a as (select o_orderkey from orders where o_orderpriority = '1-URGENT' order by 1 limit 40), b as (select o_orderkey from orders where o_orderstatus = 'P' and o_orderkey not in (from a) order by 1 limit 40),
  c as (select o_orderkey from orders where o_totalprice < 0 and o_orderkey not in (from a) and o_orderkey not in (from b) limit 40), t as (select *, 'urgent' as stratum from a union all select *, 'open' from b union all select *, 'none' from c),
  f as (select o_orderkey, 'filled' as stratum from orders where o_orderkey not in (select o_orderkey from t) order by 1 limit (120 - (select count(*) from t))) select o_orderkey, stratum from t union all from f""")
def filled_sample(spark, d):
    """K14."""
    strata = [("urgent", F.col("o_orderpriority") == "1-URGENT"), ("open", F.col("o_orderstatus") == "P"), ("none", F.col("o_totalprice") < 0)]
    return diagnostics.filled_sample(table(spark, d, "orders"), strata, "o_orderkey", 120).select("o_orderkey", "stratum")


@query("""with r as (select p_brand, row_number() over (order by s desc, p_brand) as x from (select p_brand, sum(l_quantity) as s from lineitem join part on p_partkey = l_partkey where p_brand <> 'Brand#3' group by 1)),
  q as (select p_brand, row_number() over (order by s desc, p_brand) as y from (select p_brand, count(*) as s from lineitem join part on p_partkey = l_partkey where l_returnflag = 'R' and p_brand <> 'Brand#7' group by 1)),
  b as (select x, y, row_number() over (order by x) as rx, row_number() over (order by y) as ry from r join q using (p_brand))
  select count(*) as shared, count(*) filter (x <= 10 and y <= 10) as top10, count(*) filter (x <= 20 and y <= 20) as top20, round(corr(rx, ry), 6) as spearman from b""")
def rank_robustness(spark, d):
    """K22."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    a = rows.where("p_brand <> 'Brand#3'").groupBy("p_brand").agg(F.sum("l_quantity").alias("s"))
    b = rows.where("l_returnflag = 'R' and p_brand <> 'Brand#7'").groupBy("p_brand").agg(F.count("*").alias("s"))
    return diagnostics.rank_robustness(a, b, "p_brand", "s")


@query("select p_partkey, case when p_partkey % 5 > 0 then [length(p_name)::float, (length(p_name) - length(replace(p_name, 'e', '')))::float] end as vector from part")
def encoded_texts(spark, d):
    """T22, T23, with a stand-in for a model that counts letters."""
    encoder = diagnostics.load_encoder(lambda: lambda ts: [[len(t), t.count("e")] for t in ts])
    k = F.col("p_partkey") % 5
    text = F.when(k > 1, F.concat(F.lit(" "), "p_name")).when(k == 1, F.col("p_name")).otherwise(F.when(F.col("p_partkey") % 10 == 0, "  "))
    return diagnostics.encode_texts(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t", encoder)


CORPUS = [
    "岗位职责：维护 SQL 报表\n任职要求：熟悉 Python\n薪资 150-300元/天 面谈\n更多职位请关注公众号", "<b>加分项：</b>Java，200元/天", "学习 sql\n\n java", None, "  ",
]

#: What each text is in words, by number, worked out by hand.
_C = """c as (select p_partkey as id, f.* exclude (k) from part join (values
  (0, '岗位职责：维护 SQL 报表' || chr(10) || '任职要求：熟悉 Python' || chr(10) || '薪资   面谈', 1, '维护 SQL 报表', '', '完整', 1, 1, 0, 'python|sql', 'data|language', 'a|b', 46, 4),
  (1, '加分项： Java， ', 1, '', 'Java，200元/天', '部分', 0, 0, 1, 'java', 'language', '', 16, 1), (2, '学习 sql' || chr(10) || chr(10) || 'java', 0, '', '', '未识别', 0, 0, 0, 'java|sql', 'data|language', 'c', 12, 2),
  (3, '', 0, '', '', '未识别', 0, 0, 0, '', '', '', 0, 0), (4, '', 0, '', '', '未识别', 0, 0, 0, '', '', '', 0, 0))
  f(k, safe, pay_hits, duty, plus, status, has_duty, has_need, has_plus, skills, groups, tags, n_chars, n_paragraphs) on f.k = p_partkey % 5)"""


def _corpus(spark, d):
    nth = (F.col("p_partkey") % 5 + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), nth)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), pick(CORPUS).alias("text"), pick(["a、b", None, "c；", "", ","]).alias("tags"))
    return corpus.build_corpus(rows, "text", "tags", {"sql": "data", "java": "language", "python": "language"}, ["关注公众号"])


@query(f"with {_C} select * from c")
def corpus_build(spark, d):
    """Texts, sections, flags, skills and counts of every row."""
    lists = [F.array_join(c, "|").alias(n) for c, n in (("skills", "skills"), ("groups", "groups"), ("tag_list", "tags"))]
    names = {"section_职责": "duty", "section_加分": "plus", "has_职责": "has_duty", "has_要求": "has_need", "has_加分": "has_plus"}
    return _corpus(spark, d).select("id", "safe", "pay_hits", "status", "n_chars", "n_paragraphs", *lists, *[F.col(a).alias(b) for a, b in names.items()])


@query(f"""with {_C} select unnest(['rows', 'empty', 'with_pay', 'with_residue', 'skills', 'has_职责', 'has_要求', 'has_技能', 'has_加分', 'has_福利', 'status_完整', 'status_部分', 'status_未识别']) as measure,
  unnest([count(*), count(*) filter (safe = ''), count(*) filter (pay_hits > 0), 0, sum(case skills when '' then 0 when 'java' then 1 else 2 end)::bigint, sum(has_duty)::bigint, sum(has_need)::bigint, 0, sum(has_plus)::bigint, 0, count(*) filter (status = '完整'), count(*) filter (status = '部分'), count(*) filter (status = '未识别')]) as n from c""")
def corpus_report(spark, d):
    """T19."""
    return corpus.corpus_report(_corpus(spark, d))
