"""Queries on entities, samples, coverage and their audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.functions.exprs import canonical
from tarnfold.operators import features, records, samples, texts
from tarnfold.plans.analysis import _H, _PAY, _pay
from tarnfold.plans.history import _EXACT, _I, _V, _episodes, _intervals, _versioned
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


@query("select s_suppkey, case when s_suppkey % 4 = 3 then 'https' else 'http' end || case when s_suppkey % 4 = 0 then '://m.jobs.example' else '://www.jobs.example' end || '/list?city=' || s_nationkey || '&keyword=a+b%2F' || s_suppkey || case when s_suppkey % 3 > 1 then '&page=2' else '' end as url from supplier")
def search_urls(spark, d):
    """U3."""
    k, page = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 3).cast("string")
    start = F.element_at(F.array(*map(F.lit, ("HTTP://M.jobs.example/x", "http://elsewhere.org/list", "http://www.jobs.example", "//www.JOBS.example/"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    url = F.concat(F.lit(" "), start, F.lit("?utm=1&page="), page, F.lit("&keyword=a%20b/"), k, F.lit("&city=0&type=&city="), F.col("s_nationkey").cast("string"), F.lit("#end"))
    return table(spark, d, "supplier").select("s_suppkey", samples.search_url(url, ["city", "type", "keyword", "page"], "www.jobs.example", "/list", keep_page=True).alias("url"))


@query(r"select lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, regexp_extract(url, '^[^:/]*:?//([^/?#]*)', 1) as host, count(*) as n, count(*) filter (regexp_matches(url, '#.')) as fragments, cast(0 as bigint) as spaced from pages group by 1, 2")
def url_structure(spark, d):
    """U6."""
    return samples.url_structure(table(spark, d, "pages"), "url")


@query("select n_nationkey as id, n_name as name, n_regionkey from nation")
def renamed(spark, d):
    """C1."""
    return samples.localized(table(spark, d, "nation"), {"n_nationkey": "id", "n_name": "name"}).select("id", "name", "n_regionkey")


@query("with t as (select case doc_id % 5 when 0 then null when 1 then ' ' || chr(9) else source end as source, case when doc_id % 7 = 0 then '' else ' ' || lang end as lang from documents) select 'source' as field, count(*) filter (regexp_matches(source, '^\\s*$')) as blanks, count(*) filter (source is null) as nulls, count(distinct source) filter (not regexp_matches(source, '^\\s*$')) as kinds from t union all select 'lang', count(*) filter (regexp_matches(lang, '^\\s*$')), count(*) filter (lang is null), count(distinct lang) filter (not regexp_matches(lang, '^\\s*$')) from t")
def blanks_to_null(spark, d):
    """Counts before, and what is left after."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.when(k % 5 == 0, None).when(k % 5 == 1, " \t").otherwise(F.col("source")).alias("source"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(" "), "lang")).alias("lang"))
    after, report = samples.blanks_to_null(rows, ["source", "lang"])
    kinds = after.unpivot([], ["source", "lang"], "field", "value").groupBy("field").agg(F.countDistinct("value").alias("kinds"))
    return report.join(kinds, "field")


@query("select case when k = 0 then null when k = 1 then 'a b' when k = 2 then '3' when k = 3 then '2.5' else '[\"x\",\"y\"]' end as value, count(*) as n from (select event_id % 6 as k from events) where k < 5 group by 1 union all select null, count(*) from events where event_id % 6 = 5")
def canonical_values(spark, d):
    """V1, G1: one form of texts, numbers and lists; blanks and empty texts are nothing."""
    k = F.col("event_id") % 6
    t = canonical(F.when(k == 0, " 　\t").when(k == 1, "  a b "), "string")
    x = canonical(F.when(k == 2, 3.0).when(k == 3, 2.5), "double")
    items = canonical(F.when(k == 4, F.array(F.lit(" y"), F.lit("x"), F.lit(""), F.lit("x "), F.lit(None).cast("string"))), "array<string>")
    rows = table(spark, d, "events").select(F.when(k == 5, canonical(F.lit(float("nan")), "double")).otherwise(F.coalesce(t, x, items)).alias("value"), k.alias("k"))
    return rows.groupBy("value", (F.col("k") == 5).alias("nan")).agg(F.count("*").alias("n")).select("value", "n")


@query("with s as (select s_suppkey, s_suppkey % 5 as k from supplier) select cast(0 as bigint) as rows_differ, count(*) filter (s_suppkey % 50 = 3) as residual, count(*) filter (s_suppkey % 25 = 4) as untouched_changed, count(*) filter (s_suppkey % 40 = 7) as others_changed, count(*) filter (s_suppkey % 50 = 3) as audited_unchanged, cast(0 as integer) as passes from s")
def repair_validation(spark, d):
    """A repair with faults planted: rows that stay odd, rows that change without need, and another field that changes."""
    k, key = F.col("s_suppkey") % 5, F.col("s_suppkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    before = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", pick("50-150人", "50-150人", "民营企业", "50-150人", "民营企业").alias("nature"), pick("上海", "", "上海", "", "15-50人").alias("size"), pick("", "", "", "", "杭州").alias("place"))
    fixed = records.repair_slots(before, "nature", "size", "place")
    audited = fixed.where("anomaly not in ('NONE', 'NOT_REPAIRABLE')").select("s_suppkey")
    old = before.select("s_suppkey", F.struct("nature", "size", "place").alias("o"))
    after = fixed.drop("anomaly").join(old, "s_suppkey")
    stays, spoilt = key % 50 == 3, key % 25 == 4
    after = after.withColumns({
        "nature": F.when(stays, F.col("o.nature")).otherwise(F.col("nature")), "size": F.when(stays, F.col("o.size")).otherwise(F.col("size")),
        "place": F.when(stays, F.col("o.place")).when(spoilt, "北京").otherwise(F.col("place")), "s_acctbal": F.when(key % 40 == 7, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")),
    }).drop("o")
    return samples.repair_report(before, after, "s_suppkey", ["nature", "size", "place"], audited, F.col("nature").rlike(r"^\d+-\d+人"))


@query("with t as (select o_custkey, o_orderkey, o_orderkey % 3 = 0 as lost, o_orderstatus as v from orders), g as (select o_custkey, count(*) filter (lost) as lost, min(v) filter (not lost) as lo, max(v) filter (not lost) as hi, min(o_orderkey) filter (not lost) as f from t group by 1) select o_custkey, lost, case when lo = hi then lo end as value, case when lo = hi then f end as example, case when lo is null then 'none' when lo = hi then 'unique' else 'several' end as basis from g where lost > 0")
def lost_value_hints(spark, d):
    """C11."""
    return samples.unique_hints(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", F.col("o_orderkey") % 3 == 0)


@query("with t as (select p_partkey, unnest(list_distinct(string_split(p_type, ' '))) as token from part) select token, count(*) as n, min(p_partkey) as example, cast(token not in ('STEEL', 'BRASS', 'SMALL') as integer) as unknown from t group by 1")
def token_audit(spark, d):
    """C14."""
    return samples.token_audit(table(spark, d, "part"), "p_partkey", F.split("p_type", " "), ["STEEL", "BRASS", "SMALL"])


@query("select array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), '+') as combination, count(*) as n from part group by 1")
def token_combinations(spark, d):
    """C14."""
    return samples.token_combinations(table(spark, d, "part"), F.split("p_type", " "))


@query(f"with {_PAY} select p_partkey, case k when 1 then s when 2 then s + 50 when 3 then s end as low, case k when 1 then s when 2 then s when 3 then s + 50 end as high from t where k not in (4, 7) union all select p_partkey, s, s + 50 from t where k = 4 union all select p_partkey, null, null from t where k = 7")
def simple_pay_range(spark, d):
    """C17."""
    return _pay(spark, d).withColumns(samples.simple_range(F.col("t"))).drop("t")


@query("select s_suppkey, case s_suppkey % 6 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 end as level from supplier")
def education_levels(spark, d):
    """P4."""
    names = F.array(*map(F.lit, ("不限", "大专 ", "本科", " 硕士", "博士", "其他")))
    return table(spark, d, "supplier").select("s_suppkey", samples.ordinal(F.element_at(names, (F.col("s_suppkey") % 6 + 1).cast("int"))).alias("level"))


@query("with c as (select o_custkey, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as n from orders group by 1), q as (select list_sort(list_distinct(list_filter([cast(ceil(quantile_cont(n, 0.45)) as bigint), cast(ceil(quantile_cont(n, 0.70)) as bigint), cast(ceil(quantile_cont(n, 0.85)) as bigint), cast(ceil(quantile_cont(n, 0.95)) as bigint)], lambda x: x > 1))) as cuts from c where n > 0) select o_custkey, n, cast(case when n > 0 then len(list_filter(cuts, lambda x: x <= n)) + 1 else 0 end as integer) as class from c, q")
def class_breaks(spark, d):
    """P11."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return samples.class_breaks(rows, "n")


@query("with b as (select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders) where n = 1), s as (select o_custkey, count(*) as records, count(distinct o_orderpriority) as kinds from orders group by 1) select b.o_custkey, o_orderkey, records, kinds, c_mktsegment from b left join s using (o_custkey) left join customer on c_custkey = b.o_custkey")
def entity_assembly(spark, d):
    """G9."""
    o = table(spark, d, "orders")
    base = o.withColumn("_n", F.expr("row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey)")).where("_n = 1").select("o_custkey", "o_orderkey")
    side = o.groupBy("o_custkey").agg(F.count("*").alias("records"), F.countDistinct("o_orderpriority").alias("kinds"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return samples.assembled(base, "o_custkey", [side, people])


@query(f"with {_V}, l as (select *, max(core) over (partition by user_id) as mx from v) select user_id, event_id, records from (select user_id, event_id, count(*) over (partition by user_id) as records, row_number() over (partition by user_id order by ts desc, event_id) as n from l where core = mx) where n = 1")
def latest_entity(spark, d):
    """The best observation of each entity's final version."""
    return samples.latest_entities(_versioned(spark, d), "user_id", "core", {"updated": F.col("ts")}, ["event_id"]).select("user_id", "event_id", "records")


@query("select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, d):
    """E9."""
    return samples.duplicate_keys(table(spark, d, "events"), ["user_id", "event_type"])


@query(f"""with {_I}, j as (select *, date_diff('day', cast(s as date), cast(e as date)) + 1 as len from i), c as (select quantile_cont(len, 0.99) as cut from j), k as (select j.* from j, c where len <= cut),
sp as (select unnest(generate_series((select min(cast(s as date)) from j)::timestamp, (select max(cast(e as date)) from j)::timestamp, interval 1 day))::date as day),
ea as (select day, sum(x) as x from (select cast(s as date) as day, 1 as x from j union all select cast(e as date) + 1, -1 from j) group by 1), eb as (select day, sum(x) as x from (select cast(s as date) as day, 1 as x from k union all select cast(e as date) + 1, -1 from k) group by 1),
r as (select sp.day, sum(coalesce(ea.x, 0)) over (order by sp.day rows unbounded preceding) as a, sum(coalesce(eb.x, 0)) over (order by sp.day rows unbounded preceding) as b from sp left join ea using (day) left join eb using (day)),
rk as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from r)
select count(*) as days, cast(sum(a) as bigint) as all_days, cast(sum(b) as bigint) as kept_days, cast(max(a) as bigint) as all_most, cast(max(b) as bigint) as kept_most, round(corr(ra, rb), 6) as rho, round(any_value(cut), 1) as cutoff from rk, c""")
def trim_sensitivity(spark, d):
    """L14."""
    return samples.trim_sensitivity(_intervals(spark, d), "s", "e")


@query(f"with {_EXACT} select o_custkey, o_orderkey, strict_no, min(s) over q as episode_start, max(e) over q as episode_end, count(*) over q as segments, row_number() over (partition by o_custkey, strict_no order by s, e, o_orderkey) as nth from n window q as (partition by o_custkey, strict_no)")
def segments_with_episodes(spark, d):
    """L25."""
    rows = samples.with_episodes(_episodes(spark, d), "o_custkey", "strict_no", "s", "e")
    return rows.select("o_custkey", "o_orderkey", "strict_no", "episode_start", "episode_end", "segments", F.row_number().over(_w()).alias("nth"))


def _w():
    from pyspark.sql import Window

    return Window.partitionBy("o_custkey", "strict_no").orderBy("s", "e", "o_orderkey")


@query("select 'o_orderdate' as field, 'before' as known, count(o_orderdate) as filled, 1 as usable from orders union all select 'o_orderstatus', 'after', count(o_orderstatus), 0 from orders union all select 'o_totalprice', 'unknown', count(o_totalprice), 0 from orders")
def leakage_audit(spark, d):
    """L22."""
    return samples.leakage_audit(table(spark, d, "orders"), {"o_orderdate": "before", "o_orderstatus": "after", "o_totalprice": "unknown"})


def _targets(spark, d):
    return _pay(spark, d).withColumns(records.parse_pay(F.col("t")))


@query(f"with {_PAY} select p_partkey, cast(k in (1, 4, 5) as integer) as valid from t")
def valid_targets(spark, d):
    """M1."""
    return _targets(spark, d).select("p_partkey", samples.valid_target(F.col("mid"), F.col("status"), F.col("negotiable"), F.col("anomaly")).cast("int").alias("valid"))


@query(f"with {_PAY} select count(*) as total, count(*) filter (k in (0, 6)) as negotiable, count(*) filter (k in (3, 8)) as unparsed, count(*) filter (k in (2, 7)) as anomalous, count(*) filter (k in (1, 4, 5)) as sample, 1 as adds_up from t")
def sample_funnel(spark, d):
    """M3."""
    return samples.sample_funnel(_targets(spark, d), "status", "negotiable", "anomaly")


@query("with c as (select 'p_brand' as field, p_brand as level, count(*) as n from part group by 2 union all select 'p_size', cast(p_size as varchar), count(*) from part group by 2), g as (select field, t as threshold, n from c, (values (1), (40), (60)) v(t)) select field, threshold, count(*) as levels, count(*) filter (n >= threshold) as kept, round(coalesce(sum(n) filter (n >= threshold), 0) / cast(sum(n) as double), 6) as covered from g group by 1, 2")
def level_coverage(spark, d):
    """M5."""
    return samples.level_coverage(table(spark, d, "part"), ["p_brand", "p_size"], (1, 40, 60))


@query(f"with m as (select distinct l_orderkey, l_suppkey from lineitem where {_H.format('l_orderkey')} < 0.70) select l_suppkey, count(*) as n from m group by 1 having count(*) >= 420")
def frequent_items(spark, d):
    """Items counted on training entities only."""
    li = table(spark, d, "lineitem")
    train = features.group_split(li.select("l_orderkey").distinct(), "l_orderkey").where("split = 'train'")
    return samples.frequent_items(li, "l_orderkey", "l_suppkey", train, 420)


@query("with l as (select label, arg_max(embedding, vec_id) as e from embeddings where label <> 1 group by 1) select n_nationkey, cast(e is not null as integer) as found, round(coalesce(list_sum(list_transform(e, lambda x: cast(x as double))), 0), 4) as total from nation left join l on label = n_nationkey")
def vector_lookup(spark, d):
    """The last vector of a key, zeros for keys without one."""
    e = table(spark, d, "embeddings").where("label <> 1").select(F.col("label").alias("n_nationkey"), "embedding", "vec_id")
    width = len(table(spark, d, "embeddings").select("embedding").first()[0])
    rows = samples.with_vectors(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", e, "embedding", width, "vec_id")
    return rows.select("n_nationkey", "found", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("""with md as (select c_mktsegment as g, quantile_cont(c_acctbal, 0.5) as m from customer group by 1 order by m desc, g limit 4), pr as (select x.g as a, y.g as b from md x join md y on x.m > y.m or (x.m = y.m and x.g < y.g)),
t as (select a, b, c_acctbal as v, c_mktsegment = a as f from customer join pr on c_mktsegment in (a, b)), r as (select *, rank() over (partition by a, b order by v) + (count(*) over (partition by a, b, v) - 1) / 2.0 as r, count(*) over (partition by a, b, v) as t from t),
s as (select a, b, count(*) filter (f) as n1, count(*) filter (not f) as n2, cast(sum(r) filter (f) as double) as sr, sum(cast(t as double) * t - 1) as ts from r group by 1, 2), u as (select *, sr - n1 * (n1 + 1) / 2.0 as u, n1 + n2 as n from s)
select a, b, n1, n2, round(u, 4) as u, round(2 * u / (n1 * n2) - 1, 6) as delta, round((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ts / (n * (n - 1.0)))), 6) as z, case when abs(2 * u / (n1 * n2) - 1) < 0.147 then 'negligible' when abs(2 * u / (n1 * n2) - 1) < 0.33 then 'small' when abs(2 * u / (n1 * n2) - 1) < 0.474 then 'medium' else 'large' end as effect from u""")
def pairwise_tests(spark, d):
    """A8."""
    return samples.pairwise_tests(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", 4)


@query("select 'orders' as measure, count(*) as value from orders union all select 'customers', count(distinct o_custkey) from orders union all select 'open', count(*) filter (o_orderstatus = 'O') from orders union all select 'days', count(distinct cast(o_orderdate as date)) from orders")
def sample_overview(spark, d):
    """A15."""
    return samples.sample_overview(table(spark, d, "orders"), {"orders": F.count("*"), "customers": F.countDistinct("o_custkey"), "open": F.count_if(F.col("o_orderstatus") == "O"), "days": F.countDistinct(F.to_date("o_orderdate"))})


@query("""with t as (select l_quantity as x, l_extendedprice as y from lineitem where l_quantity > 0), e as (select list_sort(list_distinct([quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75)])) as e from t), b as (select x, y, len(list_filter(e, lambda q: q < x)) as g from t, e),
r as (select *, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, count(*) over (partition by y) as ty from b), s as (select g, count(*) as n, sum(ry) as sr from r group by 1),
q as (select count(*) as groups, cast(sum(n) as bigint) as n, sum(sr * sr / n) as q from s), h as (select groups, n, (12.0 / (cast(n as double) * (n + 1)) * q - 3 * (n + 1)) / (1 - (select sum(cast(ty as double) * ty - 1) from r) / (cast(n as double) * n * n - n)) as h from q)
select groups, n, round(h, 6) as h, round((h - groups + 1) / (n - groups), 6) as epsilon2, (select round(corr(rx, ry), 6) from r) as rho from h""")
def quartile_association(spark, d):
    """A17."""
    return samples.quartile_association(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("select 'doc_id' as field, count(*) as rows, count(doc_id) as filled, count(*) - count(doc_id) as missing, cast(0 as bigint) as blank, count(distinct doc_id) as kinds from documents union all select 'source', count(*), count(source), count(*) - count(source), count(*) filter (regexp_matches(source, '^\\s*$')), count(distinct source) from documents")
def identity_stats(spark, d):
    """Q4."""
    return samples.identity_stats(table(spark, d, "documents"), ["doc_id", "source"])


@query("with t as (select case when p_partkey % 10 = 0 then null when p_partkey % 10 = 1 then [] else string_split(p_type, ' ') end as x from part), k as (select x, coalesce(len(x), 0) as k from t) select count(*) as rows, count(*) filter (x is null) as missing, count(*) filter (x is not null and k = 0) as empty, cast(max(k) as integer) as most, round(avg(k) filter (k > 0), 6) as mean, quantile_cont(k, 0.5) filter (k > 0) as median, (select count(distinct i) from (select unnest(x) as i from t)) as items from k")
def list_profile(spark, d):
    """Q12."""
    k = F.col("p_partkey") % 10
    return samples.list_profile(table(spark, d, "part"), F.when(k == 0, None).when(k == 1, F.array().cast("array<string>")).otherwise(F.split("p_type", " ")))


# rows that had code without a query


@query("with t as (select page_id, regexp_replace(url, '[?#].*$', '') as u from pages) select page_id, case page_id % 3 when 0 then u when 1 then 'https:' || regexp_replace(u, '^[^:]+:', '') when 2 then case when regexp_matches(u, '^[^:]+://[^/]*/') then 'https://none.example' else '' end || regexp_replace(u, '^[^:]+://[^/]*', '') end as url from t")
def absolute_urls(spark, d):
    """From a whole URL, one without a scheme, and one without a host."""
    k = F.col("page_id") % 3
    u = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^[^:]+:", "")).otherwise(F.regexp_replace("url", "^[^:]+://[^/?#]*", ""))
    return table(spark, d, "pages").select("page_id", records.absolute_url(F.concat(F.lit("  "), u, F.lit("?x=1#y")), "https://none.example").alias("url"))


@query("select s_suppkey, case s_suppkey % 3 when 0 then s_nationkey when 1 then 3 end as months, case s_suppkey % 3 when 0 then s_nationkey when 1 then 3 else -1 end as with_default from supplier")
def first_integers(spark, d):
    """C18, P5."""
    k = F.col("s_suppkey") % 3
    t = F.when(k == 0, F.concat(F.lit("实习"), F.col("s_nationkey").cast("string"), F.lit("个月"))).when(k == 1, "3-6个月").otherwise("不限")
    return table(spark, d, "supplier").select("s_suppkey", records.first_integer(t).alias("months"), records.first_integer(t, -1).alias("with_default"))


@query("select p_partkey, array_to_string(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> ''), '/') as tags from part")
def tag_lists(spark, d):
    """Tags between several kinds of marks."""
    t = F.concat(F.lit("、"), F.regexp_replace(F.regexp_replace("p_type", " (.*) ", "，$1 ; "), " ", "｜"), F.lit(" ,"))
    return table(spark, d, "part").select("p_partkey", F.array_join(texts.split_tags(t), "/").alias("tags"))


@query("select doc_id, case when contains(lower(text), 'licensed') then 'license' when contains(lower(text), 'the') or contains(lower(text), 'and') then 'english' when contains(lower(text), 'que') then 'romance' else 'other' end as label from documents")
def first_rules(spark, d):
    """The first rule that has a word in the text."""
    rules = [("license", ["licensed"]), ("english", ["the", "and"]), ("romance", ["que"])]
    return table(spark, d, "documents").select("doc_id", texts.first_rule(F.col("text"), rules, "other").alias("label"))


@query("with j as (select o_orderkey, o_custkey, c_mktsegment, n_name from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey) select count(*) as rows, count(c_mktsegment) as with_segment, count(distinct n_name) as nations from j")
def wide_set(spark, d):
    """M2: left joins that never multiply rows, though a side has a key twice."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    wide = features.joined(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [(c.unionAll(c), ["o_custkey"]), (table(spark, d, "nation"), ["n_nationkey"])])
    return wide.agg(F.count("*").alias("rows"), F.count("c_mktsegment").alias("with_segment"), F.countDistinct("n_name").alias("nations"))
