"""Queries on mappings, tags, text changes, samples and rankings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import audits
from tarnfold.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("with p as (select distinct o_custkey as a, floor(o_totalprice / 1000) as b from orders), q as (select a, b, count(*) over (partition by a) > 1 as x, count(*) over (partition by b) > 1 as y from p) select a as customer, cast(b as bigint) as band, case when x and y then 'both' when x then 'left to many' else 'right to many' end as conflict from q where x or y")
def mapping_conflicts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.floor(F.col("o_totalprice") / 1000).alias("band"))
    return audits.mapping_conflicts(rows, "customer", "band")


@query("select term, count(*) as n_rows from (select distinct p_partkey, unnest(string_split(p_name, ' ')) as term from part) where term <> '' group by 1")
def multi_value_vocabulary(spark, d):
    return audits.vocabulary(table(spark, d, "part"), "p_name", " ")


_ICONS = {"icon_click": "clicks", "icon_view": "views", "icon_error": "errors"}


@query("with e as (select user_id, list_sort(list_distinct(list(event_type))) as k from events group by 1) select user_id, cast(len(k) as bigint) as n_tokens, array_to_string(list_filter([case when list_contains(k, 'click') then 'clicks' end, case when list_contains(k, 'view') then 'views' end, case when list_contains(k, 'error') then 'errors' end], lambda x: x is not null), ',') as tags, case when list_contains(k, 'click') and list_contains(k, 'view') then 'both' when list_contains(k, 'click') then 'only clicks' when list_contains(k, 'view') then 'only views' else 'neither' end as class from e")
def tag_classes(spark, d):
    links = F.concat(F.lit("https://cdn.example.com/icon_"), F.col("event_type"), F.lit(".png"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.collect_set(links)).alias("links"))
    tokens = audits.link_tokens(F.col("links"))
    rows = rows.select("user_id", F.size(tokens).cast("long").alias("n_tokens"), audits.mapped_tags(tokens, _ICONS).alias("tags"))
    return rows.select("user_id", "n_tokens", F.array_join("tags", ",").alias("tags"), audits.exclusive_class(F.col("tags"), "clicks", "views").alias("class"))


@query("with m as (select date_trunc('month', o_orderdate) as m, count(*) as n, count(*) filter (o_orderpriority = '1-URGENT') as h from orders group by 1), s as (select unnest(generate_series((select min(m) from m), (select max(m) from m), interval 1 month)) as m) select cast(s.m as date) as month, coalesce(n, 0) as n, coalesce(h, 0) as hits, round(h / cast(n as double), 8) as share from s left join m on m.m = s.m")
def monthly_hit_rate(spark, d):
    return audits.hit_rate_by_month(table(spark, d, "orders"), "o_orderdate", F.col("o_orderpriority") == "1-URGENT")


@query("select o_orderkey, cast(month(o_orderdate) as bigint) as month, cast(isodow(o_orderdate) - 1 as bigint) as weekday, cast(date_diff('day', lag(o_orderdate) over w, o_orderdate) as bigint) as gap_days, cast(row_number() over w - 1 as bigint) as rows_before from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def safe_time_features(spark, d):
    return audits.safe_time_features(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("select doc_id, case when trim(text) <> '' then sha256(text) end as text_hash, case when trim(text) <> '' then cast(length(text) as bigint) end as n_chars from documents")
def encoded_once(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    out = audits.encode_once(rows, "text", lambda x: x.select("text_hash", F.array(F.length("text").cast("long")).alias("vector")))
    return out.select("doc_id", "text_hash", F.get("vector", F.lit(0)).alias("n_chars"))


@query("with l as (select lang, length(text) as n from documents) select lang, cast(m as bigint) as \"limit\", count(*) as n, count(*) filter (l.n > m) as n_over, round(sum(greatest(l.n - m, 0)) / cast(sum(l.n) as double), 8) as cut_share from l, (values (512), (2048), (8192)) as x(m) group by 1, 2")
def truncation_audit(spark, d):
    return audits.truncation(table(spark, d, "documents"), F.length("text"), [512, 2048, 8192], "lang")


_TC = r"""
with t as (select doc_id, source, lang, list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as now from documents),
w as (select *, lag(now) over (partition by source, lang order by doc_id) as was from t),
c as (select doc_id, len(was) as n_was, len(now) as n_now, len(list_intersect(now, was)) as n_both from w where was is not null),
e as (select doc_id, n_was, n_now, n_now - n_both as added, n_was - n_both as removed, case when n_was > 0 then round((n_now - n_was) / cast(n_was as double), 8) end as rate,
 case when n_was + n_now > n_both then round(n_both / cast(n_was + n_now - n_both as double), 8) end as jaccard from c)
"""


def _changes(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return audits.text_changes(table(spark, d, "documents"), ["source", "lang"], "doc_id", words)


@query(f"{_TC}, q as (select quantile_cont(rate, 0.9) as p90, quantile_cont(rate, 0.95) as p95 from e) select e.*, case when jaccard = 1 then 'same' when rate >= p95 then 'extreme' when rate >= p90 then 'significant' when removed = 0 then 'grown' when added = 0 then 'shrunk' else 'rewritten' end as label from e, q")
def text_change_classes(spark, d):
    rows = _changes(spark, d)
    cuts = rows.agg(F.percentile("rate", F.lit(0.9)).alias("p90"), F.percentile("rate", F.lit(0.95)).alias("p95"))
    c = F.col
    rules = [("same", c("jaccard") == 1), ("extreme", c("rate") >= c("p95")), ("significant", c("rate") >= c("p90")), ("grown", c("removed") == 0), ("shrunk", c("added") == 0)]
    return rows.join(F.broadcast(cuts)).withColumn("label", audits.classified(rules, "rewritten")).drop("p90", "p95")


@query("with c as (select unnest([0.5::double, 0.9::double, 0.95::double]) as q, unnest((select quantile_cont(o_totalprice, [0.5, 0.9, 0.95]) from orders)) as at), r as (select q, o_orderkey, row_number() over (partition by q order by abs(o_totalprice - c.at), o_orderkey) as nth from orders, c) select q, o_orderkey, nth from r where nth <= 5")
def quantile_review(spark, d):
    return audits.nearest_to_quantiles(table(spark, d, "orders"), "o_totalprice", "o_orderkey", [0.5, 0.9, 0.95], 5)


@query("with s as (select o_orderkey, case when o_orderpriority = '1-URGENT' then 'urgent' when o_orderstatus = 'P' then 'open' when o_totalprice > 200000 then 'large' end as stratum from orders), r as (select stratum, o_orderkey, row_number() over (partition by stratum order by md5(cast(o_orderkey as varchar)), o_orderkey) as nth from s where stratum is not null) select * from r where nth <= 20")
def first_stratum_sample(spark, d):
    strata = [("urgent", F.col("o_orderpriority") == "1-URGENT"), ("open", F.col("o_orderstatus") == "P"), ("large", F.col("o_totalprice") > 200000)]
    return audits.first_stratum_sample(table(spark, d, "orders"), strata, "o_orderkey", 20)


@query("select o_orderstatus, count(*) filter (u) as n_with, count(*) filter (not u) as n_without, round(quantile_cont(o_totalprice, 0.5) filter (u) - quantile_cont(o_totalprice, 0.5) filter (not u), 4) as difference from (select *, o_orderpriority = '1-URGENT' as u from orders) group by 1 having count(*) filter (u) >= 10 and count(*) filter (not u) >= 10")
def median_difference_within(spark, d):
    return audits.median_difference_within(table(spark, d, "orders"), F.col("o_orderpriority") == "1-URGENT", "o_totalprice", "o_orderstatus")


@query("with p as (select l_suppkey, count(*) as n, sum(cast(l_quantity as bigint)) as q from lineitem group by 1), r as (select row_number() over (order by n desc, l_suppkey) as a, row_number() over (order by q desc, l_suppkey) as b from p) select cast(k as bigint) as top, count(*) filter (a <= k and b <= k) as shared from r, (values (10), (20)) as x(k) group by 1")
def rank_overlap(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return audits.rank_overlap(rows, "l_suppkey", F.col("n"), F.col("q"), [10, 20])


@query("with m as (select distinct user_id, event_type as t from events), c as (select t, count(*) as n from m group by 1 order by n desc, t limit 4) select x.t as a, y.t as b, count(*) as n_both, any_value(cx.n) + any_value(cy.n) - count(*) as n_either, round(count(*) / cast(any_value(cx.n) + any_value(cy.n) - count(*) as double), 8) as jaccard from m x join m y on x.user_id = y.user_id and x.t < y.t join c cx on cx.t = x.t join c cy on cy.t = y.t group by 1, 2")
def tag_overlap(spark, d):
    return audits.tag_overlap(table(spark, d, "events"), "user_id", "event_type", 4)


@query("select o_orderstatus = 'P' as part, o_orderpriority, count(*) as n, round(count(*) / cast(sum(count(*)) over (partition by o_orderstatus = 'P') as double), 8) as share from orders group by 1, 2")
def selection_shares(spark, d):
    return audits.column_shares(table(spark, d, "orders"), F.col("o_orderstatus") == "P", "o_orderpriority")


@query("with lo as (select 'low' as side, o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 20), hi as (select 'high' as side, o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20) select *, case when o_totalprice < 1500 then 'doubtful' else 'plausible' end as verdict from (from lo union all from hi)")
def extreme_records(spark, d):
    verdict = audits.classified([("doubtful", F.col("o_totalprice") < 1500)], "plausible")
    return audits.extremes(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 20, verdict)


@query("with x as (select nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), '') as a, nullif(regexp_extract(html, '<html[^>]* lang=\"([a-z]{2})\"', 1), '') as b from pages) select case when a is null or b is null then 'unknown' when a = b then 'agrees' else 'differs' end as verdict, count(*) as n from x group by 1")
def stated_language_consistency(spark, d):
    part = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    a, b = part("url", "^https?://[^/]+/([a-z]{2})/"), part("html", '<html[^>]* lang="([a-z]{2})"')
    verdict = audits.classified([("unknown", a.isNull() | b.isNull()), ("agrees", a == b)], "differs")
    return table(spark, d, "pages").select(verdict.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("select p_partkey, contains(p_type, 'ECO') as flagged, concat('[\"', array_to_string(string_split(p_name, ' '), '\",\"'), '\"]') as tags from part")
def raw_tags(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_type").contains("ECO").alias("flagged"), F.to_json(F.split("p_name", " ")).alias("tags"))


@query(r"with w as (select distinct doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as term from documents), k as (select distinct unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as term from benchmark) select term, count(*) as n_rows from w where term not in (select term from k) group by 1 having count(*) >= 5")
def unknown_terms(spark, d):
    space = r"[\x20\x09-\x0D]+"
    known = audits.vocabulary(table(spark, d, "benchmark"), "text", space).select("term")
    found = audits.vocabulary(table(spark, d, "documents"), "text", space).where("n_rows >= 5")
    return found.join(known, "term", "left_anti")
