"""Queries on versions, dedup and lifecycle, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators import dedup, lifecycle, versions
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


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.floor(F.col("value") / 50).alias("band"))
    return versions.assign_versions(rows, ["user_id"], ["ts", "event_id"], {"core": ["event_type"], "full": ["event_type", "band"]})


_V = """runs as (
  select user_id, ts, event_id, event_type, floor(value / 50) as band,
         case when event_type = lag(event_type) over w then 0 else 1 end as nc,
         case when event_type = lag(event_type) over w and floor(value / 50) is not distinct from lag(floor(value / 50)) over w then 0 else 1 end as nf
  from events window w as (partition by user_id order by ts, event_id)),
v as (select *, cast(sum(nc) over w as bigint) as core, cast(sum(nf) over w as bigint) as "full" from runs window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
grouped as (select user_id, core, min(ts) as first_time, max(ts) as last_time, count(*) as obs_count, count(distinct "full") as full_count, any_value(event_type) as event_type from v group by user_id, core),
h as (select *, lead(first_time) over (partition by user_id order by core) as next_time from grouped)"""
_DAYS = "round(cast(epoch_us({1}) - epoch_us({0}) as double) / 86400000000.0, 6)"


@query(f"with {_V} select user_id, event_id, core, \"full\" from v")
def two_level_versions(spark, d):
    return _versioned(spark, d).select("user_id", "event_id", "core", "full")


def _history(spark, d):
    return versions.version_history(_versioned(spark, d), "user_id", "ts", "event_id", "core", "full", ["event_type"])


@query(f"with {_V} select user_id, core, first_time, last_time, next_time, obs_count, full_count, {_DAYS.format('first_time', 'last_time')} as duration_days, {_DAYS.format('last_time', 'next_time')} as gap_days, case when next_time is null then 1 else 0 end as is_final, event_type from h")
def version_history(spark, d):
    return _history(spark, d)


@query(f"with {_V} select user_id, core, first_time, last_time, obs_count, event_type from h where next_time is null")
def final_version(spark, d):
    return versions.final_versions(_history(spark, d)).select("user_id", "core", "first_time", "last_time", "obs_count", "event_type")


@query(f"with {_V} select user_id, count(*) as obs_count, max(core) as core_versions, max(\"full\") as full_versions from v group by user_id")
def version_summary(spark, d):
    return versions.version_summary(_versioned(spark, d), "user_id", "core", "full")


@query(f"with {_V}, a as (select user_id, core, row_number() over (partition by user_id, event_type order by core) as nth from h) select user_id, count(*) as repeats, string_agg(cast(core as varchar), ',' order by core) as revert_versions from a where nth > 1 group by user_id")
def version_aba(spark, d):
    return versions.reverted_versions(_history(spark, d), "user_id", "core", ["event_type"])


@query("""with f as (select * from (select *, row_number() over (partition by user_id, ts order by event_id) as n from events) where n = 1),
r as (select user_id, ts, event_type, case when event_type = lag(event_type) over w then 0 else 1 end as nw from f window w as (partition by user_id order by ts, event_id)),
v as (select *, sum(nw) over (partition by user_id order by ts rows unbounded preceding) as core from r),
g as (select user_id, core, min(ts) as a, max(ts) as b from v group by 1, 2),
h0 as (select *, lead(a) over (partition by user_id order by core) as nx from g),
h as (select user_id, case when user_id % 10 = 1 and core >= 3 then core + 1 else core end as core, a, case when user_id % 10 = 2 and core = 2 then a - interval 1 day else b end as b, nx,
        case when user_id % 10 = 3 and core = 1 then 1 else cast(nx is null as integer) end as fin, epoch_us(b) - epoch_us(a) as dur from h0),
x as (select *, lead(core) over w as n_core, lag(b) over w as p_last, max(core) over (partition by user_id) as mx, count(*) over (partition by user_id) as cnt from h window w as (partition by user_id order by core))
select 'last before first' as rule, count(*) filter (b < a) as violations from x union all select 'next not after last', count(*) filter (nx <= b) from x
union all select 'versions not contiguous', count(*) filter (n_core <> core + 1) from x union all select 'overlap with previous', count(*) filter (p_last >= a) from x
union all select 'count is not the last number', count(*) filter (core = mx and cnt <> mx) from x union all select 'final is not last', count(*) filter ((fin = 1) <> (core = mx)) from x
union all select 'final has a next', count(*) filter (fin = 1 and nx is not null) from x union all select 'negative duration', count(*) filter (dur < 0) from x""")
def version_time_order(spark, d):
    """V14 on a history with distinct times per user, some of whose rows are given faults."""
    rows = dedup.first_rows(table(spark, d, "events"), ["user_id", "ts"], ["event_id"])
    v = versions.assign_versions(rows, ["user_id"], ["ts", "event_id"], {"core": ["event_type"], "full": ["event_type"]})
    h, some = versions.version_history(v, "user_id", "ts", "event_id", "core", "full", ["event_type"]), F.col("user_id") % 10
    h = h.withColumns({
        "is_final": F.when((some == 3) & (F.col("core") == 1), 1).otherwise(F.col("is_final")),
        "last_time": F.when((some == 2) & (F.col("core") == 2), F.col("first_time") - F.expr("interval 1 day")).otherwise(F.col("last_time")),
        "core": F.when((some == 1) & (F.col("core") >= 3), F.col("core") + 1).otherwise(F.col("core")),
    })
    return versions.time_order_problems(h, "user_id", "core")


@query(f"""with {_V}, d as (select event_id, core from v where event_id % 50 <> 7), s as (select event_id, core + cast(event_id % 100 = 3 as integer) as core from v where event_id % 50 <> 9)
select count(*) as compared, count(*) filter (s.event_id is null) as left_only, count(*) filter (d.event_id is null) as right_only, count(*) filter (d.core <> s.core) as core_differs from d full join s on d.event_id = s.event_id""")
def version_reconcile(spark, d):
    """Versions through the window against the history's spans, with faults planted on both sides."""
    v = _versioned(spark, d).select("user_id", "event_id", "core", "ts")
    spans = _history(spark, d).select(F.col("user_id").alias("u"), F.col("core").alias("span"), "first_time", "last_time")
    # Rows of one time can lie in two spans that meet there; either will do.
    hits = v.join(spans, (F.col("u") == F.col("user_id")) & F.col("ts").between(F.col("first_time"), F.col("last_time")))
    place = F.when(F.col("span") == F.col("core"), 0).otherwise(1)
    again = hits.groupBy("event_id").agg(F.min_by("span", place).alias("core")).where("event_id % 50 <> 9")
    again = again.withColumn("core", F.col("core") + (F.col("event_id") % 100 == 3).cast("int"))
    return versions.reconcile(v.select("event_id", "core").where("event_id % 50 <> 7"), again, ["event_id"], ["core"])


@query(f"with {_V}, s as (select user_id, count(*) as n from h group by user_id) select cast(count(*) as bigint) as entities, round(avg(n), 6) as mean_versions, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.95) as p95, max(n) as most from s")
def version_metrics(spark, d):
    """V17."""
    per = _history(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("entities"), F.round(F.avg("n"), 6).alias("mean_versions"), F.expr("percentile(n, 0.5)").alias("p50"), F.expr("percentile(n, 0.95)").alias("p95"), F.max("n").alias("most"))


def _orders(spark, d):
    w = "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)"
    return table(spark, d, "orders").withColumn("ver", F.expr(w))


_O = "o as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as ver from orders), p as (select *, lag(o_orderstatus) over w as os, lag(o_orderpriority) over w as op, lag(ver) over w as ov from o window w as (partition by o_custkey order by ver))"


@query(f"with {_O} select o_custkey, cast(ov as integer) as old_version, cast(ver as integer) as new_version, o_orderdate as change_time, 'o_orderstatus' as field, os as old_value, o_orderstatus as new_value from p where ov is not null and os is distinct from o_orderstatus union all select o_custkey, cast(ov as integer), cast(ver as integer), o_orderdate, 'o_orderpriority', op, o_orderpriority from p where ov is not null and op is distinct from o_orderpriority")
def change_events_cdc(spark, d):
    return versions.change_events(_orders(spark, d), "o_custkey", "ver", "o_orderdate", ["o_orderstatus", "o_orderpriority"])


@query(f"with {_O}, f as (select o_custkey, ver, (ov is not null and os is distinct from o_orderstatus) as a, (ov is not null and op is distinct from o_orderpriority) as b from p) select o_custkey, cast(ver as integer) as ver, concat_ws(',', case when a then 'o_orderstatus' end, case when b then 'o_orderpriority' end) as changed_list, cast(a as integer) + cast(b as integer) as changed_count, cast(a as integer) as o_orderstatus_changed, cast(b as integer) as o_orderpriority_changed from f")
def change_lists(spark, d):
    return versions.change_lists(_orders(spark, d), "o_custkey", "ver", ["o_orderstatus", "o_orderpriority"])


@query("with l as (select o_custkey, 'o_orderstatus' as field, count(distinct o_orderstatus) as k from orders group by 1 union all select o_custkey, 'o_orderpriority', count(distinct o_orderpriority) from orders group by 1) select field, cast(count(*) filter (k > 1) as bigint) as entities, max(k) as most from l group by field")
def multi_value_fields(spark, d):
    return versions.multi_value_stats(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("select l_orderkey, cast(date_trunc('month', l_shipdate) as date) as ship_month, count(*) as record_count, count(distinct l_returnflag) as n_flags, count(distinct l_suppkey) as n_suppliers, min(l_shipdate) as first_created, arg_min(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity)) as l_quantity, arg_min(l_linestatus, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity)) as l_linestatus from lineitem group by 1, 2")
def snapshot_collapse(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ship_month", F.to_date(F.date_trunc("month", "l_shipdate")))
    return versions.collapse_snapshots(rows, ["l_orderkey", "ship_month"], "l_shipdate", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["l_quantity", "l_linestatus"], {"n_flags": "l_returnflag", "n_suppliers": "l_suppkey"})


@query("with c as (select l_orderkey, cast(date_trunc('month', l_shipdate) as date) as ship_month, count(*) as record_count, count(distinct l_returnflag) as a, count(distinct l_linestatus) as b from lineitem group by 1, 2) select l_orderkey, ship_month, record_count, concat_ws(',', case when a > 1 then 'l_returnflag' end, case when b > 1 then 'l_linestatus' end) as fields from c where a > 1 or b > 1")
def snapshot_conflicts(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ship_month", F.to_date(F.date_trunc("month", "l_shipdate")))
    return versions.snapshot_conflicts(rows, ["l_orderkey", "ship_month"], ["l_returnflag", "l_linestatus"])


@query("with f as (select o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as first_value, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as last_value from orders group by 1) select *, round(last_value - first_value, 6) as drift from f")
def first_last_drift(spark, d):
    return versions.first_last(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


_S = """base as (select l_partkey, l_orderkey, l_linenumber, l_shipdate, l_quantity, cast(l_quantity > 10 as integer) + cast(l_discount > 0.02 as integer) + cast(l_tax > 0.01 as integer) as filled from lineitem),
r as (select *, row_number() over (partition by l_partkey order by filled desc, l_shipdate desc nulls last, l_quantity desc, l_orderkey, l_linenumber) as rk, count(*) over (partition by l_partkey) as records,
 count(*) over (partition by l_partkey, filled) as a, count(*) over (partition by l_partkey, filled, l_shipdate) as b, count(*) over (partition by l_partkey, filled, l_shipdate, l_quantity) as c from base)"""


@query(f"with {_S} select l_partkey, l_orderkey, l_linenumber, records, case when records = 1 then 'single' when a = 1 then 'completeness' when b = 1 then 'updated' when c = 1 then 'created' else 'order' end as reason from r where rk = 1")
def survivor_rank(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    filled = F.when(F.col("l_quantity") > 10, 1).otherwise(0) + F.when(F.col("l_discount") > 0.02, 1).otherwise(0) + F.when(F.col("l_tax") > 0.01, 1).otherwise(0)
    best = dedup.survivors(rows, "l_partkey", {"completeness": filled, "updated": F.col("l_shipdate"), "created": F.col("l_quantity")}, ["l_orderkey", "l_linenumber"])
    return best.select("l_partkey", "l_orderkey", "l_linenumber", "records", "reason")


def _members(spark, d):
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    return dedup.membership(rows.select("o_custkey", "p_brand", "p_type"), ["o_custkey", "p_brand", "p_type"])


_M = "m as (select o_custkey, p_brand, p_type, count(*) as hits from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where o_custkey is not null and p_brand is not null and p_type is not null group by all)"


@query(f"with {_M} select * from m")
def membership(spark, d):
    return _members(spark, d)


@query(f"with {_M}, g as (select o_custkey, p_brand, sum(hits) as n from m group by all), j as (select o_custkey, '{{' || string_agg('\"' || p_brand || '\":' || n, ',' order by p_brand) || '}}' as group_counts from g group by 1), b as (select o_custkey, string_agg(distinct p_brand, '|' order by p_brand) as groups, string_agg(distinct p_type, '|' order by p_type) as items, count(distinct p_brand) as n_groups, count(distinct p_type) as n_items, cast(sum(hits) as bigint) as hits from m group by 1) select b.*, group_counts from b join j using (o_custkey)")
def membership_sets(spark, d):
    return dedup.membership_sets(_members(spark, d), "o_custkey", "p_brand", "p_type")


@query(f"with {_M}, g as (select o_custkey, p_brand, cast(sum(hits) as bigint) as hits from m group by all) select o_custkey, p_brand, hits from (select *, row_number() over (partition by o_custkey order by hits desc, p_brand) as n from g) where n = 1")
def primary_category(spark, d):
    g = _members(spark, d).groupBy("o_custkey", "p_brand").agg(F.sum("hits").alias("hits"))
    return dedup.primary_item(g, "o_custkey", "p_brand")


@query(f"with {_M} select cast(count(distinct o_custkey) as bigint) as compared, cast(0 as bigint) as left_only, cast(0 as bigint) as right_only, cast(count(distinct o_custkey) filter (o_custkey % 20 = 3) as bigint) as hits_differs from m")
def membership_reconcile(spark, d):
    """Hits of the relation against hits counted from the rows, some of which are given one more."""
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    direct = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).groupBy("o_custkey").agg((F.count("*") + F.max((F.col("o_custkey") % 20 == 3).cast("long"))).alias("hits"))
    return versions.reconcile(_members(spark, d).groupBy("o_custkey").agg(F.sum("hits").alias("hits")), direct, ["o_custkey"], ["hits"])


@query("with c as (select o_custkey, count(*) as records, cast(count(distinct o_orderstatus) > 1 as integer) as a, cast(count(distinct o_orderpriority) > 1 as integer) as b, cast(count(distinct o_totalprice) > 1 as integer) as c from orders group by 1) select o_custkey, records, a + b + c as conflict_fields, greatest(a, b) as key_conflict from c")
def conflict_summary(spark, d):
    return dedup.conflict_summary(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])


@query("with b as (select o_custkey, o_orderpriority, o_orderkey, o_orderdate, o_totalprice from orders) select * exclude (n) from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) as n from b) where n = 1")
def upsert_latest(spark, d):
    """Orders of the first half as what there is, the rest as what comes in."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderdate", "o_totalprice")
    old = o.where("o_orderkey % 2 = 0")
    return dedup.upsert(old, o.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"], "at").drop("at")


@query("select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' union select o_custkey from orders where o_totalprice > 400000)")
def pending_tasks(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return dedup.pending(table(spark, d, "customer"), [o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 400000")], ["c_custkey"])


@query("select event_type, string_agg(distinct u, '|' order by u) as users from (select event_type, cast(user_id % 10 as varchar) as u from events) group by 1")
def union_of_lists(spark, d):
    rows = table(spark, d, "events").select("event_type", F.array((F.col("user_id") % 10).cast("string")).alias("users"))
    return dedup.union_of_lists(rows, "event_type", "users").select("event_type", F.array_join("users", "|").alias("users"))


# lifecycle


def _intervals(spark, d):
    ends = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, d, "orders").join(ends, "o_orderkey", "left")
    return o.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s"), F.greatest("o_orderdate", F.coalesce("shipped", "o_orderdate")).alias("e"), "o_orderstatus")


_I = "i as (select o_custkey, o_orderkey, o_orderdate as s, greatest(o_orderdate, coalesce(shipped, o_orderdate)) as e, o_orderstatus from orders left join (select l_orderkey, max(l_shipdate) as shipped from lineitem group by 1) on l_orderkey = o_orderkey)"
_E = _I + """, g as (select *, lag(e) over w as le, row_number() over w as rn from i window w as (partition by o_custkey order by s, o_orderkey)),
t0 as (select *, {gap} as gap_days from g),
t as (select *, case when rn = 1 then '' when gap_days >= 7 then 'T1' when gap_days > 0 then 'T2' else 'T3' end as tier from t0),
n as (select *, cast(1 + count(*) filter (tier = 'T1') over w as bigint) as strict_no, cast(1 + count(*) filter (tier in ('T1', 'T2')) over w as bigint) as relaxed_no from t window w as (partition by o_custkey order by s, o_orderkey rows unbounded preceding))"""
_EXACT = _E.format(gap=_DAYS.format("le", "s"))
_CALENDAR = _E.format(gap="date_diff('day', cast(le as date), cast(s as date))")


def _episodes(spark, d, **options):
    return lifecycle.assign_episodes(_intervals(spark, d), ["o_custkey"], "s", "e", "o_orderkey", **options)


@query(f"with {_EXACT} select o_custkey, o_orderkey, gap_days, tier, strict_no, relaxed_no from n")
def session_tiers(spark, d):
    return _episodes(spark, d).select("o_custkey", "o_orderkey", "gap_days", "tier", "strict_no", "relaxed_no")


@query(f"with {_CALENDAR} select o_custkey, o_orderkey, cast(gap_days as integer) as gap_days, tier, strict_no, relaxed_no from n")
def session_tiers_calendar(spark, d):
    return _episodes(spark, d, calendar=True).select("o_custkey", "o_orderkey", "gap_days", "tier", "strict_no", "relaxed_no")


@query(f"with {_CALENDAR}, x as (select k as threshold, o_custkey, count(*) filter (rn > 1 and gap_days >= k) + 1 as episodes from t, (values (3), (5), (7), (14)) v(k) group by all) select threshold, cast(count(*) as bigint) as entities, cast(sum(episodes) as bigint) as episodes from x group by 1")
def session_threshold_grid(spark, d):
    """All thresholds over one pass, the threshold being part of the partition."""
    grid = _intervals(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, (3, 5, 7, 14)))))
    rows = lifecycle.assign_episodes(grid, ["threshold", "o_custkey"], "s", "e", "o_orderkey", threshold=F.col("threshold"), calendar=True)
    per = rows.groupBy("threshold", "o_custkey").agg(F.max("strict_no").alias("k"))
    return per.groupBy("threshold").agg(F.count("*").alias("entities"), F.sum("k").alias("episodes"))


_AGG = "select o_custkey, {0}, min(s) as episode_start, max(e) as episode_end, count(*) as segments, count(*) filter (tier = 'T1') as n_t1, count(*) filter (tier = 'T2') as n_t2, count(*) filter (tier = 'T3') as n_t3, cast(date_diff('day', cast(min(s) as date), cast(max(e) as date)) + 1 as bigint) as days from n group by 1, 2"


@query(f"with {_EXACT} " + _AGG.format("strict_no"))
def episodes_strict(spark, d):
    return lifecycle.episodes(_episodes(spark, d), "o_custkey", "strict_no", "s", "e")


@query(f"with {_EXACT} " + _AGG.format("relaxed_no"))
def episodes_relaxed(spark, d):
    return lifecycle.episodes(_episodes(spark, d), "o_custkey", "relaxed_no", "s", "e")


@query(f"with {_I}, r as (select *, case when o_orderstatus = lag(o_orderstatus) over w then 0 else 1 end as nw from i window w as (partition by o_custkey order by s, o_orderkey)), q as (select *, cast(sum(nw) over (partition by o_custkey order by s, o_orderkey rows unbounded preceding) as bigint) as segment from r) select o_custkey, segment, min(s) as segment_start, max(e) as segment_end, count(*) as rows from q group by 1, 2")
def candidate_segments(spark, d):
    return lifecycle.segments(_intervals(spark, d), "o_custkey", "o_orderstatus", "s", "e", "o_orderkey")


@query(f"with {_I}, p as (select o_custkey, o_orderkey, unnest(generate_series(cast(s as date)::timestamp, cast(e as date)::timestamp, interval 1 day))::date as day from i where cast(e as date) >= cast(s as date)) select day, count(*) as rows, count(distinct o_custkey) as entities from p group by 1")
def daily_panel(spark, d):
    """Intervals and distinct entities active on a day."""
    return lifecycle.daily_actives(_intervals(spark, d), "o_custkey", "s", "e")


@query("select event_id, unnest(generate_series(cast(ts as date)::timestamp, cast(ts as date)::timestamp + to_days(cast(event_id % 5 as integer)), interval 1 day))::date as day from events")
def interval_panel(spark, d):
    """Every event's days, from its own to a few later."""
    rows = table(spark, d, "events").select("event_id", F.to_date("ts").alias("s"), F.date_add(F.to_date("ts"), (F.col("event_id") % 5).cast("int")).alias("e"))
    return lifecycle.daily_panel(rows, ["event_id"], "s", "e")


_A = _I + """, ev as (select cast(s as date) as day, 1 as a, 0 as c from i union all select cast(e as date) + 1, 0, 1 from i),
dd as (select day, sum(a) as a, sum(c) as c from ev group by 1),
sp as (select unnest(generate_series((select min(cast(s as date)) from i)::timestamp, (select max(cast(e as date)) from i)::timestamp, interval 1 day))::date as day),
series as (select sp.day, cast(coalesce(a, 0) as bigint) as new, cast(coalesce(c, 0) as bigint) as ended, cast(sum(coalesce(a, 0) - coalesce(c, 0)) over (order by sp.day rows unbounded preceding) as bigint) as active from sp left join dd on dd.day = sp.day)"""


@query(f"with {_A} select * from series")
def active_sweep(spark, d):
    return lifecycle.active_series(_intervals(spark, d), "s", "e")


@query(f"with {_A}, p as (select *, case when day(day) = 15 then ended + 1 else ended end as c, lag(active, 1, 0) over (order by day) as was from series) select cast(count(*) as bigint) as days, cast(count(*) filter (active <> was + new - c) as bigint) as broken, cast(sum(active) as bigint) as panel_rows from p")
def coverage_identity(spark, d):
    """N(t) = N(t-1) + A(t) - C(t) on every day, but for one a month that is given a fault."""
    rows = lifecycle.active_series(_intervals(spark, d), "s", "e").withColumn("was", F.expr("lag(active, 1, 0L) over (order by day)"))
    rows = rows.withColumn("ended", F.col("ended") + (F.dayofmonth("day") == 15).cast("int"))
    return rows.agg(F.count("*").alias("days"), F.count_if(F.expr("active <> was + new - ended")).alias("broken"), F.sum("active").alias("panel_rows"))


@query("with dd as (select cast(ts as date) as day, sum(value) as v from events group by 1) select day, round(v, 4) as v, round(quantile_cont(round(v, 4), 0.5) over (order by day rows between 6 preceding and current row), 6) as median_7, round(quantile_cont(round(v, 4), 0.5) over (order by day rows between 3 preceding and 3 following), 6) as centred_7, round(quantile_cont(round(v, 4), 0.5) over (order by day rows between 13 preceding and current row), 6) as median_14 from dd")
def rolling_medians(spark, d):
    rows = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))
    rows = lifecycle.rolling(rows, "v", "day", 6, 0, "median", "median_7")
    rows = lifecycle.rolling(rows, "v", "day", 3, 3, "median", "centred_7")
    return lifecycle.rolling(rows, "v", "day", 13, 0, "median", "median_14")


@query("select cast(date_trunc('month', o_orderdate) as date) as period, count(*) as n, round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.75), 4) as p75, cast(count(*) < 30 as integer) as small from orders group by 1")
def monthly_cohort(spark, d):
    return lifecycle.period_table(table(spark, d, "orders"), "o_orderdate", "month", "o_totalprice")


@query("select cast(date_trunc('quarter', o_orderdate) as date) as period, count(*) as n, round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.75), 4) as p75, cast(count(*) < 30 as integer) as small from orders group by 1")
def quarterly_cohort(spark, d):
    return lifecycle.period_table(table(spark, d, "orders"), "o_orderdate", "quarter", "o_totalprice")


@query("with dd as (select cast(o_orderdate as date) as day, count(*) as n from orders group by 1), c as (select *, sum(n) over (order by day rows unbounded preceding) as cum, sum(n) over () as total from dd), b as (select min(day) filter (cum >= 0.70 * total) as b1, min(day) filter (cum >= 0.85 * total) as b2 from c) select day, n, case when day < b1 then 'train' when day < b2 then 'valid' else 'test' end as split from c, b")
def temporal_split(spark, d):
    return lifecycle.temporal_split(table(spark, d, "orders"), "o_orderdate")


@query("with x as (select user_id, event_id, ts, case when event_id % 3 = 0 then value end as v from events) select user_id, event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as filled from x")
def forward_fill(spark, d):
    x = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return x.select("user_id", "event_id", lifecycle.forward_fill(F.col("v"), ["user_id"], ["ts", "event_id"]).alias("filled"))


@query("with c as (select cast(o_orderdate as date) as day, count(*) as n from orders group by 1), r as (select *, row_number() over (order by n desc, day) as p from c) select cast(count(*) as bigint) as kinds, cast(sum(n) as bigint) as total, cast(sum(n) filter (p <= 20) as bigint) as top, round(cast(sum(n) filter (p <= 20) as double) / sum(n), 6) as share from r")
def top_value_share(spark, d):
    return lifecycle.top_share(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day", 20)


@query("select cast(date_trunc('day', ts) as date) as day, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'purchase') as purchase from events group by 1")
def category_daily(spark, d):
    """A column a category, from a given list."""
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return rows.groupBy("day").agg(*[F.count_if(F.col("event_type") == c).alias(c) for c in ("click", "view", "purchase")])


@query(f"with {_EXACT}, ep as (select o_custkey, strict_no, min(s) as a, max(e) as b from n group by 1, 2), q as (select *, lag(b) over (partition by o_custkey order by strict_no) as pb, lead(strict_no) over (partition by o_custkey order by strict_no) as nx from ep) select 'overlapping' as rule, cast(count(*) filter (a <= pb) as bigint) as violations from q union all select 'not contiguous', cast(count(*) filter (nx <> strict_no + 1) as bigint) from q union all select 'T2 or T3 opens', cast(0 as bigint)")
def episode_integrity(spark, d):
    """L24."""
    rows = _episodes(spark, d)
    ep = lifecycle.episodes(rows, "o_custkey", "strict_no", "s", "e")
    q = ep.withColumns({"pb": F.expr("lag(episode_end) over (partition by o_custkey order by strict_no)"), "nx": F.expr("lead(strict_no) over (partition by o_custkey order by strict_no)")})
    opens = rows.withColumn("was", F.expr("lag(strict_no) over (partition by o_custkey order by s, o_orderkey)"))
    one = lambda rule, df, c: df.agg(F.count_if(F.expr(c)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    return one("overlapping", q, "episode_start <= pb").unionAll(one("not contiguous", q, "nx <> strict_no + 1")).unionAll(one("T2 or T3 opens", opens, "tier in ('T2', 'T3') and strict_no <> was"))
