"""Queries on linear models, intervals, chart tables and scans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import features, models, reports, stats
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


def _u(text: str) -> str:
    return f"cast(concat('0x', substr(md5({text}), 1, 8)) as bigint) / 4294967296.0::double"


def _weight(u: str) -> str:
    """How often a round draws a row, from a number in [0, 1): the Poisson table of mean 1 worked out by hand."""
    chances = ("0.36787944117144233", "0.7357588823428847", "0.9196986029286058", "0.9810118431238462", "0.9963401531726563", "0.9994058151824183", "0.9999167588507119", "0.9999897508033253")
    return "(" + " + ".join(f"case when {u} >= {c} then 1 else 0 end" for c in chances) + ")"


_SPLIT = f"""s as (select *, case when h < 0.70 then 'train' when h < 0.70 + 0.15 then 'valid' else 'test' end as split
  from (select *, {_u("concat('42:', cast(o_custkey as varchar))")} as h from orders))"""


def _split(spark, d):
    return features.group_split(table(spark, d, "orders"), "o_custkey")


@query(f"""with {_SPLIT}, c as (select avg(o_totalprice) as mean, median(o_totalprice) as median from s where split = 'train'),
  g as (select split, o_totalprice as y, 'mean' as model, mean as g from s, c union all select split, o_totalprice, 'median', median from s, c)
  select split, model, count(*) as n, round(avg(abs(y - g)), 4) as mae, round(sqrt(avg((y - g) ** 2)), 4) as rmse, round(1 - avg((y - g) ** 2) / var_pop(y), 6) as r2 from g group by split, model""")
def constant_baselines(spark, d):
    """ML2, ML8."""
    return models.constant_baselines(_split(spark, d), "o_totalprice")


@query(f"""with m as (select avg(o_totalprice) as mean, median(o_totalprice) as median from orders),
  e as (select o_orderkey, abs(o_totalprice - median) - abs(o_totalprice - mean) as more from orders, m),
  w as (select round, more, {_weight("u")} as w from (select r.round, e.more, {_u("concat('42:', cast(r.round as varchar), ':', cast(o_orderkey as varchar))")} as u from e, range(1, 51) r(round))),
  b as (select round, sum(w * more) / sum(w) as delta from w group by round),
  i as (select round(quantile_cont(delta, 0.025), 6) as low, round(quantile_cont(delta, 0.975), 6) as high from b)
  select (select count(*) from e) as n, (select round(avg(more), 6) from e) as delta, low, high, case when low <= 0 and high >= 0 then 1 else 0 end as crosses_zero from i""")
def paired_gain(spark, d):
    """The mean against the median as a constant guess."""
    rows = table(spark, d, "orders")
    mean = rows.agg(F.avg("o_totalprice")).first()[0]
    return models.paired_gain(rows, "o_orderkey", "o_totalprice", F.lit(mean), F.lit(stats.median(rows, "o_totalprice")), 50)


_SLOPES = "with " + ", ".join(
    f"""{name}u as (select {unit} as unit, count(*)::double as n, sum(p_size)::double as sx, sum(p_retailprice) as sy, sum(p_size * p_size)::double as sxx, sum(p_size * p_retailprice) as sxy from part where {unit} is not null group by 1),
  {name}w as (select *, {_weight("u")} as w from (select *, {_u("concat('42:', cast(round as varchar), ':', cast(unit as varchar))")} as u from {name}u, range(1, 101) r(round))),
  {name}b as (select round, (sum(w * n) * sum(w * sxy) - sum(w * sx) * sum(w * sy)) / nullif(sum(w * n) * sum(w * sxx) - sum(w * sx) ** 2, 0) as s from {name}w where w > 0 group by round)"""
    for name, unit in (("row_", "p_partkey"), ("cluster_", "p_brand"))
)
_SLOPES += " union all ".join(
    f" select '{drawn}' as drawn, (select count(*) from {name}u) as units, (select round((sum(n) * sum(sxy) - sum(sx) * sum(sy)) / (sum(n) * sum(sxx) - sum(sx) ** 2), 6) from {name}u) as slope, round(quantile_cont(s, 0.025), 6) as low, round(quantile_cont(s, 0.975), 6) as high from {name}b"
    for name, drawn in (("row_", "row"), ("cluster_", "cluster"))
)


@query(_SLOPES)
def slope_intervals(spark, d):
    """ML6: rows against whole brands."""
    return models.slope_intervals(table(spark, d, "part"), "p_partkey", "p_brand", "p_size", "p_retailprice", 100)


def _lines(spark, d):
    """lineitem by splits of its orders, with features for models of the price."""
    rows = features.group_split(table(spark, d, "lineitem"), "l_orderkey")
    flags = {f"flag_{x}": (F.col("l_returnflag") == x).cast("int") for x in ("A", "N")}
    return rows.select("split", "l_extendedprice", "l_quantity", (F.col("l_quantity") * F.col("l_quantity")).alias("quantity2"), "l_discount", "l_tax", *[v.alias(k) for k, v in flags.items()])


_FEATURES = {"quantity": ["l_quantity", "quantity2"], "rates": ["l_discount", "l_tax"], "flags": ["flag_A", "flag_N"]}


@query()
def group_ablation(spark, d):
    """X1."""
    return models.ablation(_lines(spark, d), _FEATURES, "l_extendedprice")


@query()
def penalty_grid(spark, d):
    """ML3: errors of each penalty on the valid rows and of the chosen one on the test rows."""
    names = [c for g in _FEATURES.values() for c in g]
    _, tried, final = models.grid_search(_lines(spark, d), names, "l_extendedprice", [0.01, 1.0, 100.0, 10000.0])
    return tried.withColumn("split", F.lit("valid")).unionByName(final.withColumn("split", F.lit("test")))


@query()
def contribution_rank(spark, d):
    """X3 for a linear model."""
    names, rows = [c for g in _FEATURES.values() for c in g], _lines(spark, d)
    fitted = models.ridge_from(models.products(rows.where("split = 'train'"), names, "l_extendedprice"), list(range(len(names))), 1.0)
    return models.linear_contributions(rows.where("split = 'test'"), names, fitted)


@query()
def median_coefficients(spark, d):
    """ML5: median price over size and indicators of the types."""
    rows = table(spark, d, "part")
    kinds = sorted(r[0] for r in rows.where("p_type is not null").groupBy("p_type").agg(F.count("*").alias("n")).where("n >= 20").select("p_type").collect())[1:]
    some = rows.select(F.col("p_retailprice").alias("y"), "p_size", *[(F.col("p_type") == k).cast("int").alias(k) for k in kinds])
    names = ["p_size", *kinds]
    fitted = models.median_regression(some, names, "y", 25)
    return spark.createDataFrame(list(zip(["intercept", *names], [round(float(v), 3) for v in fitted], strict=True)), "variable string, coefficient double")


# tables behind charts, and scans


@query("select trim(p_brand) as value, count(*) as n from part where trim(p_brand) <> '' and trim(p_brand) not in ('Brand#1') group by 1 order by n desc, value limit 20")
def chart_top_values(spark, d):
    """F2."""
    return reports.top_values(table(spark, d, "part"), "p_brand", 20, ("Brand#1",))


@query("select 'ring' as name, count(*) filter (contains(p_name, 'ring')) as n from part union all select 'widget or red', count(*) filter (contains(p_name, 'widget') or contains(p_name, 'red')) from part union all select 'none', count(*) filter (contains(p_name, 'RING')) from part")
def chart_pattern_counts(spark, d):
    """F2."""
    return reports.pattern_counts(table(spark, d, "part"), "p_name", {"ring": ["ring"], "widget or red": ["widget", "red"], "none": ["RING"]})


@query("select p_brand as value, count(*) as total, count(*) filter (p_size > 25) as flagged, round(count(*) filter (p_size > 25) / count(*) * 100, 2) as rate from part where trim(p_brand) <> '' group by 1 order by total desc, value limit 15")
def chart_flag_rates(spark, d):
    """F2."""
    return reports.flag_rate_of_top(table(spark, d, "part"), "p_brand", F.col("p_size") > 25, 15)


@query("""with t as (select unnest(case p_partkey % 4 when 0 then [p_brand, p_type, ' '] when 1 then [p_brand, trim(p_type)] when 2 then [p_type] else [] end) as tag from part)
  select trim(tag) as tag, count(*) as n from t where trim(tag) <> '' group by 1""")
def chart_tag_counts(spark, d):
    """JSON lists, texts with separators, single tags and nothing."""
    b, t, k = F.col("p_brand"), F.col("p_type"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.to_json(F.array(b, t, F.lit(" ")))).when(k == 1, F.concat(b, F.lit("； "), t, F.lit(" "))).when(k == 2, t)
    return reports.tag_counts(table(spark, d, "part").select(text.alias("tags")), "tags")


@query("""with c as (select 'p_name' as field, p_name as text from part union select 'p_type', p_type from part)
  select field, concat_ws('、', case when contains(text, 'ring') then 'ring' end, case when contains(text, 'red') then 'red' end, case when contains(text, 'ECO') then 'ECO' end) as words, substr(text, 1, 80) as start,
  case when contains(text, 'small') or contains(text, 'blue') then 1 else 0 end as compliant from c where contains(text, 'ring') or contains(text, 'red') or contains(text, 'ECO')""")
def wording_scan(spark, d):
    """Q10."""
    return reports.wording_scan(table(spark, d, "part"), ["p_name", "p_type"], ["ring", "red", "ECO"], ["small", "blue"])


@query(r"""with l as (select doc_id, string_split_regex(text, '\r\n|\n|\r') as a from documents where contains(text, 'License')),
  e as (select doc_id, unnest(a) as t, unnest(range(1, len(a) + 1)) as line from l) select doc_id, line, trim(t, chr(32) || chr(9) || chr(11) || chr(12)) as content from e where contains(t, 'License')""")
def line_scan(spark, d):
    """Q11."""
    return reports.line_scan(table(spark, d, "documents"), "doc_id", "text", "License")


@query("""with t as (select case when o_orderkey % 100 = 7 then null when o_orderkey % 100 = 9 then o_orderkey - 1 else o_orderkey end as k from orders),
  p as (select k, count(*) as n from t group by k)
  select sum(n)::bigint as rows, 'o_custkey,o_orderpriority,o_orderstatus' as unmapped, 'gone' as unused, 'lost' as missing, coalesce(sum(n) filter (k is null), 0)::bigint as null_keys, count(*) filter (n > 1 and k is not null) as repeated_keys from p""")
def raw_validation(spark, d):
    """With planted null and repeated keys and a mapping that does not fit."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").withColumn("o_orderkey", F.when(k % 100 == 7, None).when(k % 100 == 9, k - 1).otherwise(k))
    mapping = {"o_orderkey": "id", "o_totalprice": "price", "o_orderdate": "day", "gone": "gone"}
    return reports.raw_validation(rows, mapping, ["o_orderkey", "lost"], "o_orderkey")
