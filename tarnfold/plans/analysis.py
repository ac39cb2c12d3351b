"""Queries on statistics, text, keywords, records and features, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import features, records, stats, texts
from tarnfold.sources.files import page_links as links_of
from tarnfold.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
WORDS = ["the", "erth", "ing", "of", "que", "und", "licensed", "con"]
_WORDS = ", ".join(f"('{w}')" for w in WORDS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# statistics

_R = "(select {v} as v, count(*) as t, sum(count(*)) over (order by {v} rows unbounded preceding) - count(*) + (count(*) + 1) / 2.0 as r from {f} group by 1)"


@query(f"with rk as {_R.format(v='o_totalprice', f='orders')}, s as (select o_orderpriority as g, count(*) as n, sum(r) as sr from orders join rk on v = o_totalprice group by 1), q as (select count(*) as groups, cast(sum(n) as bigint) as n, sum(sr * sr / n) as q from s), ti as (select sum(cast(t as double) * t * t - t) as t from rk), h as (select groups, n, (12.0 / (cast(n as double) * (n + 1)) * q - 3 * (n + 1)) / (1 - ti.t / (cast(n as double) * n * n - n)) as h from q, ti) select groups, n, round(h, 6) as h, round((h - groups + 1) / (n - groups), 6) as epsilon2 from h")
def kruskal(spark, d):
    return stats.kruskal_wallis(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


_MW = f"with rk as {_R.format(v='c_acctbal', f='customer')}, s as (select c_mktsegment = 'BUILDING' as f, r, t, v from customer join rk on v = c_acctbal), a as (select count(*) filter (f) as n1, count(*) filter (not f) as n2, cast(sum(r) filter (f) as double) as r from s), ti as (select sum(cast(t as double) * t * t - t) as t from rk), u as (select n1, n2, r - n1 * (n1 + 1) / 2.0 as u, ti.t, n1 + n2 as n from a, ti)"


@query(f"{_MW} select n1, n2, round(u, 4) as u, round(2 * u / (n1 * n2) - 1, 6) as delta, round((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - t / (n * (n - 1.0)))), 6) as z, case when abs(2 * u / (n1 * n2) - 1) < 0.147 then 'negligible' when abs(2 * u / (n1 * n2) - 1) < 0.33 then 'small' when abs(2 * u / (n1 * n2) - 1) < 0.474 then 'medium' else 'large' end as effect from u")
def mann_whitney(spark, d):
    out = stats.mann_whitney(table(spark, d, "customer"), F.col("c_mktsegment") == "BUILDING", "c_acctbal")
    return out.withColumn("effect", stats.effect_label(F.col("delta")))


@query("with p as (select l_partkey, case when l_partkey % 7 = 0 then null else (l_partkey % 97) / 97.0 + l_partkey / 1e7 end as p from (select distinct l_partkey from lineitem)), m as (select *, count(p) over () as m, row_number() over (order by p nulls last) as k from p), r as (select *, p * m / k as raw from m) select l_partkey, case when p is not null then round(least(min(raw) over (order by p desc nulls last rows unbounded preceding), 1.0), 6) end as q from r")
def bh_fdr(spark, d):
    p = table(spark, d, "lineitem").select("l_partkey").distinct()
    k = F.col("l_partkey")
    p = p.withColumn("p", F.when(k % 7 != 0, (k % 97) / F.lit(97.0) + k / F.lit(1e7)))
    return stats.bh_fdr(p, "p").select("l_partkey", "q")


@query("with x as (select o_orderstatus as a, o_orderpriority as b, count(*) as o from orders group by 1, 2), g as (select ra.a, rb.b, coalesce(x.o, 0) as o, ra.n as ra, rb.n as rb, (select count(*) from orders) as n from (select o_orderstatus as a, count(*) as n from orders group by 1) ra cross join (select o_orderpriority as b, count(*) as n from orders group by 1) rb left join x on x.a = ra.a and x.b = rb.b) select max(n) as n, round(sum((o - ra * rb / cast(n as double)) ** 2 / (ra * rb / cast(n as double))), 6) as chi2, (count(distinct a) - 1) * (count(distinct b) - 1) as df from g")
def chi_square(spark, d):
    return stats.chi_square(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("with a as (select l_extendedprice as x, l_quantity as y from lineitem), r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from a) select count(*) as n, round(corr(rx, ry), 6) as rho from r")
def spearman(spark, d):
    return stats.spearman(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


@query("select o_orderpriority, count(o_totalprice) as n, round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 6) as std, min(o_totalprice) as min, round(quantile_cont(o_totalprice, 0.25), 6) as p25, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(quantile_cont(o_totalprice, 0.75), 6) as p75, round(quantile_cont(o_totalprice, 0.95), 6) as p95, max(o_totalprice) as max from orders group by 1")
def describe_groups(spark, d):
    return stats.describe(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")


@query("with e as (select list_sort(list_distinct([quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.75)])) as e from orders) select len(list_filter(e, lambda x: x < o_totalprice)) as bin, count(*) as n from orders, e group by 1")
def quantile_bins(spark, d):
    return stats.quantile_bins(table(spark, d, "orders"), "o_totalprice", 4, "bin").select(F.col("bin").cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


_G = "g as (select o_orderkey, o_orderpriority, o_totalprice as y, avg(o_totalprice) over (partition by o_orderstatus) as p from orders)"


@query(f"with {_G} select o_orderpriority, count(*) as n, round(avg(abs(y - p)), 4) as mae, round(sqrt(avg((y - p) ** 2)), 4) as rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) as r2 from g group by 1")
def regression_metrics(spark, d):
    o = table(spark, d, "orders").withColumn("guess", F.expr("avg(o_totalprice) over (partition by o_orderstatus)"))
    return stats.regression_metrics(o, "o_totalprice", "guess", "o_orderpriority")


@query("with c as (select l_quantity, count(*) as n from lineitem group by 1) select l_quantity, n, round(sum(n) over (order by l_quantity rows unbounded preceding) / cast(sum(n) over () as double), 8) as ecdf from c")
def ecdf(spark, d):
    return stats.ecdf(table(spark, d, "lineitem"), "l_quantity")


@query("with c as (select p_brand, count(*) as n from part group by 1) select p_brand, n, round(sum(n) over (order by n desc, p_brand rows unbounded preceding) / cast(sum(n) over () as double), 8) as cumulative from c")
def pareto(spark, d):
    return stats.pareto(table(spark, d, "part"), "p_brand")


@query("select 'o_orderstatus' as field, count(*) filter (o_orderstatus is null) as nulls, count(*) filter (trim(o_orderstatus) = '') as blanks, count(distinct o_orderstatus) as kinds, count(*) as rows from orders union all select 'o_custkey', count(*) filter (o_custkey is null), 0, count(distinct o_custkey), count(*) from orders")
def field_quality(spark, d):
    return stats.field_quality(table(spark, d, "orders"), ["o_orderstatus", "o_custkey"])


@query("with q as (select quantile_cont(o_totalprice, 0.01) as lo, quantile_cont(o_totalprice, 0.99) as hi from orders) select count(*) as n, round(avg(least(greatest(o_totalprice, lo), hi)), 4) as mean from orders, q")
def winsorised_mean(spark, d):
    return features.winsorised(table(spark, d, "orders"), "o_totalprice").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


_H = "cast(concat('0x', substr(md5(concat('42:', cast({} as varchar))), 1, 8)) as bigint) / 4294967296.0::double"


@query(f"with s as (select c_custkey, case when h < 0.70 then 'train' when h < 0.70 + 0.15 then 'valid' else 'test' end as split, o_totalprice from (select o_custkey as c_custkey, o_totalprice, {_H.format('o_custkey')} as h from orders)), m as (select quantile_cont(o_totalprice, 0.5) as am from s) select split, count(*) as n, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) as iqr, round(quantile_cont(o_totalprice, 0.5) - any_value(am), 4) as shift from s, m group by 1")
def group_split_drift(spark, d):
    return features.split_drift(features.group_split(table(spark, d, "orders"), "o_custkey"), "o_totalprice")


@query("select count(distinct o_custkey) as groups, cast(count(distinct o_custkey) filter (k > 1) as bigint) as leaks from (select o_custkey, count(distinct case when o_custkey % 10 = 3 and o_orderkey % 2 = 1 then 'moved' else 'stays' end) as k from orders group by 1)")
def group_split_leaks(spark, d):
    """M8, with faults planted: odd orders of some customers are moved to a split of their own."""
    rows = features.group_split(table(spark, d, "orders"), "o_custkey")
    moved = (F.col("o_custkey") % 10 == 3) & (F.col("o_orderkey") % 2 == 1)
    return features.split_leaks(rows.withColumn("split", F.when(moved, "moved").otherwise(F.col("split"))), "o_custkey")


@query(f"with r as (select o_orderpriority, (row_number() over (partition by o_orderpriority order by {_H.format('o_orderkey')}, o_orderkey) - 1) / cast(count(*) over (partition by o_orderpriority) as double) as s from orders) select o_orderpriority, case when s < 0.70 then 'train' when s < 0.70 + 0.15 then 'valid' else 'test' end as split, count(*) as n from r group by 1, 2")
def stratified_split(spark, d):
    return features.stratified_split(table(spark, d, "orders"), "o_orderkey", "o_orderpriority").groupBy("o_orderpriority", "split").agg(F.count("*").alias("n"))


@query(f"select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by {_H.format('o_orderkey')}, o_orderkey) as k, count(*) over (partition by o_orderpriority) as n from orders) where k <= greatest(20, floor(n * 0.01))")
def stratified_sample(spark, d):
    return features.stratified_sample(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 0.01, 20).select("o_orderkey", "o_orderpriority")


@query()
def bootstrap_mean(spark, d):
    return features.bootstrap(table(spark, d, "customer"), "c_custkey", "c_acctbal", 50)


@query()
def permutation_gain(spark, d):
    rows = table(spark, d, "part")
    return features.permutation_gain(rows, F.col("p_size") * 10 + 900, "p_retailprice", ["p_size"], "p_partkey")


@query()
def ridge_errors(spark, d):
    rows = features.group_split(table(spark, d, "lineitem"), "l_orderkey")
    train = rows.where("split = 'train'")
    a = features.Assembler(["l_quantity", "l_discount"], ["l_returnflag"]).fit(train)
    names = a.feature_names()
    out = features.evaluate(a.transform(train), a.transform(rows), names, "l_extendedprice")
    return stats.regression_metrics(out, "l_extendedprice", "guess", "split")


# text and keywords


@query("select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]{1,200}>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&ldquo;', '“'), '&rdquo;', '”'), '&middot;', '·'), '[\\t\\n\\f\\r ]+', ' ', 'g')) as plain from pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(texts.strip_html(F.col("html")), r"[\t\n\f\r ]+", " ")).alias("plain"))


@query("select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: not regexp_matches(x, '(?i)licensed|copyright|@|https?://')), chr(10)) as kept from documents")
def drop_boilerplate(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.drop_lines(F.col("text"), ["(?i)licensed|copyright", "@", "https?://"]).alias("kept"))


@query()
def clean_texts(spark, d):
    return table(spark, d, "pages").select("page_id", texts.clean_text(F.col("html")).alias("clean"))


@query("select doc_id, len(regexp_extract_all(text, '[0-9]+[.,]?[0-9]*')) as hits, regexp_replace(text, '[0-9]+[.,]?[0-9]*', ' ', 'g') as rest from documents")
def leak_removal(spark, d):
    clean, hits = texts.remove_until_clean(F.col("text"), ["[0-9]+[.,]?[0-9]*"])
    return table(spark, d, "documents").select("doc_id", hits.cast("long").alias("hits"), clean.alias("rest"))


_C = "t as (select conv_id, turn, regexp_extract_all(lower(text), '([a-z][a-z0-9+#.]*)') as w from conversations), p as (select conv_id, turn, w, lag(w) over (partition by conv_id order by turn) as o, lag(turn) over (partition by conv_id order by turn) as ot from t)"


@query(f"with {_C} select conv_id, turn, round(len(list_intersect(w, o)) / cast(nullif(len(list_distinct(list_concat(w, o))), 0) as double), 6) as jaccard from p where ot is not null")
def token_jaccard_pairs(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", texts.latin_tokens(F.col("text")).alias("w"))
    p = w.withColumn("o", F.expr("lag(w) over (partition by conv_id order by turn)"))
    return p.where("o is not null").select("conv_id", "turn", F.round(texts.jaccard(F.col("w"), F.col("o")), 6).alias("jaccard"))


@query(f"with {_C}, u as (select conv_id * 1000 + turn as id, unnest(w) as term from t), tf as (select id, term, count(*) as tf from u group by 1, 2), df as (select term, count(*) as df from tf group by 1 having count(*) >= 2), x as (select id, term, tf * (ln((1 + (select count(*) from t)) / cast(1 + df as double)) + 1) as w from tf join df using (term)), n as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from x), pr as (select conv_id * 1000 + turn as id, conv_id * 1000 + ot as oid from p where ot is not null) select id, round(sum(a.w * b.w), 6) as cosine from pr join n a using (id) join n b on b.id = oid and b.term = a.term group by 1")
def tfidf_cosine_pairs(spark, d):
    rows = table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    w = texts.tfidf(rows, "id", texts.latin_tokens(F.col("text")), 2, None)
    pairs = rows.withColumn("oid", F.expr("lag(id) over (partition by conv_id order by turn)")).where("oid is not null").select("id", "oid")
    a, b = w.alias("a"), w.select(F.col("id").alias("oid"), "term", F.col("w").alias("v"))
    return pairs.join(a, "id").join(b, ["oid", "term"]).groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("cosine"))


@query()
def edit_similarity_pairs(spark, d):
    p = table(spark, d, "conversations").withColumn("o", F.expr("lag(text) over (partition by conv_id order by turn)")).where("o is not null")
    return p.select("conv_id", "turn", F.round(texts.edit_similarity("text", "o"), 6).alias("similarity"))


_EMB = "p as (select vec_id, label, embedding as a, lag(embedding) over (partition by label order by vec_id) as b from embeddings), c as (select vec_id, label, round(list_cosine_similarity(a::double[], b::double[]), 4) as sim from p where b is not null)"


@query(f"with {_EMB} select vec_id, label, sim, round(1 - sim, 4) as distance from c")
def embedding_cosine_pairs(spark, d):
    p = table(spark, d, "embeddings").withColumn("b", F.expr("lag(embedding) over (partition by label order by vec_id)")).where("b is not null")
    p = p.select("vec_id", "label", F.round(texts.cosine(F.col("embedding"), F.col("b")), 4).alias("sim"))
    return p.withColumn("distance", F.round(1 - F.col("sim"), 4))


@query(f"with {_EMB}, q as (select quantile_cont(round(1 - sim, 4), 0.90) as p90, quantile_cont(round(1 - sim, 4), 0.95) as p95 from c) select label, count(*) as n, count(*) filter (round(1 - sim, 4) >= p90) as significant, count(*) filter (round(1 - sim, 4) >= p95) as extreme from c, q group by 1")
def significant_flags(spark, d):
    """T29, T35."""
    p = embedding_cosine_pairs(spark, d)
    q = p.agg(F.expr("percentile(distance, 0.90)").alias("p90"), F.expr("percentile(distance, 0.95)").alias("p95"))
    return p.crossJoin(F.broadcast(q)).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.expr("distance >= p90")).alias("significant"), F.count_if(F.expr("distance >= p95")).alias("extreme"))


_K = f"k as (select doc_id, lang, w as skill from documents, (values {_WORDS}) v(w) where regexp_matches(lower(text), '(^|[^A-Za-z0-9_+#])' || w || '($|[^A-Za-z0-9_+#])'))"


def _skills(spark, d):
    return texts.keyword_rows(table(spark, d, "documents"), "doc_id", "text", WORDS)


@query(f"with {_K} select doc_id, skill from k")
def keyword_membership(spark, d):
    return _skills(spark, d)


@query(f"with {_K}, n as (select skill, count(distinct doc_id) as n from k group by 1) select skill, n, cast(row_number() over (order by n desc, skill) as integer) as place, round(n / cast((select count(*) from documents) as double), 6) as share from n")
def skill_rank(spark, d):
    return texts.ranked_demand(_skills(spark, d), "doc_id", table(spark, d, "documents"))


@query(f"with {_K}, s as (select skill, count(*) as n from k group by 1), t as (select count(distinct doc_id) as t from k), j as (select x.skill as a, y.skill as b, count(*) as joint from k x join k y on x.doc_id = y.doc_id and x.skill < y.skill group by 1, 2 having count(*) >= 3) select a, b, joint, round(joint / cast(p.n + q.n - joint as double), 6) as jaccard, round(joint * t / cast(p.n * q.n as double), 6) as lift from j join s p on p.skill = a join s q on q.skill = b, t")
def cooccurrence(spark, d):
    return texts.cooccurrence(_skills(spark, d), "doc_id", 3)


@query(f"with {_K}, z as (select lang, count(*) as size from documents group by 1) select k.lang, skill, count(distinct doc_id) as n, round(count(distinct doc_id) / cast(any_value(size) as double), 6) as share from k join z on z.lang = k.lang group by 1, 2")
def skill_matrix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    return texts.share_matrix(_skills(spark, d).join(docs, "doc_id"), "doc_id", "lang", sizes)


@query(f"with {_K}, c as (select d.doc_id, least(5, count(k.skill)) as bucket, any_value(n_chars) as v from documents d left join k on k.doc_id = d.doc_id group by 1) select cast(bucket as integer) as bucket, count(*) as n, round(quantile_cont(v, 0.5), 4) as median from c group by 1")
def skill_count_buckets(spark, d):
    n = _skills(spark, d).groupBy("doc_id").agg(F.count("*").alias("k"))
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(n, "doc_id", "left").withColumn("bucket", F.least(F.lit(5), F.coalesce("k", F.lit(0)).cast("int")))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.expr("percentile(n_chars, 0.5)"), 4).alias("median"))


@query(f"with {_K}, f as (select w as skill, d.doc_id, n_chars as v, exists (select 1 from k where k.doc_id = d.doc_id and k.skill = w) as f from documents d, (values {_WORDS}) x(w)), r as (select *, rank() over (partition by skill order by v) + (count(*) over (partition by skill, v) - 1) / 2.0 as r from f), s as (select skill, count(*) filter (f) as n1, count(*) filter (not f) as n2, sum(r) filter (f) as sr from r group by 1) select skill, n1, n2, round(sr - n1 * (n1 + 1) / 2.0, 4) as u, round(2 * (sr - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 6) as delta from s where n1 > 0 and n2 > 0")
def skill_value_assoc(spark, d):
    """Documents are ranked once; each skill's U comes from its members' rank sum."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    ranks = docs.join(stats.value_ranks(docs, "n_chars"), "n_chars").select("doc_id", "rank")
    total = docs.agg(F.count("*").alias("total"))
    s = _skills(spark, d).join(ranks, "doc_id").groupBy("skill").agg(F.count("*").alias("n1"), F.sum("rank").alias("r")).crossJoin(F.broadcast(total))
    s = s.withColumn("n2", F.col("total") - F.col("n1")).where("n1 > 0 and n2 > 0").withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2)
    return s.select("skill", "n1", "n2", F.round("u", 4).alias("u"), F.round(2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1, 6).alias("delta"))


@query()
def dictionary_matches(spark, d):
    m = texts.Matcher({"the": "article", "of the": "phrase", "licensed under": "license", "cc by-nc": "license"}, ["of the thor"], {"the": {"exclude": ["threat"]}})
    return texts.match_skills(table(spark, d, "documents"), "doc_id", "text", m)


# records


@query(r"select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^([^:]+://[^/?#]*)', 1)) || regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1), '([?&])(utm_source|utm_medium|utm_campaign|utm_term|utm_content|pcm|from|spm|ref|referer|share_token)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?'), '[?&]$', '') as url from pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", records.normalize_url(F.col("url")).alias("url"))


@query(r"select regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) as query, count(*) as n from pages group by 1")
def url_query_audit(spark, d):
    return table(spark, d, "pages").groupBy(records.url_query(F.col("url")).alias("query")).agg(F.count("*").alias("n"))


@query("select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) as segment from pages")
def url_last_segment(spark, d):
    return table(spark, d, "pages").select("page_id", records.last_segment(F.col("url")).alias("segment"))


@query("with p as (select distinct l_partkey as a, l_suppkey as b from lineitem), x as (select count(*) as k from p group by a), y as (select count(*) as k from p group by b) select * from (select count(*) as lefts, count(*) filter (k > 1) as left_to_many, max(k) as most_right from x), (select count(*) as rights, count(*) filter (k > 1) as right_to_many, max(k) as most_left from y)")
def mapping_audit(spark, d):
    return records.mapping_audit(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


_PAY = """t as (select p_partkey, p_partkey % 9 as k, cast(p_size as double) as s, case p_partkey % 9 when 0 then '薪资面议' when 1 then p_size || '/天' when 2 then (p_size + 50) || '-' || p_size || '/天'
  when 3 then p_size || '-' || (p_size + 50) when 4 then ' ' || p_size || '-' || (p_size + 50) || '/天' when 5 then p_size || '至' || (p_size + 50) || '元/日' when 6 then '约' || p_size || '/天，可面议'
  when 7 then '0~' || p_size || '.5元/天，13薪' else '' end as t from part)"""


def _pay(spark, d):
    s, more, k = F.col("p_size").cast("string"), (F.col("p_size") + 50).cast("string"), F.col("p_partkey") % 9
    forms = [["薪资面议"], [s, "/天"], [more, "-", s, "/天"], [s, "-", more], [" ", s, "-", more, "/天"], [s, "至", more, "元/日"], ["约", s, "/天，可面议"], ["0~", s, ".5元/天，13薪"], [""]]
    t = F.concat()
    for i, parts in enumerate(forms):
        t = F.when(k == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(t)
    return table(spark, d, "part").select("p_partkey", t.alias("t"))


@query(f"""with {_PAY}, v as (select p_partkey, k, case k when 1 then s when 2 then s + 50 when 4 then s when 5 then s when 7 then 0.0 end as low, case k when 1 then s when 2 then s when 4 then s + 50 when 5 then s + 50 when 7 then s + 0.5 end as high from t)
select p_partkey, low, high, (low + high) / 2 as mid, high - low as span, case when k in (0, 6) then '面议' when k in (3, 8) then '解析失败' else '已解析' end as status, cast(k in (0, 6) as integer) as negotiable,
  concat_ws('；', case when low > high then '上下限倒置' end, case when low <= 0 then '下限非正数' end, case when high <= 0 then '上限非正数' end) as anomaly from v""")
def salary_parse(spark, d):
    return _pay(spark, d).withColumns(records.parse_pay(F.col("t"))).drop("t")


@query(f"with {_PAY} select regexp_replace(t, '[0-9]+', '#', 'g') as shape, count(*) as n from t group by 1")
def shape_enum(spark, d):
    return _pay(spark, d).groupBy(records.shape(F.col("t")).alias("shape")).agg(F.count("*").alias("n"))


@query("with t as (select p_partkey, p_partkey % 3 as k, cast(p_size * 20 as double) as s from part), v as (select p_partkey, k, case k when 0 then s when 1 then 0.0 else s end as low, case k when 0 then s + 40 when 1 then s end as high, s from t), w as (select *, (low + high) / 2 as mid from v) select p_partkey, low, high, mid, case when k = 2 and low >= 2000 then 6 when k = 1 then 1 when mid is not null then 1 + cast(mid >= 15 as integer) + cast(mid >= 50 as integer) + cast(mid >= 150 as integer) + cast(mid >= 500 as integer) + cast(mid >= 2000 as integer) end as level, 1 as known from w")
def scale_parse(spark, d):
    k, s = F.col("p_partkey") % 3, F.col("p_size") * 20
    t = F.when(k == 0, F.concat(s.cast("string"), F.lit("-"), (s + 40).cast("string"), F.lit("人"))).when(k == 1, F.concat(F.lit("少于"), s.cast("string"), F.lit("人"))).otherwise(F.concat(s.cast("string"), F.lit("人以上")))
    return table(spark, d, "part").select("p_partkey", t.alias("t")).withColumns(records.parse_scale(F.col("t"))).drop("t")


@query("select s_suppkey, case s_suppkey % 4 when 0 then '上海' when 1 then '深圳' when 2 then '南京' else '' end as city from supplier")
def city_normalize(spark, d):
    k = F.col("s_suppkey") % 4
    t = F.when(k == 0, "上海,武汉").when(k == 1, "广东省/深圳市").when(k == 2, "江苏省南京市").otherwise("")
    return table(spark, d, "supplier").select("s_suppkey", records.normalize_city(t).alias("city"))


@query("with t as (select s_suppkey, s_suppkey % 5 as k from supplier) select s_suppkey, case k when 0 then 'FULL_SHIFT' when 1 then 'NATURE_ONLY' when 2 then 'SIZE_ONLY' when 3 then 'NOT_REPAIRABLE' else 'NONE' end as anomaly, case k when 0 then null when 1 then null when 2 then '民营企业' when 3 then '50-150人' else '民营企业' end as nature, case k when 0 then '50-150人' when 1 then '50-150人' when 2 then null when 3 then '' else '15-50人' end as size, case k when 0 then '上海' when 1 then '' when 2 then '上海' when 3 then '北京' else '杭州' end as place from t")
def slot_repair(spark, d):
    k = F.col("s_suppkey") % 5
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    rows = table(spark, d, "supplier").select("s_suppkey", pick("50-150人", "50-150人", "民营企业", "50-150人", "民营企业").alias("nature"), pick("上海", "", "上海", "", "15-50人").alias("size"), pick("", "", "", "北京", "杭州").alias("place"))
    return records.repair_slots(rows, "nature", "size", "place")


_RES = "b as (select lower(replace('Firm ' || (c_custkey % 400), ' ', '')) as norm, case when c_custkey % 400 < 100 then cast(c_nationkey as varchar) when c_custkey % 400 < 300 and c_custkey % 3 = 0 then '' else '0' end as place, case when c_custkey % 400 between 200 and 249 then 'shared ' || (c_custkey % 10) end as profile from customer)"


@query(f"with {_RES}, pl as (select norm, count(distinct nullif(place, '')) as places from b group by 1), sh as (select profile from b where profile is not null group by 1 having count(distinct norm) > 1), sn as (select distinct norm from b where profile in (select profile from sh)), g as (select norm, coalesce(place, '') as place, count(*) as rows from b group by 1, 2) select g.norm, place, rows, case g.norm when 'firm7' then 'Seven' when 'firm210' then 'Ten' else g.norm end as entity, case when g.norm in ('firm7', 'firm210') then 'APPROVED_ALIAS' when places > 1 then 'MULTI_LOCATION_AMBIGUOUS' when sn.norm is not null then 'HIGH_CONFIDENCE_MATCH' else 'EXACT_NORMALIZED_NAME' end as method, case when g.norm in ('firm7', 'firm210') then 0.95 when places > 1 then 0.7 when sn.norm is not null then 0.9 else 1.0 end::double as confidence, cast(g.norm in ('firm7', 'firm210') or places <= 1 and sn.norm is null as integer) as formal from g join pl using (norm) left join sn on sn.norm = g.norm")
def company_resolution(spark, d):
    k = F.col("c_custkey") % 400
    rows = table(spark, d, "customer").select(F.concat(F.lit("Ｆirm "), k.cast("string")).alias("name"), F.when(k < 100, F.col("c_nationkey").cast("string")).when((k < 300) & (F.col("c_custkey") % 3 == 0), "").otherwise("0").alias("place"), F.when(k.between(200, 249), F.concat(F.lit("shared "), (F.col("c_custkey") % 10).cast("string"))).alias("profile"))
    aliases = spark.createDataFrame([("Firm 7", "Seven"), ("ｆirm210", "Ten"), ("no such firm", "None")], "alias string, canonical string")
    return records.resolve_names(rows, "name", "place", "profile", aliases)


_SNAP = "s as (select user_id, date_trunc('hour', ts) as h, event_type, count(distinct event_id) as support from events where event_type <> 'view' or event_type is null group by 1, 2, 3), a as (select user_id, h, count(*) as candidates, max(support) as best, cast(sum(support) as bigint) as total, min(event_type) as one from s group by 1, 2), sn as (select user_id, h, case when candidates = 1 then 'CONSISTENT' else 'AMBIGUOUS' end as state, candidates, best as support, round(best / cast(total as double), 6) as rate, case when candidates = 1 then one end as profile from a)"


def _snapshots(spark, d):
    rows = table(spark, d, "events").where("event_type <> 'view'").withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return records.profile_snapshots(rows, "user_id", "h", "event_type", "event_id")


@query(f"with {_SNAP} select * from sn")
def profile_snapshot(spark, d):
    return _snapshots(spark, d)


@query(f"with {_SNAP}, r as (select *, sum(cast(state = 'AMBIGUOUS' as integer)) over (partition by user_id order by h rows unbounded preceding) as seen from sn), c as (select *, lag(profile) over w as op, lag(h) over w as oh, lag(seen) over w as was from r where state = 'CONSISTENT' window w as (partition by user_id order by h)) select user_id, oh as old_time, h as new_time, op as old_profile, profile as new_profile, cast(seen - was as bigint) as crossed from c where op is not null and op <> profile")
def ambiguous_crossings(spark, d):
    return records.crossed_snapshots(_snapshots(spark, d), "user_id", "h")


@query("select n_name, r_name from nation join region on r_regionkey = n_regionkey")
def leaf_to_root(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("n:"), "n_name").alias("child"), F.concat(F.lit("r:"), "r_name").alias("parent"))
    out = records.leaf_to_root(edges, "child", "parent")
    return out.select(F.substring("leaf", 3, 100).alias("n_name"), F.substring("top", 3, 100).alias("r_name"))


@query()
def page_links(spark, d):
    return links_of(table(spark, d, "pages"), "page_id", "html")
