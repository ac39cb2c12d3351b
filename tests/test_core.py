"""Hand-made cases whose results follow from the rules, and registered queries against DuckDB."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarnfold.operators import dedup, lifecycle, records, stats, texts, versions
from tarnfold.operators.gates import Gates, compare_metrics

DATA = "/root/testdata/sf0.001"


def test_runs_and_reverts(spark):
    rows = spark.createDataFrame([("j", t, s) for t, s in enumerate("AABAA", 1)], "id string, t int, s string")
    v = versions.assign_versions(rows, ["id"], ["t"], {"core": ["s"]})
    assert [r.core for r in v.orderBy("t").collect()] == [1, 1, 2, 3, 3]
    rows = v.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    h = versions.version_history(rows, "id", "ts", "t", "core", None, ["s"])
    assert [r.obs_count for r in h.orderBy("core").collect()] == [2, 1, 2]
    assert versions.reverted_versions(h, "id", "core", ["s"]).collect()[0].revert_versions == "3"
    assert versions.time_order_problems(h, "id", "core").agg(F.sum("violations")).first()[0] == 0


def test_null_keys_start_runs(spark):
    rows = spark.createDataFrame([(1, 1, "d", 1), (1, 2, None, 1), (1, 3, None, 1), (1, 4, "d", 1)], "id int, s int, k string, e int")
    assert lifecycle.segments(rows, "id", "k", "s", "e", "s").count() == 4


def test_gap_tiers(spark):
    day = lambda m, d, h=0: dt.datetime(2024, m, d, h)
    spans = [(day(1, 1), day(1, 10)), (day(1, 12), day(1, 20)), (day(1, 19), day(1, 25)), (day(2, 1), day(2, 5)), (day(2, 5, 12), day(2, 9))]
    rows = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], "id int, n int, s timestamp_ntz, e timestamp_ntz")
    exact = lifecycle.assign_episodes(rows, ["id"], "s", "e", "n").orderBy("n").collect()
    assert [r.tier for r in exact] == ["", "T2", "T3", "T1", "T2"]
    assert [r.strict_no for r in exact] == [1, 1, 1, 2, 2]
    assert [r.relaxed_no for r in exact] == [1, 2, 2, 3, 4]
    calendar = lifecycle.assign_episodes(rows, ["id"], "s", "e", "n", calendar=True).orderBy("n").collect()
    assert (calendar[-1].tier, calendar[-1].relaxed_no) == ("T3", 3)


def test_coverage(spark):
    rows = spark.sql("select date'2024-01-01' s, date'2024-01-02' e union all select date'2024-01-02', date'2024-01-04'")
    got = lifecycle.active_series(rows, "s", "e").orderBy("day").collect()
    assert [(r.active, r.new, r.ended) for r in got] == [(1, 1, 0), (2, 1, 0), (1, 0, 1), (1, 0, 0)]


def test_survivors(spark):
    rows = spark.createDataFrame([("a", 3, 5, 1), ("a", 3, 4, 2), ("a", 2, 9, 3), ("b", 1, 1, 4), ("c", 1, None, 5), ("c", 1, None, 6)], "id string, f int, u int, n int")
    got = {r.id: (r.n, r.reason) for r in dedup.survivors(rows, "id", {"filled": F.col("f"), "updated": F.col("u")}, ["n"]).collect()}
    assert got == {"a": (1, "updated"), "b": (4, "single"), "c": (5, "order")}


def test_parsing(spark):
    rows = spark.createDataFrame([("150-300/天",), ("200/天",), ("薪资面议",), ("300-150/天",), ("0-0/天",), ("150-300",), ("",), (None,)], "t string")
    got = [(r.low, r.high, r.status, r.anomaly) for r in rows.select(*[c.alias(n) for n, c in records.parse_pay(F.col("t")).items()]).collect()]
    assert got[0] == (150, 300, "已解析", "") and got[1][:2] == (200, 200) and got[2][2] == "面议"
    assert got[3][3] == "上下限倒置" and got[4][3] == "下限非正数；上限非正数" and got[5][2] == got[6][2] == got[7][2] == "解析失败"
    sizes = spark.createDataFrame([("15-50人",), ("100-200",), ("少于15人",), ("2000人以上",), ("上海",)], "t string")
    got = [(r.low, r.high, r.level, r.known) for r in sizes.select(*[c.alias(n) for n, c in records.parse_scale(F.col("t")).items()]).collect()]
    assert got == [(15, 50, 2, 1), (100, 200, 4, 1), (0, 15, 1, 1), (2000, None, 6, 1), (None, None, None, 0)]
    cities = spark.createDataFrame([("徐州市",), ("上海,武汉",), ("广东省/深圳市",), ("江苏省南京市",), ("",)], "t string")
    assert [r[0] for r in cities.select(records.normalize_city(F.col("t"))).collect()] == ["徐州", "上海", "深圳", "南京", ""]


def test_url(spark):
    rows = spark.createDataFrame([("  HTTPS://WWW.A.com/intern/inn_1?pcm=x&k=1#f ",), ("",), (None,)], "u string")
    assert [r[0] for r in rows.select(records.normalize_url(F.col("u"))).collect()] == ["https://www.a.com/intern/inn_1?k=1", "", ""]


def test_statistics(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    assert [r.q for r in stats.bh_fdr(p, "p").orderBy("i").collect()] == [0.03, 0.04, 0.04, None]
    rows = spark.createDataFrame([(True, v) for v in (1, 2, 3)] + [(False, v) for v in (2, 3, 4)], "f boolean, v int")
    assert stats.mann_whitney(rows, F.col("f"), "v").first().delta == pytest.approx(-5 / 9, abs=1e-6)
    assert stats.chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and stats.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_text(spark):
    rows = spark.createDataFrame([("熟悉C++、C语言", "任职要求：会 Python\n熟悉 Spark\n福利：双休")], "a string, b string")
    m = texts.Matcher({"c++": "C++", "c语言": "C", "rag": "RAG"})
    assert m.counts("熟悉C++、C语言") == {"C++": 1, "C": 1} and m.counts("fragment") == {} and m.counts(None) == {}
    parts = rows.select(texts.sections(F.col("b"), {"require": ["任职要求"], "benefit": ["福利"]}).alias("x")).first().x
    assert parts["require"] == "会 Python\n熟悉 Spark" and parts["benefit"] == "双休"
    assert rows.select(texts.cjk_bigrams(F.lit("任a职要"))).first()[0] == ["任职", "职要"]


def test_gates():
    g = Gates({"rows": "rows must be there"})
    g.check("rows", True)
    with pytest.raises(AssertionError):
        g.check("rows", False)
    assert g.summary() == {"PASS": 1, "FAIL": 1, "NOT_RUN": 0}
    assert compare_metrics({"a": 1.0, "b": 2.0}, {"a": 1.0, "b": 3.0, "c": 1.0}, {"b"}) == {"a": "EQUAL", "b": "EXPECTED_CHANGE", "c": "MISSING"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", ["version_history", "membership_sets", "session_tiers", "active_sweep", "kruskal", "spearman", "cooccurrence", "company_resolution", "tfidf_cosine_pairs"])
def test_queries_match_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    show = lambda rows: sorted(repr([x for x in r]) for r in rows)
    assert show(got.select(*cols).collect()) == show(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_stream_matches_batch(spark, tmp_path):
    from tarnfold.streaming import events

    source = spark.read.parquet(f"{DATA}/events.parquet")
    source.withColumn("at", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.distinct_observations(stream, ["event_id"], "at", "1000 days").writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("seen").count() == source.select("event_id").distinct().count()
