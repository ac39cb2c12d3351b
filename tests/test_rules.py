"""Hand-made cases of rules whose published results are known, and of their odd inputs."""

import pytest
from pyspark.sql import functions as F

from tarnfold.functions.exprs import canonical
from tarnfold.operators import lifecycle, postings, records, samples, stats, texts, versions


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_urls_lose_every_tracking_parameter_and_no_other(spark):
    track = ["pcm", "from", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "ref", "referer", "share_token", "PCM"]
    rows = [(f"https://A.example/x?id=1&{t}=2&source=3&channel=4",) for t in track]
    assert set(one(spark, rows, "u string", records.normalize_url(F.col("u")))) == {("https://a.example/x?id=1&source=3&channel=4",)}
    odd = [(" HTTP://B.example/p/ 1#frag ",), ("//C.example/q?a=",), ("",), (None,), ("   ",)]
    assert one(spark, odd, "u string", records.normalize_url(F.col("u"))) == [("http://b.example/p/ 1",), ("https://c.example/q?a=",), ("",), ("",), ("",)]


def test_pay_takes_the_first_two_numbers_of_a_text_with_a_unit(spark):
    cases = [
        ("150-300/天", 150.0, 300.0, "已解析", ""), ("150-300元/天", 150.0, 300.0, "已解析", ""), ("150至300/天", 150.0, 300.0, "已解析", ""), ("200/日", 200.0, 200.0, "已解析", ""),
        ("300-150/天", 300.0, 150.0, "已解析", "上下限倒置"), ("0/天", 0.0, 0.0, "已解析", "下限非正数；上限非正数"), ("150-300", None, None, "解析失败", ""), ("/天", None, None, "解析失败", ""),
        ("150/天，可面议", None, None, "面议", ""), ("", None, None, "解析失败", ""), (None, None, None, "解析失败", ""),
    ]
    p = records.parse_pay(F.col("t"))
    assert one(spark, [(t,) for t, *_ in cases], "t string", p["low"], p["high"], p["status"], p["anomaly"]) == [tuple(c[1:]) for c in cases]


def test_aliases_and_empty_places(spark):
    rows = [("Acme", "A", None), ("Acme", "", None), ("Beta", "A", None), ("Beta", "B", None), ("Gamma Co", "A", None), ("", "A", None)]
    alias = spark.createDataFrame([("gamma co", "Gamma")], "alias string, canonical string")
    got = {(r.norm, r.place): (r.method, r.confidence, r.formal, r.entity) for r in records.resolve_names(spark.createDataFrame(rows, "n string, p string, t string"), "n", "p", "t", alias).collect()}
    assert got["acme", ""] == got["acme", "A"] == ("EXACT_NORMALIZED_NAME", 1.0, 1, "acme")
    assert got["beta", "A"] == ("MULTI_LOCATION_AMBIGUOUS", 0.7, 0, "beta") and got["gammaco", "A"] == ("APPROVED_ALIAS", 0.95, 1, "Gamma")
    assert got["", "A"][0] == "UNRESOLVED"


def test_canonical_values_don_t_start_versions(spark):
    rows = [(1, 1, " a", 1.0, ["x", "y"]), (1, 2, "a", 1.0, ["y", "x", "x", ""]), (1, 3, "", 1.0, ["y", "x"]), (1, 4, None, 1.0, [" x", "y", None]), (1, 5, "b", 2.5, [])]
    df = spark.createDataFrame(rows, "e int, t int, s string, v double, l array<string>")
    out = versions.assign_versions(df, ["e"], ["t"], {"core": ["s", "v", "l"]})
    assert [r.core for r in out.orderBy("t").collect()] == [1, 1, 2, 2, 3]
    kinds = one(spark, rows, "e int, t int, s string, v double, l array<string>", canonical(F.col("v"), "double"), canonical(F.col("v").cast("decimal(9,2)"), "decimal(9,2)"))
    assert kinds[0] == ("1", "1") and kinds[4] == ("2.5", "2.5")


def test_cleaning_numbers_points_and_strips_bullets(spark):
    t = "● 熟悉　　java\r\n- a &amp; b<br/>c\n 1. 第一\n2) 第二\n\n\n\n​完 "
    assert one(spark, [(t,), (None,)], "t string", texts.clean_text(F.col("t"))) == [("熟悉 java\na & b c\n1、 第一\n2、 第二\n\n完",), ("",)]


def test_long_chains_reach_the_top_and_cycles_are_an_error(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)], "c string, p string")
    assert {r.top for r in records.leaf_to_root(chain, "c", "p").collect()} == {"n20"}
    with pytest.raises(ValueError):
        records.leaf_to_root(spark.createDataFrame([("a", "b"), ("b", "a")], "c string, p string"), "c", "p", most=16)


def test_daily_actives_equal_the_panel(spark):
    rows = [(1, "2024-01-01", "2024-01-05"), (1, "2024-01-04", "2024-01-09"), (1, "2024-01-20", "2024-01-20"), (2, "2024-01-05", "2024-01-06"), (2, "2024-01-07", "2024-01-08"), (3, "2024-02-02", "2024-02-01"), (3, None, None)]
    df = spark.createDataFrame(rows, "e int, s string, t string").select("e", F.to_date("s").alias("s"), F.to_date("t").alias("t"))
    panel = lifecycle.daily_panel(df, ["e"], "s", "t").groupBy("day").agg(F.count("*").alias("rows"), F.countDistinct("e").alias("entities"))
    assert sorted(map(tuple, panel.collect())) == sorted(map(tuple, lifecycle.daily_actives(df, "e", "s", "t").select("day", "rows", "entities").collect()))
    with pytest.raises(ValueError):
        lifecycle.daily_panel(df, ["e"], "s", "t", most_rows=3)


def test_running_sums_over_ranges(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 501).alias("x"), (F.col("id") % 3).alias("g"), F.lit(2).alias("v"))
    for within in ((), ("g",)):
        got = {r.x: r.b for r in stats.running(df, "x", "v", "b", *within, ranges=7).collect()}
        rows = df.collect()
        assert got == {r.x: sum(o.v for o in rows if o.x < r.x and (not within or o.g == r.g)) for r in rows}
    assert stats.running(df.limit(0), "x", "v", "b").count() == 0


def test_sections_and_requirements(spark):
    t = "公司很好\n一、岗位职责：写代码\n任职要求\n会 java\n3. 加分项: go\n任职资格：会 sql"
    s = postings.split_sections(F.col("t"))
    rows = spark.createDataFrame([(t,), ("没有标题",), ("  ",), (None,)], "t string").withColumn("s", s).withColumn("r", postings.requirement_of(F.col("t"), F.col("s"))).collect()
    assert rows[0].s.parts == {"职责": "写代码", "要求": "会 java\n会 sql", "加分": "go"} and (rows[0].s.status, rows[0].s.found) == ("完整", 4)
    assert (rows[0].r.scope, rows[0].r.text) == ("REQUIREMENT_SECTION", "会 java\n会 sql\ngo")
    assert [(r.s.status, r.r.scope, r.r.text) for r in rows[1:]] == [("未识别", "FULL_TEXT_FALLBACK", "没有标题"), ("未识别", "EMPTY_TEXT", ""), ("未识别", "EMPTY_TEXT", "")]


def test_assembly_refuses_a_side_with_two_rows_of_a_key(spark):
    base, side = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert samples.assembled(base, "k", [side.limit(1)]).count() == 2
    with pytest.raises(Exception, match="several rows of 1"):
        samples.assembled(base, "k", [side]).collect()
