"""Hand-made cases of the audit operators: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from tarnfold.operators import audits


def test_mapping_conflicts(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c"), (None, "c"), (4, None), (3, "c")], "l int, r string")
    assert sorted(tuple(r) for r in audits.mapping_conflicts(rows, "l", "r").collect()) == [(1, "a", "left to many"), (1, "b", "both"), (2, "b", "right to many")]
    assert audits.mapping_conflicts(rows.limit(0), "l", "r").count() == 0


def test_tokens_and_tags(spark):
    texts = ['["https://x.y/i/gold.png", "http://x.y/new.png?v=2"]', "gold.png; other , ", None, "", "'https://x.y/a/gold.png'|https://x.y/gold.png"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(audits.link_tokens(F.col("t")).alias("k"))
    got = rows.select("k", audits.mapped_tags(F.col("k"), {"new": "N", "gold": "G"}).alias("g")).collect()
    assert [r.g for r in got] == [["N", "G"], ["G"], [], [], ["G"]]
    assert [len(r.k) for r in got] == [2, 2, 0, 0, 2]


def test_text_changes_and_classes(spark):
    rows = spark.createDataFrame([(1, "e", ["a", "b"]), (2, "e", ["a", "b", "b", "c"]), (3, "f", ["z"]), (4, "e", [])], "n int, e string, w array<string>")
    got = {r.n: tuple(r)[1:] for r in audits.text_changes(rows, ["e"], "n", F.col("w")).collect()}
    assert got == {2: (2, 3, 1, 0, 0.5, 0.66666667), 4: (3, 0, 0, 3, -1.0, 0.0)}
    label = audits.classified([("x", F.lit(None).cast("boolean")), ("y", F.col("n") > 1)], "z")
    assert [r.l for r in rows.orderBy("n").select(label.alias("l")).collect()] == ["z", "y", "y", "y"]


def test_samples_and_ranks(spark):
    rows = spark.createDataFrame([(i, float(i % 5), float(-i)) for i in range(20)], "k int, v double, w double")
    near = audits.nearest_to_quantiles(rows, "v", "k", [0.5], 2).orderBy("nth").collect()
    assert [(r.k, r.nth) for r in near] == [(2, 1), (7, 2)]
    assert audits.nearest_to_quantiles(rows.limit(0), "v", "k", [0.5], 2).count() == 0
    strata = [("low", F.col("k") < 3), ("any", F.col("k") < 10)]
    picked = audits.first_stratum_sample(rows, strata, "k", 5).collect()
    assert sorted(r.k for r in picked if r.stratum == "low") == [0, 1, 2] and sum(r.stratum == "any" for r in picked) == 5
    assert [tuple(r) for r in audits.rank_overlap(rows, "k", F.col("w"), F.col("w"), [3]).collect()] == [(3, 3)]


def test_encode_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, None), (5, "bb")], "k int, t string")
    cache = spark.createDataFrame([("a", [9])], "t string, vector array<int>").select(F.sha2("t", 256).alias("text_hash"), "vector")
    out = audits.encode_once(rows, "t", lambda x: x.select("text_hash", F.array(F.length("text")).alias("vector")), cache)
    assert {r.k: r.vector for r in out.collect()} == {1: [9], 2: [9], 3: None, 4: None, 5: [2]}
