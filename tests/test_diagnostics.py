"""Odd rows of comparisons, diagnostics, histories, samples and encoders."""

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import corpus, diagnostics


def test_cells_and_columns(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, None, None), (3, "c", 3.0), (4, "d", 4.0)], "k long, t string, v double")
    new = spark.createDataFrame([(1, " a", 1.0), (2, " ", 2.0), (3, "x", 3.0), (5, "e", 5.0)], "k long, t string, v double")
    got = {r.field: (r.changed, r.unregistered) for r in diagnostics.cell_changes(old, new, "k", old.where("k = 3")).collect()}
    # Rows 4 and 5 are on one side only; row 3 is registered.
    assert got == {"t": (3, 2), "v": (3, 3)}
    assert {(r.changed, r.unregistered) for r in diagnostics.cell_changes(old.limit(0), new.limit(0), "k", old).collect()} == {(0, 0)}
    got = {r.field: tuple(r)[1:] for r in diagnostics.column_diagnostics(spark.createDataFrame([("a", None), ("a", None), ("b", None), (" ", None)], "x string, y double"), ["x", "y"], rare=2).collect()}
    assert got == {"x": (0.25, 2, 0.666667, 0, 1, 0.25), "y": (1.0, 0, None, None, 0, 0.0)}


def test_group_table_takes_lists_nulls_and_small_groups(spark):
    rows = spark.createDataFrame([(["a", "a", "b"], 1.0), (["a"], 3.0), (None, 9.0), ([], 9.0), (["b"], None)], "g array<string>, v double")
    assert [(r.level, r.n, r.median) for r in diagnostics.group_table(rows, "g", "v", least=2).collect()] == [("a", 2, 2.0)]
    one = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", 5.0)], "g string, v double")
    assert {(r.level, r.n, r.iqr) for r in diagnostics.group_table(one, "g", "v", least=1).collect()} == {("缺失", 2, 0.5), ("x", 1, 0.0)}


def test_histories_count_runs_and_jobs(spark):
    snaps = spark.createDataFrame([("e", 1, "CONSISTENT", "p"), ("e", 2, "AMBIGUOUS", None), ("e", 3, "CONSISTENT", "p"), ("e", 4, "CONSISTENT", "q"), ("e", 5, "CONSISTENT", "p"), ("f", 1, "MISSING", None)], "e string, t int, state string, profile string")
    rows = spark.createDataFrame([("e", 1, "j1"), ("e", 3, "j1"), ("e", 3, "j2"), ("e", 2, "j9"), ("e", 5, "j1")], "e string, t int, j string")
    got = sorted(tuple(r) for r in diagnostics.profile_history(snaps, rows, "e", "t", "j").collect())
    assert got == [("e", 1, "p", 1, 3, 2, 2), ("e", 2, "q", 4, 4, 1, 0), ("e", 3, "p", 5, 5, 1, 1)]


def test_samples_fill_up_and_rankings_compare(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    got = {r.k: r.stratum for r in diagnostics.filled_sample(rows, [("even", F.col("k") % 2 == 0), ("first", F.col("k") < 3)], "k", 6).collect()}
    # Row 0, 2 and 4 are the even ones; of the first only 1 is left; 3 and 5 fill up.
    assert got == {0: "even", 2: "even", 4: "even", 1: "first", 3: "filled", 5: "filled"}
    assert diagnostics.filled_sample(rows, [], "k", 50).count() == 10 and diagnostics.filled_sample(rows.limit(0), [], "k", 5).count() == 0
    a = spark.createDataFrame([("x", 9), ("y", 8), ("z", 7), ("only", 99)], "i string, s long")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "i string, s long")
    assert tuple(diagnostics.rank_robustness(a, b, "i", "s", (1, 3)).first()) == (3, 0, 2, -1.0)
    assert tuple(diagnostics.rank_robustness(a.limit(0), b, "i", "s", (1,)).first()) == (0, 0, None)


def test_encoders_are_there_or_say_why_not(spark):
    def missing():
        raise ImportError("no such model")

    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "  "), (4, " c ")], "k long, t string")
    away = diagnostics.load_encoder(missing)
    assert (away.status, away.reason) == ("NOT_RUN", "ImportError: no such model")
    with pytest.raises(RuntimeError):
        diagnostics.encode_texts(rows, "k", "t", away)
    there = diagnostics.load_encoder(lambda: lambda ts: [[len(t)] for t in ts])
    assert sorted(tuple(r) for r in diagnostics.encode_texts(rows, "k", "t", there).collect()) == [(1, [2.0]), (2, None), (3, None), (4, [1.0])]
    assert diagnostics.encode_texts(rows.limit(0), "k", "t", there).count() == 0


def test_a_corpus_loses_pay_and_boilerplate_and_keeps_raw_columns(spark):
    rows = spark.createDataFrame([(1, "薪资 100~200 元/天\n200元 / 月\n关注我们\n做 java", "x; y"), (2, None, None)], "id long, t string, g string")
    out = corpus.build_corpus(rows, "t", "g", {"java": "language"}, ["关注"])
    full, empty = out.orderBy("id").collect()
    assert (full.t, full.pay_hits, full.residue, full.tag_list, full.groups) == ("薪资 100~200 元/天\n200元 / 月\n关注我们\n做 java", 2, 0, ["x", "y"], ["language"])
    assert "关注" not in full.semantic and "200" in full.semantic and "200" not in full.safe and full.n_paragraphs == 4
    assert (empty.clean, empty.safe, empty.skills, empty.status, empty.n_tokens, empty.n_chars) == ("", "", [], "未识别", 0, 0)
    assert {r.measure: r.n for r in corpus.corpus_report(out.limit(0)).collect()}["rows"] == 0
