"""Models against direct solutions, chart tables and scans on odd rows, sources and stages."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tarnfold.operators import gates, models, reports, stats
from tarnfold.plans import models as plans
from tarnfold.sources import files


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 3))
    y = 2 + x @ [1.0, -3.0, 0.2] + rng.standard_t(2, 240)
    split = np.array(["train", "valid", "test"])[np.arange(240) % 3]
    rows = [(i, f"g{i % 17}", str(s), *map(float, a), float(b)) for i, (a, b, s) in enumerate(zip(x, y, split, strict=True))]
    frame = spark.createDataFrame([*rows, (900, "g1", "train", None, 1.0, 1.0, 1.0)], "k long, g string, split string, a double, b double, c double, y double")
    return frame.repartition(5), x, y, split


def ridge(x, y, penalty):
    d = np.column_stack([np.ones(len(x)), x])
    return np.linalg.solve(d.T @ d + penalty * np.diag([0.0] + [1.0] * x.shape[1]), d.T @ y)


def test_sums_of_products_give_every_ridge_and_every_subset(sample):
    rows, x, y, split = sample
    t = split == "train"
    sums = models.products(rows.where("split = 'train'"), ["a", "b", "c"], "y")
    assert np.allclose(models.ridge_from(sums, [0, 1, 2], 2.5), ridge(x[t], y[t], 2.5))
    part = models.ridge_from(sums, [0, 2], 1.0)
    assert part[2] == 0 and np.allclose(part[[0, 1, 3]], ridge(x[t][:, [0, 2]], y[t], 1.0))
    assert not models.products(rows.limit(0), ["a"], "y").any()


def test_grid_and_ablation_are_judged_on_the_right_split(sample):
    rows, x, y, split = sample
    t, v, e = (split == s for s in ("train", "valid", "test"))
    penalties = [0.1, 10.0, 1000.0]
    mae = lambda at, c, use=(0, 1, 2): np.abs(y[at] - (c[0] + x[at][:, use] @ c[1:])).mean()
    want = {p: mae(v, ridge(x[t], y[t], p)) for p in penalties}
    chosen, tried, final = models.grid_search(rows, ["a", "b", "c"], "y", penalties)
    assert chosen == min(want, key=want.get)
    assert {float(r.model): r.mae for r in tried.collect()} == {p: pytest.approx(m, abs=1e-4) for p, m in want.items()}
    one = final.collect()
    assert len(one) == 1 and one[0].mae == pytest.approx(mae(e, ridge(x[t], y[t], chosen)), abs=1e-4) and one[0].n == e.sum()
    got = {r.model: r.mae for r in models.ablation(rows, {"one": ["a"], "two": ["b", "c"]}, "y").collect()}
    assert got["all"] == pytest.approx(mae(e, ridge(x[t], y[t], 1.0)), abs=1e-4)
    assert got["without one"] == pytest.approx(mae(e, ridge(x[t][:, [1, 2]], y[t], 1.0), (1, 2)), abs=1e-4)
    assert got["without two"] > got["all"]


def test_median_regression_reaches_the_least_sum_of_errors(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=13).round(2), rng.normal(size=13).round(2) * 5
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    loss = lambda c: np.abs(y - c[0] - c[1] * x).sum()
    # A best line goes through two of the points.
    lines = [((y[i] * x[j] - y[j] * x[i]) / (x[j] - x[i]), (y[j] - y[i]) / (x[j] - x[i])) for i, j in itertools.combinations(range(13), 2) if x[i] != x[j]]
    assert loss(models.median_regression(rows, ["x"], "y", 40)) == pytest.approx(min(map(loss, lines)), rel=1e-3)
    assert not models.median_regression(rows.limit(0), ["x"], "y").any()


def test_contributions_and_intervals(sample):
    rows, x, y, _ = sample
    full = rows.where("a is not null")
    got = {r.feature: r.contribution for r in models.linear_contributions(full, ["a", "b"], np.array([1.0, 2.0, -3.0])).collect()}
    assert got == {"a": pytest.approx(np.abs(2 * (x[:, 0] - x[:, 0].mean())).mean(), abs=1e-5), "b": pytest.approx(np.abs(3 * (x[:, 1] - x[:, 1].mean())).mean(), abs=1e-5)}
    gain = models.paired_gain(full, "k", "y", 2 - 3 * F.col("b"), F.lit(2.0), 60).first()
    assert gain.n == 240 and 0 < gain.low < gain.delta < gain.high and gain.crosses_zero == 0
    both = {r.drawn: r for r in models.slope_intervals(full, "k", "g", "b", "y", 60).collect()}
    assert both["row"].units == 240 and both["cluster"].units == 17
    assert both["row"].slope == both["cluster"].slope == pytest.approx(np.polyfit(x[:, 1], y, 1)[0], abs=1e-5)
    assert all(r.low < r.slope < r.high for r in both.values())
    drawn = models.resampled(full.select("k"), "k", 40).groupBy("round").agg(F.sum("weight").alias("n")).collect()
    assert len(drawn) == 40 and abs(np.mean([r.n for r in drawn]) - 240) < 12


@pytest.mark.parametrize("values", [[], [3.0], [2.0, 5.0], [1.0] * 9 + [2.0] * 9, [1.0] * 30 + [2.0], [7.0, -1.0, -1.0, 0.0, -0.0, 4.0, 2.5], [1.0, float("nan"), float("nan")], [float("-inf"), 1.0, 4.0, float("inf")], [float(i * i % 97) for i in range(60)]])
def test_median_by_counts_is_exact(spark, values):
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    want = float(np.median(np.sort(values))) if values else None
    for few in (0, 4, 1000):
        got = stats.median(rows, "v", few)
        assert got is None if want is None else got == want or np.isnan(want) and np.isnan(got)


def test_paired_gain_holds_no_table_of_values_and_takes_one_hash_a_draw(spark, tmp_path):
    ran = lambda: spark._jsparkSession.sharedState().statusStore()
    spark.range(400).selectExpr("id as o_orderkey", "cast(id * id % 391 as double) as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    before = ran().executionsCount()
    got = plans.paired_gain(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert got.first().n == 400
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    told = ran().executionsList()
    plain = [told.apply(i).physicalPlanDescription() for i in range(told.size()) if told.apply(i).executionId() >= before]
    assert plain and not any("percentile(o_totalprice" in x for x in plain)


@pytest.mark.parametrize("prices", [[], [5.0], [None], [5.0, 7.5, None], [1.0, 2.0, 9.0, 9.0], [*[2.0**i for i in range(12)], None, None], [1.0, 4.0, float("nan")], [1.0, 4.0, 2.0, float("inf")]])
def test_paired_gain_equals_its_sql_on_odd_tables(spark, tmp_path, prices):
    rows = [(None if i == 3 else i // 2, v) for i, v in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    with duckdb.connect() as con:
        con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
        want = con.execute(plans.SQL["paired_gain"]).fetchall()
    assert repr([tuple(r) for r in plans.paired_gain(spark, str(tmp_path)).collect()]) == repr(want)


def test_chart_tables_and_scans_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, " x ", '["a", " b ", ""]', "eins\r\nzwei drei"), (2, "x", "a；b|, a", "drei\nvier\rdrei"), (3, "全国", "[broken", ""), (4, None, None, None), (5, " ", " ", "x")], "k long, v string, tags string, t string")
    assert [tuple(r) for r in reports.top_values(rows, "v", 2, ("全国",)).collect()] == [("x", 2)]
    assert {tuple(r) for r in reports.tag_counts(rows, "tags").collect()} == {("a", 3), ("b", 2), ("[broken", 1)}
    assert [tuple(r) for r in reports.flag_rate_of_top(rows, "v", F.col("k") == 1, 1).collect()] == [("x", 2, 1, 50.0)]
    assert [tuple(r) for r in reports.pattern_counts(rows, "t", {"d": ["drei", "DREI"], "n": ["nie"]}).collect()] == [("d", 2), ("n", 0)]
    assert sorted(tuple(r) for r in reports.line_scan(rows, "k", "t", "drei").collect()) == [(1, 2, "zwei drei"), (2, 1, "drei"), (2, 3, "drei")]
    assert {tuple(r) for r in reports.wording_scan(rows, ["v", "t"], ["drei", "x"], ["vier"], 4).collect()} == {("v", "x", " x ", 0), ("v", "x", "x", 0), ("t", "drei", "eins", 0), ("t", "drei", "drei", 1), ("t", "x", "x", 0)}
    assert tuple(reports.raw_validation(rows.limit(0), {"k": "key"}, ["q"], "k").first()) == (0, "t,tags,v", "", "q", 0, 0)


def test_sources_and_records(spark, tmp_path):
    path, rows = f"file://{tmp_path}/raw", spark.range(5)
    with pytest.raises(FileNotFoundError):
        files.load_or_export(spark, path, lambda: rows)
    assert files.load_or_export(spark, path, lambda: rows, reuse=False)[1] == "exported"
    assert files.load_or_export(spark, path, lambda: 1 / 0)[1] == "reused"
    again, how = files.load_or_export(spark, path, lambda: spark.range(7), force=True)
    assert (again.count(), how) == (7, "exported")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.5, 0.0])], "id long, v array<double>")
    meta = files.write_vectors(vectors, "id", "v", f"file://{tmp_path}/vec", {"model": "none"})
    back, told = files.read_vectors(spark, f"file://{tmp_path}/vec")
    assert told == meta == {"model": "none", "key": "id", "rows": 3, "dims": 2} and sorted(map(tuple, back.collect())) == [(1, [1.0, 2.0]), (2, None), (3, [0.5, 0.0])]
    with pytest.raises(ValueError):
        files.write_vectors(vectors.unionByName(spark.createDataFrame([(4, [1.0])], vectors.schema)), "id", "v", f"file://{tmp_path}/odd", {})
    files.write_json(rows, f"file://{tmp_path}/j")
    assert files.read_json(spark, f"file://{tmp_path}/j", StructType().add("id", LongType())).count() == 5
    files.write_sheets({"a": spark.createDataFrame([(["x", "y"],)], "l array<string>")}, f"file://{tmp_path}/s")
    sheet = files.read_sheets(spark, f"file://{tmp_path}/s", ["a"])["a"]
    assert sheet.schema["l"].dataType == StringType() and sheet.first()[0] == "x|y"
    one = files.with_section("# T\n\n## A\n\nold\n\n## B\n\nb\n", "A", "new")
    assert one == "# T\n\n## A\n\nnew\n\n## B\n\nb\n" == files.with_section(one, "A", "new")
    assert files.with_section(one, "C", "c").endswith("## B\n\nb\n\n## C\n\nc\n") and files.with_section("", "C", "c") == "## C\n\nc\n"


def test_stages_run_in_their_range_and_stop_behind_a_failure(tmp_path):
    g = gates.by_stage({"one": {"rows": "has rows"}, "two": {"keys": "keys are unique"}, "three": {"end": "ends"}})
    good = lambda name: lambda x: x.check(name, True)
    stages = [("one", good("one.rows")), ("two", lambda x: x.check("two.keys", False)), ("three", good("three.end"))]
    assert gates.run_stages(stages, g) == {"one": "DONE", "two": "FAILED", "three": "NOT_RUN"}
    assert gates.run_stages(stages, g, "one", "one") == {"one": "DONE", "two": "SKIPPED", "three": "SKIPPED"}
    assert g.summary() == {"PASS": 1, "FAIL": 1, "NOT_RUN": 0}
    with pytest.raises(ValueError):
        gates.run_stages(stages, g, "three", "one")
    (tmp_path / "a").write_bytes(b"abc")
    before = gates.manifest([f"{tmp_path}/a", f"{tmp_path}/b"])
    assert before[f"{tmp_path}/a"].startswith("ba7816bf") and before[f"{tmp_path}/b"] == "missing"
    (tmp_path / "b").write_bytes(b"")
    assert gates.changed(before, gates.manifest([f"{tmp_path}/a", f"{tmp_path}/b"])) == [f"{tmp_path}/b"]
