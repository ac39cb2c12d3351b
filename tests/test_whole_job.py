"""Operators do the whole job: no row caps or lost levels."""

from tarnfold.operators import features
from tarnfold.plans import analysis


def test_ridge_errors_reads_every_row(spark, tmp_path):
    rows = spark.range(120000).selectExpr("id div 4 as l_orderkey", "cast(id % 50 as double) as l_quantity", "cast(id % 11 as double) / 100 as l_discount", "cast(id % 3 as string) as l_returnflag", "cast(id % 50 * 1000 + id % 7 as double) as l_extendedprice")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = analysis.ridge_errors(spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == 120000 and len(got) == 3


def test_assembler_keeps_every_frequent_level(spark):
    rows = spark.range(2200).selectExpr("id", "concat('k', id % 1100) as level")
    assert len(features.Assembler(["id"], ["level"], least=2).fit(rows).levels["level"]) == 1100
