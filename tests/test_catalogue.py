"""Every registered query against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from meristem import catalogue


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, small, duck, name):
    got, want = catalogue.QUERIES[name](spark, small).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, float) for x in a) else all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_common_genes_of_every_cell(spark, tmp_path):
    """Twelve cells: gene 1 in cells 9 to 12 passes a share of 0.3, gene 2 in cells 1 to 3 does not."""
    rows = [(c, 1, 1.0) for c in (9, 10, 11, 12)] + [(c, 2, 1.0) for c in (1, 2, 3)] + [(c, 10 + c, 1.0) for c in range(1, 13)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [(r.member, r.n) for r in catalogue.QUERIES["common_genes"](spark, str(tmp_path)).collect()] == [(1, 4)]


@pytest.mark.parametrize("name", ["swnn_score", "sigma_square"])
def test_every_slice_pair(spark, small, name):
    assert {r.pair for r in catalogue.QUERIES[name](spark, small).select("pair").distinct().collect()} == {0, 1, 2}


def test_sinkhorn_plan_has_every_cell(spark, small):
    n = {r["g"]: r["n"] for r in spark.read.parquet(f"{small}/embeddings.parquet").selectExpr("vec_id % 4 AS g").groupBy("g").agg(F.count("*").alias("n")).collect()}
    plan = catalogue.QUERIES["sinkhorn_plan"](spark, small)
    assert {r["pair"]: r["n"] for r in plan.groupBy("pair").agg(F.count("*").alias("n")).collect()} == {g: n[g] * n[g + 1] for g in (0, 1, 2)}
