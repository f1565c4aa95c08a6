"""Registered queries over files against their SQL on the small tables."""

from pathlib import Path

import pytest

from sketchloom.plans import files

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(files.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = files.QUERIES[name](spark, str(DATA))
    expected = con.execute(files.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=key) == sorted(expected.fetchall(), key=key)


def test_matrices_of_many_sketches_are_refused(spark):
    from sketchloom.operators import pairs

    sizes = spark.range(5).selectExpr("id", "1 as size")
    with pytest.raises(ValueError):
        pairs.jaccard_matrix(spark.createDataFrame([], "i long, j long, intersection long"), sizes, most=4)


def test_spread(spark, tmp_path):
    from sketchloom.sources import readers

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/few")
    spark.range(100).repartition(9).write.parquet(f"{tmp_path}/many")
    few, many = (readers.spread(spark.read.parquet(f"{tmp_path}/{x}")) for x in ("few", "many"))
    assert few.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and few.count() == 100
    assert many._jdf.queryExecution().analyzed().toString().find("Repartition") < 0


def test_large_files_are_not_dealt_anew(spark, tmp_path):
    from sketchloom.sources import readers

    spark.range(20000).selectExpr("id", "sha2(string(id), 256) x").coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        table = spark.read.parquet(f"{tmp_path}/one")
        assert len(table.inputFiles()) == 1 and readers.spread(table) is table
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_suppliers_are_shuffled_once(spark, tmp_path, monkeypatch):
    from sketchloom.operators import grid_join

    sold = [(0, 1), (0, 2), (0, 2), (1, 1), (1, 2), (1, 3), (2, None), (2, 9), (2, 9), (7, 1), (7, 2), (None, 1)]  # 7 is not listed, 3 has sold nothing
    spark.createDataFrame(sold, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0,), (1,), (2,), (3,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    plans, write = {}, grid_join.written
    monkeypatch.setattr(grid_join, "written", lambda df, name: plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    found = files.selected_files(spark, str(tmp_path))
    assert [r.path for r in found.orderBy("id").collect()] == [f"/sketches/supplier{i}.sig" for i in (3, 2, 1)]
    assert list(plans) == ["grid-blocks"] and plans["grid-blocks"].count("Exchange") == 1 and "Window" not in plans["grid-blocks"]


def test_matrices_of_any_number_of_sketches_begin(spark):
    from sketchloom.operators import pairs

    sizes = spark.range(100_001).selectExpr("id", "1 as size")
    matrix = pairs.jaccard_rows(spark.createDataFrame([(0, 7, 1)], "i long, j long, intersection long"), sizes)
    first = matrix.where("line = 0").first()
    assert len(first.row) == 100_001 and [k for k, v in enumerate(first.row) if v] == [0, 7]


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_results_meet_names_by_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = files.search_results(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1  # pairs are shuffled to meet results, and for nothing else
