import glob
import os

import pytest

import __spark_entry__ as spark_entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["line_graph_summary", "pearson_matrix_gappy", "time_interpolation_users",
                                  "iqr_outlier_counts", "duplicate_row_counts"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = spark_entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(spark_entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry(spark):
    assert spark_entry.entry(spark).count() == 3
