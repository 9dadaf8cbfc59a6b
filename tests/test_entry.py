"""A few registered queries against DuckDB; the driver compares all of them."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.mark.parametrize("name", ["group_count_by_nation", "bgp_join2", "optional_plain", "minus_shared", "path_seq", "date_parts", "min_max", "graph_var"])
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    wanted = db.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, wanted))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
