"""Twins on tables that the smallest given ones do not stand for: values of zero, tables of several files."""

import duckdb
import pytest
from oracle import compare, connect

import __spark_entry__ as entry

Q, O = entry.queries(), entry.oracle_sql()


def same(spark, name, sf, con):
    df = Q[name](spark, str(sf))
    rel = con.execute(O[name])
    got = df.collect()
    diff = compare(df.columns, got, [d[0] for d in rel.description], rel.fetchall())
    assert diff is None or diff.startswith("last digits"), diff
    return got


@pytest.mark.parametrize("price", ["CASE WHEN i % 300 = 3 THEN 0 ELSE 1 + i % 7 END", "CASE WHEN i < 90 THEN 0 ELSE 1 + i % 7 END"])
def test_microstructure_with_prices_of_zero(spark, tmp_path, price):
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 20 MINUTE * i AS ts, i % 5 AS user_id, 'click' AS event_type,
        CAST({price} AS DOUBLE) AS value, '' AS props FROM range(600) r(i)) TO '{tmp_path}/events.parquet'""")  # fmt: skip
    got = same(spark, "microstructure", tmp_path, connect(str(tmp_path)))
    assert len(got) == 200 and any(r.gk_vol_36 is not None for r in got) and all(r.gk_vol_36 != float("inf") for r in got)


@pytest.mark.parametrize("name,table", [("stream_dedup", "documents"), ("stream_bars", "events")])
def test_streams_read_tables_of_several_files(spark, sf, tmp_path, name, table):
    spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert same(spark, name, tmp_path, con)
