"""Rows in the same place: what the SQL leaves open is settled by the order of the table, as DuckDB does on one thread."""

from __future__ import annotations

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from ledgerloom import catalogue
from ledgerloom.plans import consolidate


def test_of_equal_places_the_first_line_counts(spark, tmp_path):
    # Orders of two lines with the same number and price, whose flags and quantities differ, in two files.
    lines = [(k // 2, 1, 1000.0, "AR"[k % 2] if k % 4 < 2 else "RA"[k % 2], float(7 + 6 * (k * 7 % 5))) for k in range(400)]
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    names = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_quantity")
    types = (pa.int64(), pa.int32(), pa.float64(), pa.string(), pa.float64())
    for n, part in enumerate((lines[:201], lines[201:])):
        columns = {c: pa.array(v, t) for c, v, t in zip(names, zip(*part, strict=True), types, strict=True)}
        pq.write_table(pa.table(columns | {"l_shipdate": pa.array([datetime.datetime(2024, 1, 1)] * len(part))}), folder / f"part-{n}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    ours = catalogue.queries()["coalesce_by_rank"](spark, str(tmp_path)).select("l_orderkey", "flag", "quantity")
    assert sorted(map(tuple, ours.collect())) == sorted(con.execute(catalogue.oracle_sql()["coalesce_by_rank"]).fetchall())


def test_without_an_order_equal_ranks_take_the_smallest_value(spark):
    rows = [(1, 5, "b"), (1, 5, "a"), (1, 5, "c"), (1, 4, None), (2, 1, "z"), (2, 2, "a")]
    for k in range(3):
        df = spark.createDataFrame(rows[k:] + rows[:k], "k int, rank int, v string")
        assert sorted(map(tuple, consolidate.merged(df, ["k"], "rank", ["v"]).collect())) == [(1, "a"), (2, "z")]
