"""Every query with an oracle against DuckDB; the others run and are stable in their schema."""

import glob
import math
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from hitstream.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from read_parquet('{path}')")
    return con


def plain(rows, names):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, db, small, name):
    df = QUERIES[name](spark, small)
    got = plain(df.collect(), df.columns)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert got == plain(cursor.fetchall(), names)
    assert got or name in ("best_run_overlap",)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() > 0 and df.schema == QUERIES[name](spark, small).schema


def against_own(spark, path, name, table, rows):
    """The query over a table of its own against its SQL."""
    con = duckdb.connect()
    con.execute(f"create table {table} as select * from read_parquet('/root/testdata/sf0.001/{table}.parquet') limit 0")
    con.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
    con.execute(f"copy {table} to '{path}/{table}.parquet'")
    df = QUERIES[name](spark, str(path))
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), names)


def test_saturating_sums_of_summands_beyond_a_long(spark, tmp_path):
    keys = [(1, 2305), (2, 2306), (3, 14_999), (8_999, 900_000), (5, 0), (9_000, 7), (6, 2**62), (7, None)]
    against_own(spark, tmp_path, "saturating_sums", "orders", [(k, c, "O", 1.0, datetime(1998, 2, 6), "x") for k, c in keys])


def test_saturating_sums_has_every_order(spark, tmp_path):
    keys = [(1, 2), (8_999, 0), (9_000, 0), (9_223, 93), (9_224, 0), (150_000, 14_999), (2**63 - 1, 2**63 - 1), (-5, 3), (None, 4), (None, None)]
    against_own(spark, tmp_path, "saturating_sums", "orders", [(k, c, "O", 1.0, datetime(1998, 2, 6), "x") for k, c in keys])
    assert QUERIES["saturating_sums"](spark, str(tmp_path)).count() == len(keys)


@pytest.mark.parametrize("dus", [12, 19, 20, 45])
def test_max_clique_searches_windows_of_many_dus(spark, tmp_path, dus):
    """A DU every two minutes: light explains few of the differences, however many DUs there are."""
    con = duckdb.connect()
    con.execute("create table events as select * from read_parquet('/root/testdata/sf0.001/events.parquet') limit 0")
    con.execute(f"insert into events select i, timestamp '2024-01-05 00:00:00' + i * interval 2 minute, i, 'view', 90.0, '' from range({dus}) r(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    (row,) = QUERIES["max_clique"](spark, str(tmp_path)).collect()
    near = lambda a, b: (a + b) % 7 and (b - a) * 120 <= (b - a) * 3 + 10 + 60
    assert not any(near(a, b) for a in range(dus) for b in range(a + 1, dus))
    assert (row.hit_count, row.kept_count, row.reject_reason) == (dus, 1, "causal_subset_too_small")


def test_health_lines_of_any_time_of_day(spark, tmp_path):
    keys = [(2, 59_999), (3, 60_000), (4, 900_000), (12, 3_600_000), (13, 86_400_000), (14, 7), (11, 60_001), (15, None)]
    late = datetime(1998, 2, 6, 23, 59, 59, 999_000)
    against_own(spark, tmp_path, "health_lines", "orders", [(k, c, "O", 1.0, late if k == 14 else None if k == 3 else datetime(1998, 2, k), "x") for k, c in keys])


def test_health_lines_beyond_a_minute(spark, tmp_path):
    against_own(spark, tmp_path, "health_lines", "orders", [(k, 60_000 * k, "O", 1.0, datetime(1998, 2, 6), "x") for k in range(2, 30)])
