"""Every registered query against its oracle SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from pagetrail.plans.registry import QUERIES

TINY = "/root/testdata/sf0.001"
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(TINY).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, tmp_path, name):
    folder = TINY
    out = str(tmp_path / "out")
    QUERIES[name].run(spark, folder).write.parquet(out)
    got, want = con.sql(f"SELECT * FROM '{out}/*.parquet'"), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    a, b = con.sql(f"SELECT {columns} FROM got").fetchall(), con.sql(f"SELECT {columns} FROM want").fetchall()
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    assert order(a) == order(b)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["trial_id", "n_pages", "n_single", "n_reaccessed", "reaccess_probability"] and out.count() == 1


def test_samples(spark):
    for name in ("sample_balanced", "sample_natural"):
        rows = QUERIES[name].run(spark, TINY).collect()
        assert rows and all(r["e_ts"] > 0 and r["time_since_last_access_at_eviction"] > 0 for r in rows)
        if name == "sample_balanced":
            assert {r["label"] for r in rows} == {0, 1}
    split = QUERIES["sample_split"].run(spark, TINY)
    shares = {r["o_orderpriority"]: r for r in split.groupBy("o_orderpriority").agg({"is_test": "max"}).collect()}
    assert shares
    assert QUERIES["sample_choice"].run(spark, TINY).count() == 1000
