"""Queries against their SQL where tables are larger, or values lie between, than in the small supplied ones."""

import duckdb
import pytest

import veilwright.queries  # noqa: F401
from veilwright.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def both(spark, folder, name, tables):
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, str(folder))
    cur = con.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    return sorted(tuple(r[c] for c in names) for r in got.collect()), sorted(cur.fetchall())


@pytest.mark.parametrize("name, t, key", [("a7_k_anonymity", "customer", "c_custkey"), ("a27_k_anonymity_with_hierarchy", "part", "p_partkey"), ("r25_modified_rows", "customer", "c_custkey")])
def test_where_every_class_is_large(spark, tmp_path, name, t, key):
    got, want = both(spark, tmp_path, name, {t: f"SELECT x.* REPLACE ({key} + 1000000 * r.i AS {key}) FROM '{SF}/{t}.parquet' x, range(20) r(i)"})
    assert got == want and got


def test_improvements_that_end_in_a_half(spark, tmp_path):
    got, want = both(spark, tmp_path, "r26_risk_improvement", {"orders": "SELECT i AS o_orderkey, CAST((2 * i + 1) / 10 AS DECIMAL(15, 2)) AS o_totalprice FROM range(0, 1200000, 37) r(i)"})
    assert got == want and any(x for _, x in got)


def test_every_candidate_of_the_last_relaxation_is_a_pair(spark, tmp_path):
    tables = {"customer": f"SELECT x.* REPLACE (c_custkey + 1000000 * r.i AS c_custkey) FROM '{SF}/customer.parquet' x, range(3) r(i)", "supplier": f"SELECT * FROM '{SF}/supplier.parquet'"}
    got, want = both(spark, tmp_path, "d7_last_relaxation", tables)
    # A quarter of the suppliers has a nation that no customer has, and meets 500 customers; the others meet all of their nation.
    n, alone = duckdb.connect().execute(f"SELECT (SELECT count(*) FROM '{tmp_path}/supplier.parquet' JOIN '{tmp_path}/customer.parquet' ON s_nationkey = c_nationkey WHERE s_suppkey % 4 > 0), count(*) FILTER (s_suppkey % 4 = 0) FROM '{tmp_path}/supplier.parquet'").fetchall()[0]
    assert got == want and len(got) == len(set(got)) == n + 500 * alone and alone
