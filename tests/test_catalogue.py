"""Every registered engine query against its SQL; those without run and give rows."""

import pytest

from millrace.plans import catalogue
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, con, name):
    df = catalogue.QUERIES[name](spark, small)
    if name in catalogue.SQL:
        assert_same(df, con, catalogue.SQL[name])
    else:
        assert df.count() > 0


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """More rows than the limits and ids of the queries that cut: 400 customers, 40 suppliers."""
    d = str(tmp_path_factory.mktemp("larger"))
    spark.sql("SELECT id + 1 AS c_custkey, concat('c', id) AS c_name, int(id % 25) AS c_nationkey, double(id * 7 % 90) AS c_acctbal, CASE id % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'OTHER' END AS c_mktsegment FROM range(400)").write.parquet(f"{d}/customer.parquet")
    spark.sql("SELECT id + 1 AS s_suppkey, concat('s', id) AS s_name, int(id % 25) AS s_nationkey, double(id) AS s_acctbal FROM range(40)").write.parquet(f"{d}/supplier.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 250 + 1 AS o_custkey, 'F' AS o_orderstatus, double(id) AS o_totalprice, timestamp_ntz'1995-01-01' AS o_orderdate, '1' AS o_orderpriority FROM range(600)").write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["values_left_join", "lateral_left_join", "null_placement"])
def test_whole_tables(spark, larger, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES[f"{name}_whole"](spark, larger)
    assert df.count() == 400
    assert_same(df, con, catalogue.SQL[f"{name}_whole"])


def test_kinship_of_all_pairs(spark, larger):
    from collections import Counter

    def paths(i, depth=0):
        return Counter({(i, depth): 1}) + sum((paths(p, depth + 1) for p in (i // 2, i // 3) if p), Counter())

    of = {i: paths(i) for i in range(1, 41)}
    want = {(a, b): round(sum(m * n * 0.5 ** (d + e + 1) for (x, d), m in of[a].items() for (y, e), n in of[b].items() if x == y), 9) for a in of for b in of if a != b}
    rows = catalogue.QUERIES["kinship_whole"](spark, larger).collect()
    got = {(r.l_id, r.r_id): r.kinship for r in rows}
    assert len(rows) == len(want) and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-8 for k, v in want.items())


def test_kinship_of_all_pairs_exchanges_no_pairs(spark, tmp_path):
    """Only the closure is exchanged, not a row for each pair and ancestor."""
    d = str(tmp_path)
    spark.sql("SELECT id + 1 AS s_suppkey, concat('s', id) AS s_name, int(id % 25) AS s_nationkey, double(id) AS s_acctbal FROM range(300)").write.parquet(f"{d}/supplier.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert catalogue.QUERIES["kinship_whole"](spark, d).where("kinship >= 0").count() == 300 * 299
    assert written() - before < 500_000
