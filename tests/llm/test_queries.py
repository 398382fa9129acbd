"""Every registered query of the subpackage against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from turnloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(repr(r[i]) for i in order) for r in values])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found
    if name in queries.ORACLE_SQL:
        want = duck.execute(queries.ORACLE_SQL[name])
        assert found == rows([d[0] for d in want.description], want.fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k[: k.index("_") + 1] for k in names if k.startswith("op")}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
