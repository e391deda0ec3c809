"""Every registered query of the evaluation operators against its SQL on another engine."""

import math

import duckdb
import pytest

from gaugemill import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else float(v) if type(v).__name__ == "Decimal" else v
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, other, name):
    df = queries.queries()[name](spark, SF)
    con = other.execute(queries.oracle_sql()[name])
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows([d[0] for d in con.description], con.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1] and mine[1]
