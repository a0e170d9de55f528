"""Every registered query with a statement equals it in DuckDB."""

import os

import pytest

from reviewloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = [r.asDict(recursive=True) for r in QUERIES[name](spark, SF).collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    expected = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    order = sorted(names)
    assert not rows or sorted(rows[0]) == order
    assert sorted(str([plain(r[c]) for c in order]) for r in rows) == sorted(str([plain(r[c]) for c in order]) for r in expected)
