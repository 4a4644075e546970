"""Every query against DuckDB on the same tables."""

import duckdb
import pytest

from marram.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = sorted(set(QUERIES) & set(ORACLES))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if f != f else round(f, 6) + 0.0


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(ORACLES[name])
    head = [d[0] for d in rel.description]
    assert sorted(head) == columns
    theirs = sorted((tuple(plain(v) for v in (dict(zip(head, row, strict=True))[c] for c in columns)) for row in rel.fetchall()), key=str)
    assert ours == theirs
