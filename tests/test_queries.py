"""Every named query against its check SQL (or for rows where it has none) on the smallest tables."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}
# At this size these find nothing; the larger tables do.
MAY_BE_EMPTY = {"drops", "level_jumps", "duration_drift", "stream_job_monitor", "negated_terms", "beats_in", "speech_overlap", "voice_tracks", "inert_criteria"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def canonical(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else x + 0.0
        return x
    return sorted((tuple(cell(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, small, duck, name):
    df = entry_point.queries()[name](spark, small)
    cols = sorted(df.columns)
    rows = canonical(tuple(r) for r in df.select(*cols).collect())
    assert rows or name in MAY_BE_EMPTY
    check = entry_point.oracle_sql().get(name)
    if check is None:
        return
    types = {c: t for c, t, *_ in duck.execute("DESCRIBE " + check).fetchall()}
    assert {c: KINDS[t] for c, t in types.items()} == dict(df.dtypes)
    got = duck.execute(f"SELECT {', '.join(cols)} FROM ({check})").fetchall()
    assert rows == canonical(got)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
