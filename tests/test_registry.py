"""Registered queries against their SQL over the smallest tables, where those exist."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from recollect import registry

DATA = "/root/testdata/sf0.001"
HERE = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    found = con.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(found.columns)
    place = [found.columns.index(c) for c in cols]
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert mine == sorted((tuple(plain(r[k]) for k in place) for r in found.fetchall()), key=str)


def test_every_query_has_sql_but_those_named_here():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"bootstrap_ci", "store_context"}


def test_the_rest_imports_without_the_llm_package():
    code = "import sys; sys.modules['recollect.llm'] = None; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)
