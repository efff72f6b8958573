"""Helpers of these tests: small DataFrames and DuckDB over them."""

import decimal
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, source="s", lang="en"):
    """Rows (doc_id, text) or texts alone, as documents."""
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], DOCS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def saved(tmp_path, **frames):
    """The frames as Parquet tables of a folder, read as the registered queries do."""
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


def same_as_sql(df, folder, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(found.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    place = [found.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[k]) for k in place) for r in found.fetchall()), key=str)
    assert mine == theirs
