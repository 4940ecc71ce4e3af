"""Registered queries against DuckDB on a few keys; the driver compares them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallyweir.plans import registry

TABLES = "customer orders lineitem part documents pages conversations".split()


def test_names_agree():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["panel_gate", "wf_splits", "challenge_matrix", "quote_quality", "sale_rule", "scan_summary"])
def test_matches_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    ours = sorted(repr([tidy(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert ours == sorted(repr([tidy(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in cur.fetchall())
