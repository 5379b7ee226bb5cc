import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry_and_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    assert entry.entry(spark).count() > 0
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known)
    own = duckdb.connect()
    for name in os.listdir(FOLDER):
        own.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    for name in ("text_counts_by_lang", "mixture_order", "pack_blocks", "bpe_learn_k", "decontaminate", "spread_order"):
        got, want = known[name](spark, FOLDER), own.sql(sql[name])
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))
