import inspect

import __spark_entry__ as entry


def test_contract(spark, data):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert all(list(inspect.signature(f).parameters)[:2] == ["spark", "d"] for f in q.values())
    rows = entry.entry(spark)
    assert rows.count() > 0 and "gap" in rows.columns


def test_general_queries_run_on_the_small_tables(spark, data):
    q = entry.queries()
    for name in ("p1_found", "p1_reasons", "p2_found", "p2_allele_stats", "leakage_flags", "hamming_join", "derive_anchors", "pae_blocks", "logo_logistic"):
        assert q[name](spark, data).count() >= 0
