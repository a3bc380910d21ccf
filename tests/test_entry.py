import importlib.util

import __spark_entry__ as entry


def test_names_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 40
    assert any(n.startswith("op10_") for n in queries) == bool(importlib.util.find_spec("silkloom.llm"))


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 200 and {r.root_id for r in rows} <= {r.seq_id for r in rows}
    assert len({r.root_id for r in rows}) == 173
