"""Training-data operators: each module holds one operator, its query and, where SQL can express it, its SQL.

``queries()`` and ``oracle_sql()`` gather what the modules register. Modules are imported as they are asked for, so a
Python worker loads only those that its task needs.
"""

from importlib import import_module

MODULES = ("warc", "mix", "quality", "bpe", "chat", "ann", "shards", "linededup", "cotrain", "neardup", "filteraudit", "secretscan", "divergence")


def _modules():
    return [import_module(f".{name}", __name__) for name in MODULES]


def queries():
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
