import duckdb
import pandas as pd
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("row", "size", "copies", "h", "skey", "bucket", "m", "failed", "ids", "decoded", "text_a", "node", "comp", "key", "at", "s", "b", "rank", "s1", "conv", "kept", "u")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]); clash adds columns with names that operators might use."""

    def docs(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in CLASH:
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return docs


@pytest.fixture(scope="session")
def duck():
    """Rows of a DuckDB query over tables given as data frames, as sorted tuples of the named columns."""

    def run(sql, columns, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df if isinstance(df, pd.DataFrame) else df.toPandas())
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        return rows_of([dict(zip(names, r)) for r in got.fetchall()], columns)

    return run


def rows_of(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="session")
def table_rows():
    return lambda df, columns: rows_of([r.asDict() for r in df.collect()], columns)


WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, blank, very long, equal and repeated texts, and null and repeated ids."""
    long = " ".join(WORDS[i * i % 40] + str(i % 977) for i in range(30_000))
    same = " ".join(WORDS[:30])
    return [(1, None), (2, ""), (3, " \n\t "), (4, long, "b"), (5, same, None), (6, same), (6, same), (7, same + " x"), (None, "just some words", None), (None, None), (8, "One\nline\n\nand more")]
