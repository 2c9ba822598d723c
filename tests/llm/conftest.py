import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, id string, size int, key string, taken int, sig long, "
           "_id string, _tail int, _lines int, row int, rows int")
TAIL = ("x", 1, "k", 2, 3, "z", 4, 5, 6, 7)
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, 0, *TAIL)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    base = " ".join(f"alpha{i}" for i in range(60))
    rows = [row(1, None), row(2, ""), row(3, " \t\n"), row(4, LONG), row(5, LONG + " end"), row(6, base), row(7, base), row(7, base),
            row(8, base.upper(), None), row(9, "one two", None), row(10, "ONE  two", "b"), row(None, base, "b"), row(None, None, None),
            (11, base + " tail", None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 0), (9, 0, 0), (9, 0, 0), (4, 1, 1), (None, 1, 0), (2, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def con():
    import duckdb
    from tools.check import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c
