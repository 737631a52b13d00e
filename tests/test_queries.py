"""Every registered query runs, and matches its SQL where there is some."""

import duckdb
import pytest

from beatframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    """Rows in a comparable form; numbers to six places."""

    def cell(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, int | float) or type(x).__name__ == "Decimal":
            x = float(x)
            return "nan" if x != x else f"{round(x, 6) + 0.0:.6f}"
        return str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    columns = ", ".join(f'"{c}"' for c in names)
    assert plain(got) == plain(duck.sql(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
