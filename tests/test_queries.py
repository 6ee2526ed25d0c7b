"""Every registered query against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
from idsieve.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, list | tuple | np.ndarray):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, float):
        return str(round(x, 7) + 0.0)
    return str(x)


@pytest.fixture(scope="module")
def sql(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small_dir, sql, name):
    df = catalog.QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    have = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLE_SQL:
        assert have
        return
    got = sql.execute(catalog.ORACLE_SQL[name])
    named = [d[0] for d in got.description]
    assert sorted(named) == columns
    want = sorted(tuple(plain(r[named.index(c)]) for c in columns) for r in got.fetchall())
    number = lambda rows: [[str(float(v)) if v.replace(".", "", 1).replace("-", "", 1).isdigit() else v for v in r] for r in rows]
    assert number(have) == number(want)


def test_entry(spark, small_dir):
    assert entry_module.entry(spark).count() > 0


def test_entry_module_lists_the_catalog():
    assert set(catalog.QUERIES) <= set(entry_module.queries()) and set(catalog.ORACLE_SQL) <= set(entry_module.oracle_sql())


def test_library_does_not_use_the_optional_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "idsieve")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n)).read(), n
