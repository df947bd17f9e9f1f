"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodestone import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 9) if isinstance(v, float) else v


def bag(df, columns):
    return sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in plans.ORACLE_SQL:
        want = duck.execute(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert bag(got, sorted(got.columns)) == bag(want, sorted(got.columns))


def test_engine_stands_without_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(plans.__file__).parents[1]
    assert not [f for f in root.rglob("*.py") if "llm" not in f.relative_to(root).parts and re.search(r"lodestone\.llm|corpus_pipeline", f.read_text())]
