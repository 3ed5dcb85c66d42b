"""Every registered query against its SQL."""

import math
import pathlib
import re

import duckdb
import pytest

from noticeworks.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS FROM '{sf_small}/{name}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, sf_small, con, name):
    df = catalog.QUERIES[name](spark, sf_small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_registry_without_corpus_operators():
    """Nothing outside the corpus subpackage imports it."""
    root = pathlib.Path(catalog.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
