"""The driver's contract: names, schemas, SQL of the media queries, and independence of the llm subpackage."""

import ast
from pathlib import Path

import pytest

from cutlist.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    own = duck.sql(catalog.ORACLE_SQL[name])
    cols = list(own.columns)
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in own.fetchall())
    assert got


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_llm_subpackage():
    for path in ROOT.joinpath("cutlist").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
