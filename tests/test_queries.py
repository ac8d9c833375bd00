"""Every registered query over the smallest tables: its SQL's rows, or a run without SQL."""

import importlib.util
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

_spec = importlib.util.spec_from_file_location("compare", Path(__file__).resolve().parents[1] / "tools" / "compare.py")
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)

NAMES = sorted(n for n in entry.queries() if not n.startswith(("p7_", "p8_", "p9_")))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    ours = Counter(tuple(compare.cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    got = db.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert ours == Counter(tuple(compare.cell(r[i]) for i in order) for r in got.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_but_the_entry_needs_the_text_operators():
    root = Path(entry.__file__).parent
    for p in (root / "tidemark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tidemark.llm" not in p.read_text()
