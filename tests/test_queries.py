import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from webloom import queries as engine

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return tuple(sorted((k, plain(x)) for k, x in v.items())) if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(engine.QUERIES))
def test_equals_sql(spark, duck, name):
    got = engine.QUERIES[name](spark, str(DATA)).toArrow()
    if name not in engine.ORACLE_SQL:
        assert got.num_rows > 0
        return
    want = duck.execute(engine.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted((tuple(plain(r[c]) for c in columns) for r in t.to_pylist()), key=repr)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_text_operators():
    root = Path(engine.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
