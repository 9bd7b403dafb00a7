"""Every query with SQL gives the rows that DuckDB gives; the others run and have a stable schema."""

import pytest

import __spark_entry__
from pagelore.registry import ORACLES, QUERIES

from conftest import LARGER_DIR, SF_DIR, same
from pagelore.plans import annots, jobs, moves, search, writing

#: Queries whose results hang on single letters are also compared on the larger tables, which have letters that the small ones lack.
BY_LETTER = sorted({n for m in (annots, jobs, moves, search, writing) for n in m.ORACLES})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    same(QUERIES[name](spark, SF_DIR), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", BY_LETTER)
def test_against_sql_on_larger_tables(name, spark, duck_larger):
    same(QUERIES[name](spark, LARGER_DIR), duck_larger.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    frame = QUERIES[name](spark, SF_DIR)
    assert frame.columns
    assert frame.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
