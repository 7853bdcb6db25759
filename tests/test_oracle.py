"""Every core query that SQL can express, against DuckDB on the smallest tables."""

import math

import pytest

from lodestone.plans import registry


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float) and value == int(value):
        value = int(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(name, spark, data, duck):
    frame = registry.queries()[name](spark, data)
    columns = sorted(frame.columns)
    result = duck.execute(registry.oracle_sql()[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(name, spark, data):
    assert registry.queries()[name](spark, data).count() > 0
