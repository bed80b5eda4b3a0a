"""Every core query that has SQL gives the same rows as that SQL."""

import pytest

from duoscope.plans import registry
from tests.conftest import DATA, same_rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    same_rows(spark, registry.queries()[name], SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0


def test_flagship(spark):
    rows = registry.flagship(spark, DATA).collect()
    assert rows and all(0 <= r["p_adjusted"] <= 1 and r["p_adjusted"] >= r["p_value"] - 1e-12 for r in rows)
