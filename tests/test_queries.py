"""Every registered query of the library proper against its oracle, over whole tables."""

import pytest
from compare import connect, same

from chronolex import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, con, name):
    same(catalog.queries()[name](spark, sf_dir), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_runs_without_oracle(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
