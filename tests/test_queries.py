"""Every registered query against its SQL twin; those without one must at least run."""

import pytest

from fathom.plans import catalog, evidence, flow, leases, registry, summaries  # noqa: F401

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(name, agree):
    agree(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.FORMULA_SQL))
def test_formula(name, agree):
    agree(catalog.FORMULAS[name], catalog.FORMULA_SQL[name])


UNTWINNED = {n: f for n, f in (catalog.QUERIES | catalog.FORMULAS).items() if n not in catalog.SQL and n not in catalog.FORMULA_SQL}


@pytest.mark.parametrize("name", sorted(UNTWINNED))
def test_runs(name, spark):
    df = UNTWINNED[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_every_twin_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and set(catalog.FORMULA_SQL) <= set(catalog.FORMULAS) and not set(catalog.QUERIES) & set(catalog.FORMULAS)
