"""Queries of the training-data operators that SQL can express, against their twins."""

import pytest

from fathom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(name, agree):
    agree(queries.QUERIES[name], queries.SQL[name])
