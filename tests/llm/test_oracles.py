"""The opN queries against their DuckDB equivalents at sf0.01."""

import pytest
from tests.compare import same

from millrace.llm.oracles import ORACLES
from millrace.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir, duck):
    same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
