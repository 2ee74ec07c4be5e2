"""Every query with an oracle SQL text, Spark vs DuckDB on sf0.001."""
import pytest

import __spark_entry__ as E
from oracle_check import compare

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def results(spark, small_dir):
    return compare(spark, small_dir, KEYS, verbose=False)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(results, key):
    assert results[key][0] == "MATCH", results[key]
