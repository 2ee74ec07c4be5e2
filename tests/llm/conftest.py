import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts; source, lang and clashing extra columns can be given."""
    from tavola.llm.common import prepare
    prepare(spark)

    def make(texts, ids=None, lang=None, source=None, **more):
        n = len(texts)
        rows = list(zip(ids or range(n), texts, lang or [None] * n, source or ["s"] * n,
                        [None if t is None else len(t) for t in texts], *more.values()))
        schema = DOC_SCHEMA + "".join(f", {name} string" for name in more)
        return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)

    return make
