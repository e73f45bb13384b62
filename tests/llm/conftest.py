import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """Documents of (doc_id, text[, lang, source]) tuples."""
    return lambda rows, schema=SCHEMA: spark.createDataFrame([(*r, *[None] * (5 - len(r))) if schema == SCHEMA else r for r in rows], schema)
