import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def frame(spark):
    """Make a documents frame from (doc_id, text) rows, with clashing extra columns."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 0) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
