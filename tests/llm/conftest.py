import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) rows, with columns that clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", 0, "clash", 1) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words long"
        return spark.createDataFrame(full, schema).repartition(3)

    return make
