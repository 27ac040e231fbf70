import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, ids string, stats string, row string, kind string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table with extra columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", "x", "x") for i, t in rows], DOCS).repartition(3)
    return make
