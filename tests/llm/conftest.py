import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark: SparkSession):
    """A documents table of (doc_id, text) rows, with the other columns and two that clash with names operators use."""
    def make(rows):
        full = [(d, t, "en", None, None if t is None else len(t), "x", 7) for d, t in rows]
        return spark.createDataFrame(full, f"{DOCS}, kept string, n int").repartition(3)
    return make


def words(n, seed=0):
    """n words, no two alike."""
    return [f"w{seed}x{k}" for k in range(n)]
