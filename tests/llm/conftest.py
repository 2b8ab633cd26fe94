import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import CLASHING, SF, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, k, None, k, "x", 1, "g", 9, "y", 0.5, 1, 2, 3, "k")
            for k, (i, t) in enumerate(edge_rows())]
    return spark.createDataFrame(rows, CLASHING).coalesce(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows():
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    return list(zip(d["doc_id"], d["text"], strict=True))
