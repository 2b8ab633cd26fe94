"""The query catalogue: every registered query (Spark) and its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs over the whole fixture tables;
``ORACLES[name]`` is the equivalent SQL over the pre-registered views.  Column names agree,
integers are BIGINT/INTEGER alike on both sides, scores are rounded to 6 decimals and
timestamps are printed as ISO strings so that both sides hash the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from tessera.plans import q_documents  # noqa: F401
    from tessera.plans import q_vectors  # noqa: F401
    from tessera.plans import q_tables  # noqa: F401
    from tessera.plans import q_nlp  # noqa: F401
    from tessera.plans import q_ingest  # noqa: F401
