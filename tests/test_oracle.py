"""Every registered query against its DuckDB oracle on the smallest fixture (the driver does
the same at sf0.01).  Queries without an oracle must at least run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from tessera.plans.catalog import QUERIES, load_all  # noqa: E402
from check_oracle import duck, table_digest  # noqa: E402

SF = "/root/testdata/sf0.001"
load_all()
NAMES = sorted(QUERIES)   # the training-data operators have their own tests


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    orc = E.oracle_sql()
    if name not in orc:
        assert len(df.columns) > 0
        return
    cur = con.execute(orc[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    sc, _, sh = table_digest(df.columns, rows)
    dc, _, dh = table_digest(dcols, drows)
    assert sc == dc
    assert len(rows) == len(drows)
    assert sh == dh


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


def test_entry_schema_is_stable(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "vector_index_id", "document_id", "chunk_id", "content",
                          "chunk_index", "similarity_score"]
    assert [f.dataType.simpleString() for f in df.schema.fields] == [
        "bigint", "bigint", "bigint", "string", "string", "string", "int", "double"]
