"""The registered queries against their SQL, and their columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from check_oracle import duck, table_digest  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tessera.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": "doc_id n_bytes n_removed n_spans kept_sha256", "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4": "vec_id n_links component_id kept", "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7": "doc_id held_out score predicted", "op8": "doc_id keep_id group_size kept text_sha256", "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op11": "doc_id piece start length ids_crc32 sequence_id offset", "op12": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256"}


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name.split("_")[0], "").split()) <= set(df.columns)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLES:
        cur = duck(SF).execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert table_digest(df.columns, rows) == table_digest(names, cur.fetchall())
