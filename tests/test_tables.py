"""Upsert, delete, dense ids and statistics."""

import datetime as dt
import re

from pyspark.sql import functions as F

from tessera.operators import tables
from tessera.session import scratch_dir

T0 = dt.datetime(2024, 1, 1)


def test_upsert_last_arrival_wins(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, word_count int")
    changes = spark.createDataFrame([("b", 20, 1), ("b", 21, 2), ("c", 3, 1)],
                                    "document_id string, word_count int, arrival int")
    got = sorted(tuple(r) for r in tables.upsert(base, changes, "document_id").collect())
    assert got == [("a", 1), ("b", 21), ("c", 3)]


def test_upsert_twice_equals_once(spark):
    base = spark.createDataFrame([("a", 1)], "document_id string, word_count int")
    changes = spark.createDataFrame([("a", 5, 1), ("z", 9, 1)], "document_id string, word_count int, arrival int")
    once = tables.upsert(base, changes, "document_id")
    twice = tables.upsert(once, changes, "document_id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_delete_then_search_never_returns_id(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    ids = spark.createDataFrame([("b",), ("x",)], "document_id string")
    assert sorted(r[0] for r in tables.delete_by_ids(docs, ids).collect()) == ["a", "c"]


def test_number_chunks_is_dense_and_keeps_stored_ids(spark):
    from tessera.plans.store import number_chunks
    rows = [(str(d), i, f"{d}-{i}") for d in range(60) for i in range(d % 4)]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_id string").repartition(7)
    stored = spark.createDataFrame([("7", 0, 5), ("7", 1, 41), ("gone", 0, 9)], "document_id string, chunk_index int, vector_index_id long")
    got = {r.chunk_id: r.vector_index_id for r in number_chunks(df, stored, 42).collect()}
    assert got["7-0"] == 5 and got["7-1"] == 41
    assert sorted(v for k, v in got.items() if k not in ("7-0", "7-1")) == list(range(42, 42 + len(rows) - 2))
    fresh = sorted(r.vector_index_id for r in number_chunks(df, stored.limit(0), 0).collect())
    assert fresh == list(range(len(rows)))


def test_corpus_stats_counts_tombstones(spark):
    docs = spark.createDataFrame([("a",)], "document_id string")
    chunks = spark.createDataFrame([(1,), (2,)], "vector_index_id long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])],
                                    "vector_index_id long, embedding array<float>")
    r = tables.corpus_stats(docs, chunks, vectors).first()
    assert (r.document_count, r.chunk_count, r.vector_count, r.live_vector_count, r.stale_vector_count,
            r.index_dimension) == (1, 2, 3, 2, 1, 2)


def test_list_documents_offset_and_ties(spark):
    t = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(str(i), t + dt.timedelta(minutes=i // 3)) for i in range(10)],
                                 "document_id string, upload_timestamp timestamp_ntz")
    page = tables.list_documents(docs, limit=4, offset=2).orderBy("page_position").collect()
    # minutes: 9 -> 3; 6,7,8 -> 2; 3,4,5 -> 1; newest first, id breaks ties
    assert [r.document_id for r in page] == ["7", "8", "3", "4"]
    total = tables.list_documents(docs, limit=4, offset=2, with_total=True).collect()
    assert len(total) == 4 and {r.total_count for r in total} == {10}


def test_batch_task_registry(spark):
    import pytest
    from tessera.operators import nlp
    ch = spark.createDataFrame([("c1", "Mail a@b.com now. Then stop.")], "chunk_id string, content string")
    with pytest.raises(ValueError):
        nlp.batch_process_chunks(ch, "translate")
    assert nlp.batch_process_chunks(ch, "ner").first().label == "EMAIL"
    assert nlp.batch_process_chunks(ch, "summarization").first().summary
    assert len(nlp.batch_process_chunks(ch, "embeddings").first().embedding) == 384


def test_keyset_page_follows_offset_page(spark):
    t = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(str(i), t + dt.timedelta(minutes=i // 3)) for i in range(30)],
                                 "document_id string, upload_timestamp timestamp_ntz")
    first = tables.list_documents(docs, limit=7).orderBy("page_position").collect()
    last = first[-1]
    nxt = tables.list_documents_after(docs, last.upload_timestamp, last.document_id, limit=7)
    by_offset = tables.list_documents(docs, limit=7, offset=7)
    assert [r.document_id for r in nxt.orderBy("page_position").collect()] == \
        [r.document_id for r in by_offset.orderBy("page_position").collect()]


def test_restrict_to_ids_follows_the_caller(spark):
    df = spark.range(0, 3000).select(F.col("id").cast("string").alias("document_id"))
    ids = [str(i) for i in range(0, 3000, 2)] + ["nope"]
    by_list = tables.restrict_to_ids(df, ids)
    assert "LeftSemi" not in by_list._jdf.queryExecution().optimizedPlan().toString()
    by_frame = tables.restrict_to_ids(df, spark.createDataFrame([(i,) for i in [*ids, "2"]], "document_id string"))
    assert "LeftSemi" in by_frame._jdf.queryExecution().optimizedPlan().toString()
    assert by_list.count() == by_frame.count() == 1500


def parts_read(page):
    """The parts that the scan's partition filter names."""
    plan = page._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"\d+", re.search(r"PartitionFilters: \[(.*?)\], P", plan)[1].replace("part#", "").split("(", 1)[-1])) if "PartitionFilters: [" in plan else set()


def test_pages_of_any_depth_read_their_parts_only(spark):
    rows = [(f"d{i:03d}", T0 + dt.timedelta(minutes=i // 4)) for i in range(503)]
    docs = spark.createDataFrame(rows, "document_id string, upload_timestamp timestamp_ntz")
    path = scratch_dir(spark, "listing")
    assert tables.write_listing(docs, path, part_rows=50) == 503
    want = [r[0] for r in sorted(rows, key=lambda r: (-(r[1] - T0).total_seconds(), r[0]))]
    for limit, offset in ((10, 0), (10, 490), (10, 500), (10, 503), (10, 9999), (120, 77), (1, 250)):
        page = tables.read_page(spark, path, limit, offset)
        assert [r.document_id for r in page.orderBy("page_position").collect()] == want[offset:offset + limit]
        assert len(parts_read(page)) <= -(-limit // 40) + 1
    empty = scratch_dir(spark, "listing")
    assert tables.write_listing(docs.limit(0), empty) == 0 and tables.read_page(spark, empty, 5).count() == 0
