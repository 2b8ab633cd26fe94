"""The store: append, replace, ids, deletes, compaction, guards."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import embed, knn, tables
from tessera.plans import store
from tessera.session import scratch_dir

SCHEMA = "document_id string, filename string, file_size long, upload_timestamp timestamp_ntz, content binary"
T0 = dt.datetime(2024, 1, 1)


def ups(spark, *docs):
    return spark.createDataFrame([(i, f"{i}.txt", 5, T0, bytearray(text.encode())) for i, text in docs], SCHEMA)


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def rows(spark, root):
    return sorted((r.chunk_id, r.content, r.vector_index_id) for r in store.read_vectors(spark, root).collect())


def test_shorter_version_leaves_no_chunk_and_ids_stay(spark):
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, ("d", words(1200)), ("e", "x y")), root)
    before = rows(spark, root)
    assert sorted(r[2] for r in before) == list(range(4))
    store.append_batch(ups(spark, ("d", words(1200)), ("e", "x y")), root)
    assert rows(spark, root) == before                       # the same uploads change nothing
    store.append_batch(ups(spark, ("d", "now just three")), root)
    after = rows(spark, root)
    ids = {c: i for c, _, i in before}
    assert [(c, t) for c, t, _ in after] == [("d-0", "now just three"), ("e-0", "x y")]
    assert all(i == ids[c] for c, _, i in after)
    store.append_batch(ups(spark, ("f", words(600))), root)
    fresh = [i for c, _, i in rows(spark, root) if c.startswith("f-")]
    assert sorted(fresh) == [4, 5]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_empty_new_version_and_failed_uploads(spark):
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, ("d", "some words"), ("k", "keeps this")), root)
    bad = spark.createDataFrame([("k", "k.pdf", 5, T0, bytearray(b"%PDF")), ("d", "d.txt", 0, T0, bytearray(b""))], SCHEMA)
    store.append_batch(bad, root)
    assert [r[0] for r in rows(spark, root)] == ["k-0"]      # d is empty now, k's failed upload replaced nothing
    assert {r.document_id: r.status for r in store.read_status(spark, root).collect()} == {"d": "completed", "k": "failed"}
    assert store.read_documents(spark, root).count() == 2


def test_shared_ids_are_refused_or_resolved(spark):
    root = scratch_dir(spark, "store")
    twice = ups(spark, ("d", "one")).unionByName(spark.createDataFrame([("d", "z.txt", 5, T0 + dt.timedelta(1), bytearray(b"two"))], SCHEMA))
    with pytest.raises(ValueError, match="share a document_id"):
        store.append_batch(twice, root)
    assert store.read_documents(spark, root).count() == 0
    store.append_batch(twice, root, on_duplicates="latest")
    assert [r[1] for r in rows(spark, root)] == ["two"]


def test_delete_and_compaction(spark):
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, ("a", words(600)), ("b", "b text"), ("c", "c text")), root)
    store.append_batch(ups(spark, ("c", "c again")), root)
    ids = spark.createDataFrame([("a",), ("a",), ("nope",)], "document_id string")
    told = tables.delete_status(ids.distinct(), store.read_documents(spark, root), store.read_vectors(spark, root))
    assert {(r.document_id, r.status, r.chunks_removed) for r in told.collect()} == {("a", "deleted", 2), ("nope", "not_found", 0)}
    store.delete(spark, root, ids)
    live = rows(spark, root)
    assert [r[:2] for r in live] == [("b-0", "b text"), ("c-0", "c again")]
    assert {r.document_id for r in store.read_uploads(spark, root).collect()} == {"b", "c"}
    assert store._log(spark, root, "chunks").count() == 5
    assert store.compact(spark, root) == 3
    assert rows(spark, root) == live and store._log(spark, root, "chunks").count() == 2
    assert store.compact(spark, root) is None
    assert {r.document_id: r.status for r in store.read_status(spark, root).collect()}["a"] == "deleted"
    store.append_batch(ups(spark, ("a", "back")), root)
    assert [r[0] for r in rows(spark, root)] == ["a-0", "b-0", "c-0"]


def test_replayed_batch_changes_nothing(spark):
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, ("a", "one")), root, key="s/0")
    number = store.append_batch(ups(spark, ("a", "two"), ("b", words(600))), root, key="s/1")
    before = rows(spark, root)
    assert store.append_batch(ups(spark, ("a", "two"), ("b", words(600))), root, key="s/1") == number
    assert rows(spark, root) == before
    store.delete(spark, root, spark.createDataFrame([("a",)], "document_id string"), key="d")
    store.append_batch(ups(spark, ("a", "two"), ("b", words(600))), root, key="s/1")    # replayed after the delete
    assert {r[0] for r in rows(spark, root)} == {"b-0", "b-1"}
    assert store.append_batch(ups(spark, ("c", "three")), root, key="other/1") > number   # another stream's epoch 1
    assert {r[0] for r in rows(spark, root)} == {"b-0", "b-1", "c-0"}


def paths(spark, root, table):
    return {r.p for r in store._log(spark, root, table).select(F.input_file_name().alias("p")).collect()}


def test_a_failed_batch_is_never_read(spark, monkeypatch):
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, ("a", "one")), root)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.append_batch(ups(spark, ("a", "two"), ("b", "b text")), root, key="s/5")
    assert [r[1] for r in rows(spark, root)] == ["one"]
    assert store.append_batch(ups(spark, ("a", "two"), ("b", "b text")), root, key="s/5") == 2    # 1 is what failed
    assert [(r[1], r[2]) for r in rows(spark, root)] == [("two", 0), ("b text", 1)]
    assert store.vacuum(spark, root) == 5 and [r[1] for r in rows(spark, root)] == ["two", "b text"]


def test_two_writers_of_one_number(spark):
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, ("a", "one")), root)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(spark, root, 0, "append", "x", 9)


def test_compaction_rewrites_the_buckets_with_dead_rows_only(spark):
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, *[(f"d{i}", f"text {i} of many") for i in range(60)]), root, buckets=32)
    before, live = {t: paths(spark, root, t) for t in store.SCHEMAS}, dict((r[0], r[2]) for r in rows(spark, root))
    ids = spark.createDataFrame([("d7",), ("d31",)], "document_id string")
    touched = {r.b for r in ids.select(store.bucket_of("document_id", 32).alias("b")).collect()}
    store.delete(spark, root, ids)
    number = store.compact(spark, root)
    of = lambda p: int(p.split("bucket=")[1].split("/")[0])
    for table in ("uploads", "documents", "chunks", "embeddings"):
        after = paths(spark, root, table)
        assert {p for p in before[table] if of(p) not in touched} == {p for p in after if of(p) not in touched}
        assert {of(p) for p in after if f"batch={number}/" in p} <= touched
        assert not any(of(p) in touched for p in after & before[table])
    left = dict((r[0], r[2]) for r in rows(spark, root))
    assert left == {c: i for c, i in live.items() if c not in ("d7-0", "d31-0")}
    assert {r.document_id: r.status for r in store.read_status(spark, root).collect()}["d7"] == "deleted"
    assert store.vacuum(spark, root) > 0 and dict((r[0], r[2]) for r in rows(spark, root)) == left
    store.append_batch(ups(spark, ("new", "one more")), root)
    assert max(r[2] for r in rows(spark, root)) == 60     # ids of deleted chunks are not given again


class Shouting(embed.HashingEmbedder):
    name = "shouting"

    def column(self, text):
        return super().column(F.concat(text, F.lit(" loud")))


def test_reindex_adds_embeddings_only(spark):
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, ("a", "one two"), ("b", "three four")), root)
    before = {t: paths(spark, root, t) for t in store.SCHEMAS}
    old = {r.document_id: (r.model, list(r.embedding)) for r in store.read_embeddings(spark, root).collect()}
    store.reindex(spark, root, ["b"], Shouting(), key="r")
    store.reindex(spark, root, ["a", "b"], Shouting(), key="r")      # committed already
    new = {r.document_id: (r.model, list(r.embedding)) for r in store.read_embeddings(spark, root).collect()}
    assert new["a"] == old["a"] and new["b"][0] == "shouting" and new["b"][1] != old["b"][1]
    assert {t: paths(spark, root, t) for t in store.SCHEMAS if t != "embeddings"} == {t: p for t, p in before.items() if t != "embeddings"}
    assert store.compact(spark, root) is not None
    kept = {r.document_id: (r.model, list(r.embedding)) for r in store.read_embeddings(spark, root).collect()}
    assert kept == new and store._log(spark, root, "embeddings").count() == 2
    store.append_batch(ups(spark, ("b", "three four")), root)        # a new version has the usual model's vectors
    assert {r.document_id: r.model for r in store.read_embeddings(spark, root).collect()} == {"a": old["a"][0], "b": old["b"][0]}
    store.reindex(spark, root, embedder=Shouting())
    assert {r.model for r in store.read_embeddings(spark, root).collect()} == {"shouting"}


def test_key_report_of_a_sound_store_is_empty(spark):
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, ("a", words(600)), ("b", "b text")), root)
    store.append_batch(ups(spark, ("a", words(700)), ("c", "c text")), root)
    store.delete(spark, root, spark.createDataFrame([("b",)], "document_id string"))
    assert store.key_report(spark, root).count() == 0


def test_key_problems_are_counted_by_key(spark):
    doc = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "document_id string")
    chunk = spark.createDataFrame([("a-0", "a", 1), ("a-0", "a", 2), ("b-0", "b", 2), ("z-0", "z", 3)], "chunk_id string, document_id string, vector_index_id long")
    vec = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,), (9,)], "vector_index_id long")
    got = {(r.problem, r.key, r.n_rows) for r in store.key_problems(doc, chunk, vec).collect()}
    assert got == {("document_id", "a", 2), ("document_id", None, 2), ("chunk_id", "a-0", 2), ("vector_index_id", "2", 2), ("embedding", "1", 3),
                   ("chunk without document", "z-0", 1), ("embedding without chunk", "9", 1)}


def test_unusable_vectors_are_refused(spark):
    for bad in (None, [1.0], [1.0, float("nan")], [float("inf"), 1.0], [1.0, None]):
        df = spark.createDataFrame([("c", bad)], "chunk_id string, embedding array<float>")
        with pytest.raises(Exception, match="unusable vector of chunk c"):
            store.sound_vectors(df, 2).collect()
    ok = spark.createDataFrame([("c", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    assert store.sound_vectors(ok, 2).first().embedding == [1.0, 0.0]


def test_search_reads_the_row_groups_of_its_hits(spark):
    """The same hits as over all rows; the chunk scan gets the ranges of the hits' ids, and ids lie close together in a file."""
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, *[(f"d{i}", f"word{i} and word{i % 7} of {words(20)}") for i in range(90)]), root, buckets=8)
    store.append_batch(ups(spark, *[(f"e{i}", f"word{i} again {words(10)}") for i in range(40)]), root)
    h = embed.HashingEmbedder()
    q = spark.createDataFrame([(1, "word5 and word5"), (2, "word33 again")], "query_id long, text string").select("query_id", h.column("text").alias("embedding"))
    got = store.search(spark, root, q, limit=3, threshold=0.2, vector_dim=h.dim)
    v = store.read_vectors(spark, root)
    want = knn.semantic_search(q, v, v, limit=3, threshold=0.2, vector_dim=h.dim)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "content" in x)
    assert "GreaterThanOrEqual(vector_index_id" in scan and "Or(" in scan
    spans = store._log(spark, root, "chunks").groupBy("batch", "bucket").agg(F.min("vector_index_id").alias("a"), F.max("vector_index_id").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:], strict=False))


def test_id_ranges_cover_all_keys(spark):
    rng = random.Random(3)
    ids = sorted({rng.randrange(10**9) for _ in range(500)} | {-5, 10**12})
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
    for most in (1, 7, 256):
        where = tables.id_ranges(df, "id", most)
        assert str(where).count("AND") <= most + 1
        assert [r.id for r in df.where(where).orderBy("id").collect()] == ids
    assert df.where(tables.id_ranges(df.where("id IS NULL"), "id")).count() == 0


def test_tables_of_a_batch_are_written_together(spark, monkeypatch):
    """Chunks, documents, uploads and status of a batch don't wait for each other: small batches are bound by the making of files."""
    write, met = store._write, threading.Barrier(4)

    def meet(df, root, table, number):
        if table != "embeddings":
            met.wait(60)
        write(df, root, table, number)
    monkeypatch.setattr(store, "_write", meet)
    root = scratch_dir(spark, "store")
    store.append_batch(ups(spark, ("d", words(600)), ("e", "x y")), root)
    assert [r[0] for r in rows(spark, root)] == ["d-0", "d-1", "e-0"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_new_documents_are_numbered_like_any(spark):
    """a batch of new documents is numbered from counts by range, in one pass, to the same ids as chunks beside a store."""
    docs = [(f"d{i}", words((i * 37) % 1500)) for i in range(150)] + [("e", ""), (None, words(600))]
    res = store.ingest(ups(spark, *[(i, t) for i, t in docs if i]).unionByName(spark.createDataFrame([(None, "n.txt", 5, T0, bytearray(b"no id"))], SCHEMA)))
    counts = store._counts(res)
    none = spark.createDataFrame([], "document_id string, chunk_index int, vector_index_id long")
    want = {(r.chunk_id, r.vector_index_id) for r in store.number_chunks(res.chunks, none, 7).collect()}
    for tasks in (4, 40):
        got = store._numbered(res.accepted, store.Counts(counts.heads, counts.total, False, None, tasks), 7, 3).collect()
        assert {(r.chunk_id, r.vector_index_id) for r in got} == want and {r.batch for r in got} == {3}
    assert 7 + counts.total == 1 + max(i for _, i in want if i is not None) and not counts.repeated and len(counts.ids) == 152
    assert store._counts(store.ingest(ups(spark, ("a", "x"), ("a", "y")))).repeated


def test_known_ids_rule_out_new_ones_only(spark):
    """No stored id is ever ruled out, whoever stored it."""
    root, known = scratch_dir(spark, "store"), store.KnownIds()
    store.append_batch(ups(spark, ("a", "one"), ("b", "two")), root, known=known)
    h = lambda *ids: store._counts(store.ingest(ups(spark, *[(i, "x") for i in ids]))).ids
    held = lambda ids: known.may_hold(spark, root, store.commits(spark, root), ids)
    assert held(h("a", "z")) and not held(h("y", "z")) and held(None)
    store.append_batch(ups(spark, ("y", "three")), root)          # by another writer
    assert held(h("y")) and held(h("b")) and not held(h("z"))
    known._set(None)
    assert held(h("z"))


def test_tasks_write_the_same_rows_as_spark(spark, monkeypatch):
    """most of a small append was the making of checksums, folders and permissions by Spark's writer."""
    from tessera.sources import files
    docs = [(f"d{i}", words(i * 40)) for i in range(40)]
    tables = {}
    for how in ("tasks", "spark"):
        root = scratch_dir(spark, "store")
        store.append_batch(ups(spark, *docs), root, buckets=8)
        tables[how] = {t: sorted(map(str, store._log(spark, root, t).collect())) for t in store.SCHEMAS}
        made = {p.rpartition("/")[2] for t in store.SCHEMAS for p in paths(spark, root, t)}
        assert all(n.count("-") == 1 for n in made) == (how == "tasks")
        monkeypatch.setattr(files, "_file_system", lambda uri: (_ for _ in ()).throw(OSError(uri)))
    assert tables["tasks"] == tables["spark"] and len(tables["spark"]["uploads"]) == 40


def test_a_task_that_writes_again_replaces_its_files(spark):
    from tessera.sources import files
    folder = scratch_dir(spark, "written")
    rows = spark.createDataFrame([(1, "a", T0), (1, "b", None), (2, None, T0), (None, "d", T0)], "bucket int, x string, at timestamp_ntz").coalesce(1).sortWithinPartitions("bucket")
    for _ in range(2):
        assert files.write_parquet(rows, folder, "bucket")
    got = spark.read.schema("x string, at timestamp_ntz, bucket int").parquet(folder)
    assert sorted(map(str, got.select("bucket", "x", "at").collect())) == sorted(map(str, rows.collect()))
    empty = scratch_dir(spark, "written")
    assert files.write_parquet(rows.limit(0), empty, "bucket") and spark.read.schema("x string").parquet(empty).count() == 0
