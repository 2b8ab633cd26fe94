"""What a task may hold does not grow with the table; estimates do not multiply."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import embed
from tessera.operators import knn as K
from tessera.plans import fixtures as fx
from tessera.sources import files

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_scores_of_a_large_batch_are_bounded():
    """one product held 32 million scores, several times over."""
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(4000, 8)), rng.normal(size=(4000, 8))
    vectors = pd.DataFrame({"vb": 0, "tag": 0, "id": range(4000), "v": list(v), "q": None, "k": None})
    queries = pd.DataFrame({"vb": 0, "tag": 1, "id": range(4000), "v": None, "q": list(q), "k": 5})
    tracemalloc.start()
    try:
        got = pd.concat(K._score_partition(None)(iter([vectors, queries])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    s = np.round(K._normalise_rows(q) @ v.astype(np.float32).astype(np.float64).T, K.SCORE_DECIMALS)
    for i in (0, 511, 512, 3999):
        best = sorted(zip(-s[i], range(4000)))[:5]
        mine = got[got["query_id"] == i]
        assert sorted(zip(-mine["score"], mine["vector_index_id"])) == best


def test_queries_of_one_filter_share_its_bitmap(spark, monkeypatch):
    """every query bore a bitmap of 4 KB to every block."""
    v = spark.range(60).select(F.col("id").alias("vector_index_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
                               (F.col("id") % 6).cast("string").alias("document_id"))
    q = spark.range(40).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    allowed = q.select("query_id", F.explode(F.array(F.col("query_id") % 2, F.lit(5).cast("long"))).alias("set_id"))
    sets = spark.createDataFrame([(0, "0"), (0, "4"), (1, "1"), (5, "5"), (7, "2")], "set_id long, document_id string")
    sent, plan = [], K._block_plan
    monkeypatch.setattr(K, "_block_plan", lambda vrows, rows, *a: sent.append(rows) or plan(vrows, rows, *a))
    got = K.prefiltered_knn(q, allowed, v.drop("document_id"), v, 2, sets=sets, vector_blocks=3)
    maps = sent[0].where("bitmap IS NOT NULL")
    assert maps.count() <= 2 * 3
    assert maps.agg(F.max(F.octet_length("bitmap"))).first()[0] == 1
    hits = {(r.query_id, r["rank"]): r.vector_index_id for r in got.collect()}
    assert hits == {(i, n): 59 if n == 1 else 58 if i % 2 == 0 else 55 for i in range(40) for n in (1, 2)}


def test_blocks_of_a_join_are_not_the_product_of_its_sides(spark):
    """the estimate of a join made millions of blocks, each of which got every query."""
    a = spark.range(1_000_000).select(F.col("id").alias("vector_index_id"), F.lit("x").alias("content"))
    b = spark.range(1_000_000).select(F.col("id").alias("vector_index_id"), F.array(F.lit(1.0)).alias("embedding"))
    joined = a.join(b, "vector_index_id")
    assert K._block_count(joined.select("vector_index_id", "embedding"), 1 << 20) <= 64


@pytest.mark.parametrize("step", ["extract", "embed", "derive", "search"])
def test_python_steps_bound_their_batches(spark, step):
    """Batches of 64 MB were held several times over in every Python step."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "67108864b")
    try:
        docs = spark.range(2).select(F.col("id").cast("string").alias("document_id"), F.lit("txt").alias("document_type"), F.lit("a b").alias("text"))
        vectors = spark.range(2).select(F.col("id").alias("vector_index_id"), F.array(F.lit(1.0)).alias("embedding"))
        if step == "extract":
            files.extract(docs.select("document_id", "document_type", F.encode("text", "utf-8").alias("content")))
        elif step == "embed":
            embed.embed_chunks(docs, text_col="text")
        elif step == "derive":
            fx.uploads_from_text(docs)
        else:
            K.knn(vectors.withColumnRenamed("vector_index_id", "query_id"), vectors, 1)
        assert int(spark.conf.get(BATCH)) <= 2 << 20
        spark.conf.set(BATCH, "4096")
        embed.embed_chunks(docs, text_col="text")
        assert spark.conf.get(BATCH) == "4096"
    finally:
        spark.conf.set(BATCH, before)


def test_word_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(embed, "_CACHE_LIMIT", 10)
    memo = embed._Buckets(7)
    assert [memo[str(i % 50)] for i in range(200)] == [memo[str(i % 50)] for i in range(200)] and len(memo) <= 11


def test_equal_paragraphs_are_equal_archives(monkeypatch):
    """An archive built two seconds later had other bytes, so that a repeated upload counted as another."""
    first = fx.build_docx(["a", "b"])
    import time
    monkeypatch.setattr(time, "time", lambda: 2_000_000_000.0)
    assert fx.build_docx(["a", "b"]) == first


def test_landing_is_as_wide_as_its_input(spark, tmp_path, monkeypatch):
    """one task wrote (and read) a third of all uploads."""
    from tessera.plans import q_ingest, store
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"),
                                  F.lit("web").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    landed = []
    monkeypatch.setattr(q_ingest.S, "stream_ingest", lambda s, where, *a, **k: landed.append(len(s.read.parquet(where).inputFiles())))
    monkeypatch.setattr(store, "delete", lambda *a: None)
    monkeypatch.setattr(store, "compact", lambda *a: None)
    monkeypatch.setattr(store, "read_documents", lambda s, root: s.createDataFrame([], store.SCHEMAS["documents"]))
    width = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(width)
    spark.conf.set(width, "128m")   # a task per file
    try:
        q_ingest.stream_delete_stream(spark, str(tmp_path))
    finally:
        spark.conf.set(width, before)
    assert landed[0] >= 5 and landed[1] >= 10 and landed[2] >= 5


@pytest.mark.parametrize("backend", ["hashing", "model"])
def test_vectors_of_many_short_texts_are_bounded(spark, monkeypatch, backend):
    """a batch is bounded by its bytes; ten thousand short texts made matrices of 30 MB, several at once."""
    made = []
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda f: made.append(f) or F.upper)
    if backend == "hashing":
        embed.HashingEmbedder().column("t")
    else:
        embed.PandasEmbedder(lambda: lambda texts: np.array([[len(t)] * 384 for t in texts], np.float64), 384).column("t")

    def run(texts):   # a batch; what of it is given back at once, as Spark turns that into lists
        parts = list(made[0](iter([texts])))
        return pd.concat(parts, ignore_index=True), max(map(len, parts))
    run(pd.Series(["a"]))
    texts = pd.Series([f"a b{i % 7}" for i in range(10_000)])
    texts[9_999] = "" if backend == "model" else None
    tracemalloc.start()
    try:
        got, most = run(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20 and most <= 400
    assert len(got) == 10_000 and not got[9_999].any() and all(v.dtype == np.float32 for v in got)
    for i in (0, 6, 340, 341, 682, 9_998):   # the same as alone
        assert np.array_equal(got[i], run(texts[i:i + 1].reset_index(drop=True))[0][0])


class _BatchBytes(embed.HashingEmbedder):
    """Every text's vector is the size of the Arrow batch in which a worker got it."""

    def column(self, text):
        @F.pandas_udf("array<float>")
        def size(texts: pd.Series) -> pd.Series:
            return pd.Series([np.array([texts.str.len().sum()], np.float32)] * len(texts))
        return size(F.col(text))


@pytest.mark.parametrize("job", ["batch_task_embeddings", "compact_store"])
def test_workers_get_small_batches(spark, tmp_path, monkeypatch, job):
    """a worker got ten thousand chunks at a time, some 30 MB of text, whatever was asked of it."""
    from tessera.operators import nlp
    from tessera.plans import store
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "67108864b")
    try:
        if job == "compact_store":
            up = spark.range(0, 400, 1, 1).select(
                F.col("id").cast("string").alias("document_id"), F.concat("id", F.lit(".txt")).alias("filename"), F.lit(9).cast("long").alias("file_size"),
                F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("upload_timestamp"),
                F.encode(F.repeat(F.lit("word "), 5000), "utf-8").alias("content"))
            root = str(tmp_path)
            store.append_batch(up, root, embedder=_BatchBytes(1), buckets=1)
            store.delete(spark, root, spark.createDataFrame([("7",)], "document_id string"))
            store.compact(spark, root)
            got = store.read_vectors(spark, root)
            assert got.select("document_id").distinct().count() == 399
        else:
            monkeypatch.setattr(embed, "HashingEmbedder", lambda: _BatchBytes(1))
            chunks = spark.range(0, 4000, 1, 1).select(F.col("id").cast("string").alias("chunk_id"), F.repeat(F.lit("word "), 600).alias("content"))
            got = nlp.batch_process_chunks(chunks, "embeddings")
        most = got.agg(F.max(F.col("embedding")[0]).alias("b"), F.count(F.lit(1)).alias("n")).first()
        assert most.n >= 3000 and most.b <= 3 << 20
    finally:
        spark.conf.set(BATCH, before)
