"""End to end through the public API: files -> ingest and store -> search -> answers."""

from pyspark.sql import functions as F

from tessera.operators import chunking, embed, knn, nlp
from tessera.plans import fixtures as fx
from tessera.plans import store as S
from tessera.session import scratch_dir
from tessera.sources import files

SF = "/root/testdata/sf0.001"


def test_files_to_answers(spark):
    docs = fx.read(spark, SF, "documents").where(F.col("doc_id") < 30).select(
        F.col("doc_id").cast("string").alias("document_id"), "text")
    folder = scratch_dir(spark, "uploads")
    docs.write.partitionBy("document_id").text(folder)
    up = files.uploads_from_files(files.read_raw_files(spark, folder, "*.txt"))
    store = scratch_dir(spark, "store")
    S.append_batch(up, store)
    stored = S.read_documents(spark, store)
    assert stored.count() == 30
    vectors = S.read_vectors(spark, store)
    # every document's first chunk, used as a query, finds its own chunk first (score 1)
    h = embed.HashingEmbedder()
    q = (vectors.where("chunk_index = 0")
         .select(F.col("document_id").cast("long").alias("query_id"), h.column("content").alias("embedding")))
    hits = knn.semantic_search(q, vectors, vectors, limit=3, threshold=0.0, vector_dim=h.dim)
    top = {r.query_id: (r.document_id, r.similarity_score) for r in hits.where("rank = 1").collect()}
    assert len(top) == 30
    assert all(d == str(qid) or abs(s - 1.0) < 1e-6 for qid, (d, s) in top.items())
    # per-document jobs over the stored chunks
    text = chunking.reassemble_text(vectors)
    summ = nlp.summarize(text)
    assert summ.where("summary_length > 0").count() == 30
    ctx = text.select(F.col("document_id").cast("long").alias("question_id"),
                      F.lit("the and of").alias("question"), F.col("text").alias("context"))
    ans = nlp.answer(ctx).collect()
    for r in ans:
        if r.start_position is not None:
            assert r.answer and r.end_position - r.start_position == len(r.answer)
