"""Ingest queries: extraction from upload bytes, the batch pipeline, its status table, and the
same pipeline and a search-request stream run through Structured Streaming.

Uploads are derived from the ``documents`` table by Spark (TXT bytes, DOCX archives, PDF
bytes) and landed as parquet under the session's shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import embed as E
from tessera.operators import knn as K
from tessera.plans import fixtures as fx
from tessera.plans import store
from tessera.plans.catalog import register
from tessera.plans.fixtures import sql_with
from tessera.plans.ingest import ingest
from tessera.plans.q_documents import DOC_COLS_SQL, doc_public
from tessera.plans.q_nlp import hash_search_sql, stored_vectors
from tessera.plans.q_tables import hash_sql
from tessera.session import ensure_checkpoint_dir, scratch_dir
from tessera.sources import files
from tessera.sources.blocks import write_blocks
from tessera.streaming import ingest as S

WS = T.WS_CLASS


def uploads(spark, sf_dir):
    """Every upload of the fixture with derived bytes (``content``)."""
    return as_uploads(fx.doc_raw(spark, sf_dir))


def as_uploads(raw):
    typed = raw.select("document_id", "filename", "file_size", "upload_timestamp", "text",
                       F.when(T.validation_reason("file_size", "filename").isNull(),
                              T.document_type("filename")).alias("document_type"))
    return fx.uploads_from_text(typed).drop("document_type")


TEXT_SQL = ("regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^" + WS + "+|" + WS + "+$', '', 'g')")
MIME_SQL = "CASE document_type WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/zip' ELSE 'text/plain' END"


@register("extract_text", sql_with("doc_raw", "doc") + """
SELECT document_id, document_type, CAST(NULL AS VARCHAR) AS error, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5,
       """ + MIME_SQL + """ AS mime_type
FROM (SELECT document_id, document_type, """ + TEXT_SQL + """ AS t FROM doc)""")
def extract_text(spark, sf_dir):
    """Texts of all accepted uploads; PDF through an injected extractor."""
    up = uploads(spark, sf_dir)
    acc = up.where(T.validation_reason("file_size", "filename").isNull()).withColumn(
        "document_type", T.document_type("filename")).withColumn("mime_type", T.mime_from_magic("content"))
    ext = files.extract(acc.select("document_id", "document_type", "mime_type", "content"), fx.pdf_extractor)
    return ext.select("document_id", "document_type", "error", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"),
                      "mime_type")


@register("extract_files", sql_with("doc_raw", "doc") + """
SELECT document_id, document_type, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS text_md5
FROM (SELECT document_id, 'txt' AS document_type, """ + TEXT_SQL.replace("text,", "replace(text, chr(10), ' '),") + """ AS text FROM doc)""")
def extract_files(spark, sf_dir):
    """Real files in the shared folder, one per document, read by ``binaryFile`` and extracted."""
    up = files.uploads_from_files(files.read_raw_files(spark, _written_files(spark, sf_dir), "*.txt", ids="stem"))
    ext = files.extract(up.withColumn("document_type", T.document_type("filename")), fx.pdf_extractor)
    return ext.select("document_id", "document_type", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def _written_files(spark, sf_dir):
    doc = fx.doc(spark, sf_dir).select("document_id", F.regexp_replace("text", "\n", " ").alias("text"))
    return files.write_raw_files(doc, scratch_dir(spark, "files"))


@register("stream_files", sql_with("doc_raw", "doc") + "SELECT document_id, 'txt' AS document_type, word_count, language FROM doc")
def stream_files(spark, sf_dir):
    """The same files as a ``binaryFile`` stream into a store."""
    root = scratch_dir(spark, "store")
    S.stream_ingest_files(spark, _written_files(spark, sf_dir), root, scratch_dir(spark, "files-ckpt"), glob="*.txt", ids="stem",
                          max_files_per_trigger=400, pdf_extractor=fx.pdf_extractor)
    return store.read_documents(spark, root).select("document_id", "document_type", "word_count", "language")


INGESTED_DOCS_SQL = sql_with("doc_raw", "doc") + "SELECT " + DOC_COLS_SQL + " FROM doc"


@register("ingest_documents", INGESTED_DOCS_SQL)
def ingest_documents(spark, sf_dir):
    return doc_public(ingest(uploads(spark, sf_dir), pdf_extractor=fx.pdf_extractor).documents)


@register("ingest_chunks", sql_with("stored_chunks") + """
SELECT chunk_id, document_id, content, chunk_index, start_position, end_position FROM stored_chunks""")
def ingest_chunks(spark, sf_dir):
    v = ingest(uploads(spark, sf_dir), pdf_extractor=fx.pdf_extractor).vectors
    return v.select("chunk_id", "document_id", "content", "chunk_index", "start_position", "end_position")


def status_sql(pdf: str) -> str:
    """Status per upload; ``pdf`` = reason of failed PDF rows, '' when they are extracted."""
    failed = f"WHEN t = 'pdf' THEN '{pdf}'" if pdf else ""
    state = "WHEN t = 'pdf' THEN 'failed'" if pdf else ""
    return sql_with("doc_raw") + """
SELECT document_id, CASE WHEN r IS NOT NULL THEN 'rejected' """ + state + """ ELSE 'completed' END AS status,
       CASE WHEN r IS NOT NULL THEN r """ + failed + """ END AS reason
FROM (SELECT document_id, """ + fx._fmt(fx.REASON_SQL, s="file_size", f="filename") + """ AS r,
             """ + fx._fmt(fx.TYPE_SQL, f="filename") + """ AS t FROM doc_raw)"""


@register("ingest_status", status_sql("no_extractor"))
def ingest_status(spark, sf_dir):
    """Without an extractor PDF uploads are reported as failed."""
    return ingest(uploads(spark, sf_dir)).status


def _land(spark, df, name, n_files=4):
    root = scratch_dir(spark, name)
    df.repartition(n_files).write.parquet(root)
    return root


def _streamed(spark, sf_dir, files_per_batch):
    landing = files.land_uploads(uploads(spark, sf_dir), scratch_dir(spark, "landing"), n_files=4)
    root = scratch_dir(spark, "store")
    S.stream_ingest(spark, landing, root, scratch_dir(spark, "ingest-ckpt"), max_files_per_trigger=files_per_batch,
                    pdf_extractor=fx.pdf_extractor)
    return root


@register("stream_ingest", INGESTED_DOCS_SQL)
def stream_ingest(spark, sf_dir):
    """Uploads land as several files; an available-now stream ingests them one file per
    micro-batch; the store is read back."""
    return doc_public(store.read_documents(spark, _streamed(spark, sf_dir, 1)))


@register("stream_ingest_status", status_sql(""))
def stream_ingest_status(spark, sf_dir):
    return store.read_status(spark, _streamed(spark, sf_dir, 2))


# ------------------------------------------------------------------------------ the store

VERSIONS_SQL = sql_with("doc_raw") + """,
again AS (SELECT *, doc_id % 3 = 0 AS changed FROM doc_raw
          WHERE (""" + fx._fmt(fx.REASON_SQL, s="file_size", f="filename") + """) IS NULL),
stored AS (SELECT document_id, CASE WHEN changed THEN substr(text, 1, CAST(length(text) // 3 AS INTEGER)) ELSE text END AS text FROM again),
v1 AS (SELECT document_id, CAST(greatest(ceil(len(""" + fx._fmt(fx.WORDS_SQL, t="text") + """) / 462.0), 0) AS BIGINT) AS n FROM again),
ids AS (SELECT document_id, sum(n) OVER (ORDER BY md5(document_id), document_id) - n AS first_id FROM v1),
chunked AS (""" + fx.SQL_VIEWS["chunks_of"].replace("{src}", "stored") + """)"""


def _two_versions(spark, sf_dir):
    """A store to which every upload went, and then again, a third of them cut to a third of their text."""
    first = uploads(spark, sf_dir)
    raw = fx.doc_raw(spark, sf_dir)
    shorter = raw.withColumn("text", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.expr("substr(text, 1, CAST(length(text) DIV 3 AS INT))")).otherwise(F.col("text")))
    root = scratch_dir(spark, "store")
    for up in (first, as_uploads(shorter)):
        store.append_batch(up, root, pdf_extractor=fx.pdf_extractor)
    return root


@register("store_reingest", VERSIONS_SQL + """
SELECT c.chunk_id, c.document_id, c.chunk_index, md5(c.content) AS content_md5, CAST(i.first_id + c.chunk_index AS BIGINT) AS vector_index_id
FROM chunked c JOIN ids i ON i.document_id = c.document_id""")
def store_reingest(spark, sf_dir):
    """Ingested twice: the second version leaves no chunk of the first, and stored keys keep their ids."""
    v = store.read_vectors(spark, _two_versions(spark, sf_dir))
    return v.select("chunk_id", "document_id", "chunk_index", F.md5("content").alias("content_md5"), "vector_index_id")


_LEFT = " WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 7 = 0)"


def _deleted(spark, sf_dir):
    root = scratch_dir(spark, "store")
    store.append_batch(uploads(spark, sf_dir), root, pdf_extractor=fx.pdf_extractor)
    store.delete(spark, root, fx.deleted_ids(spark, sf_dir))
    return root


@register("delete_store", sql_with("stored_chunks") + """
SELECT d.document_id, d.filename, count(c.chunk_id) AS n_chunks FROM doc d LEFT JOIN stored_chunks c ON c.document_id = d.document_id
WHERE d.document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 7 = 0)
GROUP BY d.document_id, d.filename""")
def delete_store(spark, sf_dir):
    """Documents, chunks and raw uploads deleted from a written store; what is left of it."""
    root = _deleted(spark, sf_dir)
    raw = store.read_uploads(spark, root).select("document_id", "filename")
    n = store.read_vectors(spark, root).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    left = store.read_documents(spark, root).select("document_id").join(raw, "document_id").join(n, "document_id", "left")
    return left.select("document_id", "filename", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@register("compact_store", sql_with("stored_chunks") + """
SELECT chunk_id, document_id, chunk_index, md5(content) AS content_md5 FROM stored_chunks
WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 7 = 0)""")
def compact_store(spark, sf_dir):
    """The same store after compaction: one batch holding only live rows."""
    root = _deleted(spark, sf_dir)
    store.compact(spark, root)
    return store.read_vectors(spark, root).select("chunk_id", "document_id", "chunk_index", F.md5("content").alias("content_md5"))


@register("stream_delete_stream", sql_with("doc_raw", "doc") + "SELECT " + DOC_COLS_SQL + " FROM doc WHERE NOT (doc_id % 7 = 0 AND doc_id % 3 <> 2)")
def stream_delete_stream(spark, sf_dir):
    """Two thirds of the uploads are streamed in, documents deleted, the last third streamed in by the same stream, the store
    compacted and that third sent once more by a stream of its own checkpoint: deleted documents stay deleted."""
    raw = fx.doc_raw(spark, sf_dir)
    late = as_uploads(raw.where(F.pmod("doc_id", F.lit(3)) == 2))
    root, ckpt = scratch_dir(spark, "store"), scratch_dir(spark, "ingest-ckpt")
    # a file per input partition: what one task writes stays as it is however many documents there are
    landing = files.land_uploads(as_uploads(raw.where(F.pmod("doc_id", F.lit(3)) != 2)), scratch_dir(spark, "landing"))
    stream = lambda where, checkpoint: S.stream_ingest(spark, where, root, checkpoint, pdf_extractor=fx.pdf_extractor)
    stream(landing, ckpt)
    store.delete(spark, root, fx.deleted_ids(spark, sf_dir))
    files.land_uploads(late, landing)
    stream(landing, ckpt)
    store.compact(spark, root)
    stream(files.land_uploads(late, scratch_dir(spark, "landing")), scratch_dir(spark, "ingest-ckpt"))
    return doc_public(store.read_documents(spark, root))


@register("stream_resent", sql_with("doc_raw", "doc") + "SELECT " + DOC_COLS_SQL + ", 1 AS n_versions FROM doc")
def stream_resent(spark, sf_dir):
    """A third of the uploads comes twice, in another file and micro-batch; the store took each once."""
    up = uploads(spark, sf_dir)
    landing = files.land_uploads(up, scratch_dir(spark, "landing"), n_files=3)
    up.where(F.pmod(F.col("document_id").cast("long"), F.lit(3)) == 0).repartition(2).write.mode("append").parquet(landing)
    root = scratch_dir(spark, "store")
    S.stream_ingest(spark, landing, root, scratch_dir(spark, "ingest-ckpt"), max_files_per_trigger=3, resent_within="2 hours",
                    pdf_extractor=fx.pdf_extractor)
    versions = store.versions(spark, root)
    return doc_public(store.read_documents(spark, root)).join(versions, "document_id")


@register("store_search", sql_with("stored_chunks").rstrip() + hash_search_sql(
    "(SELECT CAST(item_id AS VARCHAR) AS chunk_id, text AS content FROM benchmark)", fx.QA_LIMIT, fx.QA_THRESHOLD) + """
SELECT query_id, count(*) AS n_hits, round(max(score), 6) AS best_score FROM res GROUP BY query_id""")
def store_search(spark, sf_dir):
    """A store is searched: vectors are scored without text, and the text of the hits is read by ranges of their ids."""
    root = scratch_dir(spark, "store")
    store.append_batch(uploads(spark, sf_dir), root, pdf_extractor=fx.pdf_extractor)
    emb = E.HashingEmbedder()
    q = fx.questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), emb.column("question").alias("embedding"))
    hits = store.search(spark, root, q, limit=fx.QA_LIMIT, threshold=fx.QA_THRESHOLD, vector_dim=emb.dim)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.max("similarity_score"), 6).alias("best_score"))


class _Folded(E.HashingEmbedder):
    """Another model of the same width: every e is an a."""
    name = "hashing-folded"

    def column(self, text):
        return super().column(F.translate(text, "e", "a"))


_FOLDED_SQL = ("(SELECT chunk_id, document_id, CASE WHEN document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) "
               "THEN replace(content, 'e', 'a') ELSE content END AS content FROM stored_chunks)")


@register("reindex_store", sql_with("stored_chunks").rstrip() + hash_search_sql(
    "(SELECT CAST(item_id AS VARCHAR) AS chunk_id, text AS content FROM benchmark)", fx.QA_LIMIT, fx.QA_THRESHOLD).replace(
    hash_sql("stored_chunks", prefix="c_"), hash_sql(_FOLDED_SQL, prefix="c_")) + """
SELECT query_id, count(*) AS n_hits, round(max(score), 6) AS best_score FROM res GROUP BY query_id""")
def reindex_store(spark, sf_dir):
    """The labelled documents of a store are embedded anew by another model; the search sees old and new vectors."""
    root = scratch_dir(spark, "store")
    store.append_batch(uploads(spark, sf_dir), root, pdf_extractor=fx.pdf_extractor)
    store.reindex(spark, root, fx.labelled_ids(spark, sf_dir), _Folded())
    emb = E.HashingEmbedder()
    q = fx.questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), emb.column("question").alias("embedding"))
    return _best_hits(q, store.read_vectors(spark, root), emb)


_DENSE_SQL = """,
n AS (SELECT document_id, count(*) AS n FROM stored_chunks GROUP BY document_id),
ids AS (SELECT document_id, CAST(sum(n) OVER (ORDER BY md5(document_id), document_id) - n AS BIGINT) AS first_id FROM n),
first AS (SELECT c.*, i.first_id AS vid, CAST(c.document_id AS BIGINT) AS d FROM stored_chunks c JOIN ids i ON i.document_id = c.document_id WHERE c.chunk_index = 0)
"""


@register("store_key_report", sql_with("stored_chunks").rstrip() + _DENSE_SQL + """
SELECT 'document_id' AS problem, document_id AS key, 2 AS n_rows FROM doc WHERE doc_id % 11 = 0
UNION ALL SELECT 'chunk_id', chunk_id, 2 FROM first WHERE d % 13 = 0
UNION ALL SELECT 'vector_index_id', CAST(vid AS VARCHAR), 2 FROM first WHERE d % 13 = 0
UNION ALL SELECT 'chunk without document', 'lost-' || chunk_id, 1 FROM first WHERE d % 17 = 0
UNION ALL SELECT 'embedding without chunk', CAST(1000000000 + d AS VARCHAR), 1 FROM first WHERE d % 19 = 0""")
def store_key_report(spark, sf_dir):
    """A store into whose files rows were added behind its back; the report names each of them."""
    root = scratch_dir(spark, "store")
    n = store.append_batch(uploads(spark, sf_dir), root, pdf_extractor=fx.pdf_extractor)
    each = lambda k: F.pmod(F.col("document_id").cast("long"), F.lit(k)) == 0
    table = lambda name: spark.read.parquet(f"{root}/{name}/batch={n}")
    chunks = table("chunks").where("chunk_index = 0")
    lost = chunks.where(each(17)).select("*", F.concat(F.lit("lost-"), "document_id").alias("_d"))
    lost = lost.withColumn("document_id", F.col("_d")).drop("_d").withColumn("chunk_id", F.concat(F.lit("lost-"), "chunk_id"))
    lost = lost.withColumn("vector_index_id", F.col("vector_index_id") + 2_000_000_000)
    bare = chunks.where(each(19)).select("vector_index_id", (F.col("document_id").cast("long") + 1_000_000_000).alias("_v"))
    bare = table("embeddings").join(bare, "vector_index_id").withColumn("vector_index_id", F.col("_v")).drop("_v")
    for name, rows in (("documents", table("documents").where(each(11))), ("chunks", chunks.where(each(13)).unionByName(lost)), ("embeddings", bare)):
        fx.materialise(rows, name).write.mode("append").partitionBy("bucket").parquet(f"{root}/{name}/batch={n}")
    return store.key_report(spark, root)


@register("stream_then_search", sql_with("stored_chunks").rstrip() + hash_search_sql(
    "(SELECT CAST(item_id AS VARCHAR) AS chunk_id, text AS content FROM benchmark)", fx.QA_LIMIT, fx.QA_THRESHOLD) + """
SELECT query_id, count(*) AS n_hits, round(max(score), 6) AS best_score FROM res GROUP BY query_id""")
def stream_then_search(spark, sf_dir):
    """What a stream ingested is searched: every streamed vector has its id."""
    emb = E.HashingEmbedder()
    v = store.read_vectors(spark, _streamed(spark, sf_dir, 2))
    q = fx.questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), emb.column("question").alias("embedding"))
    return _best_hits(q, v, emb)


def _best_hits(q, v, emb):
    hits = K.semantic_search(q, v, v, limit=fx.QA_LIMIT, threshold=fx.QA_THRESHOLD, vector_dim=emb.dim)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.max("similarity_score"), 6).alias("best_score"))


def conversation_queries(spark, sf_dir):
    c = fx.read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


@register("stream_search", sql_with("stored_chunks").rstrip() + hash_search_sql(
    "(SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS chunk_id, text AS content FROM conversations "
    "WHERE role = 'user')", fx.QA_LIMIT, fx.QA_THRESHOLD) + """
SELECT query_id, rank, vid AS vector_index_id, hit_chunk_id AS chunk_id, round(score, 6) AS similarity_score
FROM res""")
def stream_search(spark, sf_dir):
    """User turns of ``conversations`` arrive as a stream of search requests, answered per
    micro-batch against the stored chunk vectors, which are dealt into blocks once."""
    reqs = _land(spark, conversation_queries(spark, sf_dir), "requests")
    out = scratch_dir(spark, "search-out")
    ensure_checkpoint_dir(spark)
    vectors = stored_vectors(spark, sf_dir).checkpoint()
    S.stream_search(spark, reqs, write_blocks(vectors, scratch_dir(spark, "blocks")), vectors, out, scratch_dir(spark, "search-ckpt"),
                    limit=fx.QA_LIMIT, threshold=fx.QA_THRESHOLD, max_files_per_trigger=2)
    hits = spark.read.parquet(out)
    return hits.select("query_id", F.col("rank").cast("long"), "vector_index_id", "chunk_id",
                       F.round("similarity_score", 6).alias("similarity_score"))
