"""Table-change queries: upsert, delete, embeddings, reindex, dense ids, store round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import embed as E
from tessera.operators import tables
from tessera.plans import fixtures as fx
from tessera.plans import store
from tessera.plans.catalog import register
from tessera.plans.fixtures import WORDS_SQL, _fmt, sql_with
from tessera.plans.q_documents import DOC_COLS_SQL, doc_public
from tessera.session import scratch_dir
from tessera.sources import tables as io

UPD_SQL = """
upd AS (
  SELECT document_id, filename, file_size, document_type, upload_timestamp, processing_timestamp,
         word_count + 1000 AS word_count, page_count, language, 1 AS arrival FROM doc WHERE doc_id % 10 = 0
  UNION ALL
  SELECT document_id, filename, file_size, document_type, upload_timestamp, processing_timestamp,
         word_count + 2000 AS word_count, page_count, language, 2 AS arrival FROM doc WHERE doc_id % 10 = 0
  UNION ALL
  SELECT CAST(doc_id + 1000000 AS VARCHAR) AS document_id, filename, file_size, document_type,
         upload_timestamp, processing_timestamp, word_count, page_count, language, 1 AS arrival
  FROM doc WHERE doc_id % 10 = 5),
latest AS (SELECT * EXCLUDE (rn, arrival) FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY arrival DESC) AS rn FROM upd) WHERE rn = 1)
"""


@register("upsert_documents", sql_with("doc_raw", "doc").rstrip() + "," + UPD_SQL + """
SELECT """ + DOC_COLS_SQL + """ FROM doc WHERE document_id NOT IN (SELECT document_id FROM latest)
UNION ALL
SELECT """ + DOC_COLS_SQL + """ FROM latest""")
def upsert_documents(spark, sf_dir):
    base = fx.doc(spark, sf_dir).select(*tables.DOCUMENT_COLUMNS)
    return doc_public(tables.upsert(base, fx.updates(spark, sf_dir), "document_id"))


@register("delete_documents", sql_with("doc_raw", "doc", "del_ids") + """
SELECT """ + DOC_COLS_SQL + """ FROM doc WHERE document_id NOT IN (SELECT document_id FROM del_ids)""")
def delete_documents(spark, sf_dir):
    return doc_public(tables.delete_by_ids(fx.doc(spark, sf_dir), fx.deleted_ids(spark, sf_dir)))


@register("delete_chunks", sql_with("del_ids", "stored_chunks") + """
SELECT chunk_id, document_id, chunk_index FROM stored_chunks
WHERE document_id NOT IN (SELECT document_id FROM del_ids)""")
def delete_chunks(spark, sf_dir):
    kept = tables.delete_by_ids(fx.stored_chunks(spark, sf_dir), fx.deleted_ids(spark, sf_dir))
    return kept.select("chunk_id", "document_id", "chunk_index")


@register("delete_status", sql_with("del_ids", "stored_chunks") + """
SELECT x.document_id,
       CASE WHEN d.document_id IS NOT NULL THEN 'deleted' ELSE 'not_found' END AS status,
       CASE WHEN d.document_id IS NOT NULL THEN coalesce(c.n, 0) ELSE 0 END AS chunks_removed
FROM del_ids x LEFT JOIN doc d ON d.document_id = x.document_id
LEFT JOIN (SELECT document_id, count(*) AS n FROM stored_chunks GROUP BY 1) c ON c.document_id = x.document_id""")
def delete_status(spark, sf_dir):
    return tables.delete_status(fx.deleted_ids(spark, sf_dir), fx.doc(spark, sf_dir),
                                fx.stored_chunks(spark, sf_dir))


# ------------------------------------------------------------------------------ embeddings

HASH_BUCKETS_SQL = """
{p}toks AS (SELECT chunk_id, document_id, unnest(""" + _fmt(WORDS_SQL, t="lower(content)") + """) AS w FROM {src}),
{p}bk AS (SELECT chunk_id, document_id,
              CAST(CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {dim} AS INTEGER) AS bucket,
              count(*) AS n
       FROM {p}toks GROUP BY ALL),
{p}nrm AS (SELECT chunk_id, sqrt(sum(n * n)) AS nrm FROM {p}bk GROUP BY chunk_id),
{p}lf AS (SELECT b.chunk_id, b.document_id, b.bucket,
              CAST(CAST(CAST(b.n AS DOUBLE) / r.nrm AS FLOAT) AS DOUBLE) AS w
       FROM {p}bk b JOIN {p}nrm r ON r.chunk_id = b.chunk_id)
"""


def hash_sql(src: str, dim: int = E.DEFAULT_DIM, prefix: str = "") -> str:
    """Hashing-embedder long form ``{prefix}lf(chunk_id, document_id, bucket, w)`` of a view
    with ``chunk_id, document_id, content``."""
    return HASH_BUCKETS_SQL.replace("{src}", src).replace("{dim}", str(dim)).replace("{p}", prefix)


SUMMARY_SQL = """
SELECT l.chunk_id, l.document_id, count(*) AS nnz,
       CAST(min(l.bucket) FILTER (WHERE l.w = m.mw) AS INTEGER) AS top_bucket, round(max(l.w), 6) AS top_weight
FROM lf l JOIN (SELECT chunk_id, max(w) AS mw FROM lf GROUP BY 1) m ON m.chunk_id = l.chunk_id
GROUP BY l.chunk_id, l.document_id"""


@register("embed_chunks", sql_with("stored_chunks").rstrip() + "," + hash_sql("stored_chunks") + """
SELECT chunk_id, bucket, round(w, 6) AS weight FROM lf""")
def embed_chunks(spark, sf_dir):
    return E.long_form(E.embed_chunks(fx.stored_chunks(spark, sf_dir)))


@register("reindex_all", sql_with("stored_chunks").rstrip() + "," + hash_sql(
    "(SELECT * FROM stored_chunks WHERE document_id IN (SELECT document_id FROM doc))") + SUMMARY_SQL)
def reindex_all(spark, sf_dir):
    ids = fx.doc(spark, sf_dir).select("document_id")                 # SELECT document_id FROM documents
    chunks = fx.stored_chunks(spark, sf_dir).join(ids, "document_id", "left_semi")
    return E.vector_summary(E.embed_chunks(chunks))


@register("reindex_subset", sql_with("stored_chunks").rstrip() + "," + hash_sql(
    "(SELECT * FROM stored_chunks WHERE document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"
    " AND document_id IN (SELECT document_id FROM doc))") + SUMMARY_SQL)
def reindex_subset(spark, sf_dir):
    found = fx.doc(spark, sf_dir).select("document_id").join(fx.labelled_ids(spark, sf_dir), "document_id",
                                                             "left_semi")
    chunks = fx.stored_chunks(spark, sf_dir, found)
    return E.vector_summary(E.embed_chunks(chunks))


@register("reindex_totals", sql_with("stored_chunks") + """
SELECT 'all' AS scope, count(*) FILTER (WHERE n > 0) AS reindexed_count, count(*) AS total_requested
FROM (SELECT d.document_id, count(c.chunk_id) AS n FROM doc d
      LEFT JOIN stored_chunks c ON c.document_id = d.document_id GROUP BY 1)
UNION ALL
SELECT 'subset', count(*) FILTER (WHERE n > 0), count(*)
FROM (SELECT d.document_id, count(c.chunk_id) AS n FROM doc d
      LEFT JOIN stored_chunks c ON c.document_id = d.document_id
      WHERE d.document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) GROUP BY 1)""")
def reindex_totals(spark, sf_dir):
    docs = fx.doc(spark, sf_dir).select("document_id")
    chunks = fx.stored_chunks(spark, sf_dir)
    all_ = tables.chunk_counts(docs, chunks).withColumn("scope", F.lit("all"))
    sub = tables.chunk_counts(docs.join(fx.labelled_ids(spark, sf_dir), "document_id", "left_semi"), chunks) \
        .withColumn("scope", F.lit("subset"))
    return all_.unionByName(sub).groupBy("scope").agg(
        F.count_if(F.col("chunk_count") > 0).alias("reindexed_count"),
        F.count("*").alias("total_requested"))


def _new_ids(spark, sf_dir):
    """Ids for new chunks after those of the stored vectors."""
    stored = fx.vec(spark, sf_dir)
    first = stored.agg(F.max("vector_index_id") + 1).first()[0]
    return store.number_chunks(fx.stored_chunks(spark, sf_dir), stored.limit(0), first)


@register("assign_vector_ids", sql_with("stored_chunks") + """
SELECT chunk_id, (SELECT max(vec_id) FROM embeddings)
       + row_number() OVER (ORDER BY md5(document_id), document_id, chunk_index) AS vector_index_id FROM stored_chunks""")
def assign_vector_ids(spark, sf_dir):
    return _new_ids(spark, sf_dir).select("chunk_id", "vector_index_id")


@register("assign_vector_ids_summary", sql_with("stored_chunks") + """
SELECT count(*) AS n, (SELECT max(vec_id) + 1 FROM embeddings) AS min_id,
       (SELECT max(vec_id) FROM embeddings) + count(*) AS max_id, count(*) AS n_distinct
FROM stored_chunks""")
def assign_vector_ids_summary(spark, sf_dir):
    return _new_ids(spark, sf_dir).agg(F.count("*").alias("n"), F.min("vector_index_id").alias("min_id"),
                                       F.max("vector_index_id").alias("max_id"),
                                       F.count_distinct("vector_index_id").alias("n_distinct"))


@register("vector_store_roundtrip", """
SELECT vec_id AS vector_index_id, CAST(vec_id % 50 AS VARCHAR) || '-' || CAST(vec_id // 50 AS VARCHAR) AS chunk_id,
       CAST(len(embedding) AS INTEGER) AS dim,
       round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm
FROM embeddings""")
def vector_store_roundtrip(spark, sf_dir):
    """Store chunks and vectors in one row per chunk as a new table version, read back with
    the explicit schema (an absent table reads as empty)."""
    v = fx.vec(spark, sf_dir).select(
        "chunk_id", "document_id", "content", "chunk_index",
        F.lit(0).cast("int").alias("start_position"), F.lit(0).cast("int").alias("end_position"),
        "vector_index_id", "embedding")
    root = scratch_dir(spark, "vectors")
    io.write_version(v, root)
    back = io.read_versioned(spark, root, io.VECTORS_SCHEMA)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return back.select("vector_index_id", "chunk_id", F.size("embedding").alias("dim"),
                       F.round(norm, 6).alias("norm"))
