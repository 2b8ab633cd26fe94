"""Document-level queries: validation, lookups, paging, chunking, language, reassembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, tables
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register
from tessera.plans.fixtures import sql_with, _fmt, EXT_SQL, REASON_SQL, TYPE_SQL, WORDS_SQL
from tessera.session import scratch_dir

DOC_COLS_SQL = """document_id, filename, file_size, document_type,
       strftime(upload_timestamp, '%Y-%m-%dT%H:%M:%S') AS upload_timestamp,
       strftime(processing_timestamp, '%Y-%m-%dT%H:%M:%S') AS processing_timestamp,
       word_count, page_count, language"""


def doc_public(df, *extra):
    """The nine stored document columns, timestamps printed as ISO text."""
    return df.select(*extra, "document_id", "filename", "file_size", "document_type",
                     T.iso_timestamp("upload_timestamp").alias("upload_timestamp"),
                     T.iso_timestamp("processing_timestamp").alias("processing_timestamp"),
                     "word_count", "page_count", "language")


@register("validate_uploads", sql_with("doc_raw") + """
SELECT document_id, filename, file_size,
       lower(""" + _fmt(EXT_SQL, f="filename") + """) AS extension,
       CASE WHEN r IS NULL THEN """ + _fmt(TYPE_SQL, f="filename") + """ END AS document_type,
       CASE WHEN r IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
       r AS reason
FROM (SELECT *, """ + _fmt(REASON_SQL, s="file_size", f="filename") + """ AS r FROM doc_raw)""")
def validate_uploads(spark, sf_dir):
    return tables.validate_uploads(fx.doc_raw(spark, sf_dir))


@register("get_documents", sql_with("doc_raw", "doc") + """
SELECT r.document_id AS requested_id, d.document_id IS NOT NULL AS found, d.filename, d.file_size,
       d.document_type, strftime(d.upload_timestamp, '%Y-%m-%dT%H:%M:%S') AS upload_timestamp,
       strftime(d.processing_timestamp, '%Y-%m-%dT%H:%M:%S') AS processing_timestamp,
       d.word_count, d.page_count, d.language
FROM doc_raw r LEFT JOIN doc d ON r.document_id = d.document_id""")
def get_documents(spark, sf_dir):
    req = fx.doc_raw(spark, sf_dir).select(F.col("document_id").alias("requested_id"))
    got = tables.lookup_documents(req, doc_public(fx.doc(spark, sf_dir)), id_col="requested_id")
    return got.drop("document_id")


@register("list_documents", sql_with("doc_raw", "doc") + """
SELECT row_number() OVER (ORDER BY ts DESC, document_id) AS page_position, (SELECT count(*) FROM doc) AS total_count, * EXCLUDE (ts)
FROM (SELECT upload_timestamp AS ts, """ + DOC_COLS_SQL + """ FROM doc
      ORDER BY ts DESC, document_id LIMIT 50 OFFSET 10)""")
def list_documents(spark, sf_dir):
    return _late_page(spark, sf_dir, lambda keys: tables.list_documents(keys, limit=50, offset=10, with_total=True))


def _late_page(spark, sf_dir, pager):
    """Page over key columns only, then derive the text columns (word count, language) for the
    page's rows alone: the regex work is per page, not per table."""
    raw = fx.doc_raw(spark, sf_dir)
    keys = raw.where(T.validation_reason("file_size", "filename").isNull()).select(
        "document_id", "filename", "file_size", T.document_type("filename").alias("document_type"),
        "upload_timestamp", F.col("upload_timestamp").alias("processing_timestamp"))
    page = pager(keys)
    text = fx.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    extra = [c for c in ("page_position", "total_count") if c in page.columns]
    full = page.join(text, "document_id").select(
        *extra, "document_id", "filename", "file_size", "document_type", "upload_timestamp",
        "processing_timestamp", T.word_count("text").alias("word_count"),
        F.lit(None).cast("int").alias("page_count"), T.language_substring("text").alias("language"))
    return doc_public(full, *extra)


@register("list_documents_keyset", sql_with("doc_raw", "doc") + """
SELECT row_number() OVER (ORDER BY ts DESC, document_id) AS page_position, * EXCLUDE (ts)
FROM (SELECT upload_timestamp AS ts, """ + DOC_COLS_SQL + """ FROM doc
      WHERE upload_timestamp < TIMESTAMP '2024-01-01 02:00:00'
         OR (upload_timestamp = TIMESTAMP '2024-01-01 02:00:00' AND document_id > '361')
      ORDER BY ts DESC, document_id LIMIT 50)""")
def list_documents_keyset(spark, sf_dir):
    return _late_page(spark, sf_dir,
                      lambda keys: tables.list_documents_after(keys, "2024-01-01 02:00:00", "361", limit=50))


@register("list_documents_deep", sql_with("doc_raw", "doc") + """
SELECT ord // 7 AS page, ord % 7 + 1 AS page_position, * EXCLUDE (ts, ord, total)
FROM (SELECT upload_timestamp AS ts, row_number() OVER (ORDER BY upload_timestamp DESC, document_id) - 1 AS ord, count(*) OVER () AS total, """ + DOC_COLS_SQL + """ FROM doc)
WHERE ord // 7 IN (total // 4 // 7, total // 2 // 7, (total - 1) // 7)""")
def list_documents_deep(spark, sf_dir):
    """Pages of seven from a listing table: at a quarter, in the middle and the last one."""
    path = scratch_dir(spark, "listing")
    total = tables.write_listing(fx.materialise(fx.doc(spark, sf_dir).select(*tables.DOCUMENT_COLUMNS), "documents"), path, part_rows=200)
    out = None
    for page in sorted({total // 4 // 7, total // 2 // 7, (total - 1) // 7}):
        rows = tables.read_page(spark, path, 7, 7 * page).withColumn("page", F.lit(page).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return doc_public(out, "page", "page_position")


@register("chunk_text", sql_with("chunks") + "SELECT * FROM chunks")
def chunk_text(spark, sf_dir):
    return fx.chunks_all(spark, sf_dir)


@register("document_chunks", sql_with("stored_chunks") + """
SELECT l.pos, c.document_id, c.chunk_id, c.content, c.chunk_index, c.start_position, c.end_position
FROM (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS document_id FROM labels) l
JOIN stored_chunks c ON c.document_id = l.document_id""")
def document_chunks(spark, sf_dir):
    ids = fx.labelled_ids(spark, sf_dir)
    return tables.document_chunks(ids, fx.stored_chunks(spark, sf_dir, ids))


@register("document_chunk_counts", sql_with("stored_chunks") + """
SELECT d.document_id, count(c.chunk_id) AS chunk_count
FROM doc d LEFT JOIN stored_chunks c ON c.document_id = d.document_id
GROUP BY d.document_id""")
def document_chunk_counts(spark, sf_dir):
    return tables.chunk_counts(fx.doc(spark, sf_dir).select("document_id"), fx.stored_chunks(spark, sf_dir))


@register("orphan_chunks", sql_with("doc", "chunks") + """
SELECT c.chunk_id, c.document_id FROM chunks c
WHERE NOT EXISTS (SELECT 1 FROM doc d WHERE d.document_id = c.document_id)""")
def orphan_chunks(spark, sf_dir):
    return tables.orphan_chunks(fx.chunks_all(spark, sf_dir), fx.doc(spark, sf_dir))


@register("detect_language", sql_with("doc_raw") + """
SELECT document_id, lang, """ + fx._fmt(fx.LANG_SQL, t="text") + """ AS language FROM doc_raw""")
def detect_language(spark, sf_dir):
    return fx.doc_raw(spark, sf_dir).select("document_id", "lang", T.language_substring("text").alias("language"))


@register("detect_language_token", sql_with("doc_raw") + """
SELECT document_id, lang,
       CASE WHEN len(list_intersect(['""" + "', '".join(T.ENGLISH_MARKERS) + """'],
                                    regexp_split_to_array(lower(text), '""" + T.NON_WORD_PATTERN + """'))) >= 3
            THEN 'en' ELSE 'unknown' END AS language
FROM doc_raw""")
def detect_language_token(spark, sf_dir):
    return fx.doc_raw(spark, sf_dir).select("document_id", "lang", T.language_token("text").alias("language"))


@register("reassemble_text", sql_with("stored_chunks") + """
SELECT document_id, string_agg(content, ' ' ORDER BY chunk_index) AS text, count(*) AS chunk_count
FROM stored_chunks GROUP BY document_id""")
def reassemble_text(spark, sf_dir):
    return chunking.reassemble_text(fx.stored_chunks(spark, sf_dir))


@register("reassemble_text_dedup", sql_with("doc", "stored_chunks") + """
SELECT d.document_id, array_to_string(""" + _fmt(WORDS_SQL, t="d.text") + """, ' ') AS text,
       c.chunk_count
FROM doc d JOIN (SELECT document_id, count(*) AS chunk_count FROM stored_chunks GROUP BY 1) c
  ON c.document_id = d.document_id""")
def reassemble_text_dedup(spark, sf_dir):
    return chunking.reassemble_text(fx.stored_chunks(spark, sf_dir), dedup_overlap=True)
