"""Fixture views over the driver's tables, built in Spark and, side by side, as DuckDB CTEs.

Each Spark builder has an SQL twin in ``SQL_VIEWS`` with the same columns, so every query in
the catalogue can be checked against an independent DuckDB plan over the same parquet.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.chunking import chunk_text
from tessera.session import bound_batches, scratch_dir

# Fixed fixture parameters (FIXTURES.md section 2).
EXT_BY_MOD6 = [".pdf", ".DOCX", ".txt", ".doc", ".html", ""]
DOC_FILTER_IDS = [str(i) for i in range(20)]        # document filter '0'..'19'
VEC_DOCS = 50                                       # vec_id % 50 -> document id
SEARCH_LIMIT = 10
SEARCH_THRESHOLD = 0.25
QA_LIMIT = 5
QA_THRESHOLD = 0.3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an upload: id, file name, size, upload time, text."""
    d = read(spark, sf_dir, "documents")
    m6 = F.pmod(F.col("doc_id"), F.lit(6))
    ext = F.element_at(F.array(*[F.lit(e) for e in EXT_BY_MOD6]), (m6 + 1).cast("int"))
    m50 = F.pmod(F.col("doc_id"), F.lit(50))
    size = (F.when(m50 == 0, F.lit(52_428_801)).when(m50 == 1, F.lit(52_428_800))
            .otherwise(F.col("n_chars").cast("int")))
    ts = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id DIV 3 AS INT), 0)")
    return d.select(
        F.col("doc_id").cast("string").alias("document_id"),
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext).alias("filename"),
        size.alias("file_size"),
        ts.alias("upload_timestamp"),
        "text",
        "lang",
    )


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted uploads with their stored metadata (documents table) plus ``text``."""
    r = doc_raw(spark, sf_dir)
    return r.where(T.validation_reason("file_size", "filename").isNull()).select(
        "document_id", "doc_id", "filename", "file_size",
        T.document_type("filename").alias("document_type"),
        "upload_timestamp",
        F.col("upload_timestamp").alias("processing_timestamp"),
        T.word_count("text").alias("word_count"),
        F.lit(None).cast("int").alias("page_count"),
        T.language_substring("text").alias("language"),
        "text",
    )


# Upload bytes for the fixture's texts: DOCX archives, plain text, and a stand-in for PDF (a header line before
# the text) with its extractor.

def build_docx(paragraphs: list[str]) -> bytes:
    """A minimal DOCX archive with one run per paragraph (used to derive test uploads)."""
    from xml.sax.saxutils import escape
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    doc = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
           '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
           f'<w:body>{body}</w:body></w:document>')
    ctypes = ('<?xml version="1.0" encoding="UTF-8"?>'
              '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
              '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
              '<Default Extension="xml" ContentType="application/xml"/>'
              '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-'
              'officedocument.wordprocessingml.document.main+xml"/></Types>')
    rels = ('<?xml version="1.0" encoding="UTF-8"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
            'relationships/officeDocument" Target="word/document.xml"/></Relationships>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", ctypes), ("_rels/.rels", rels), ("word/document.xml", doc)):
            # a time of its own: the same paragraphs are the same bytes whenever they are built
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), part, zipfile.ZIP_DEFLATED)
    return buf.getvalue()


PDF_HEADER = b"%PDF-1.4\n"


def pdf_extractor(data: bytes) -> list[str]:
    """The extractor the registered queries inject for the fixture's PDF stand-ins."""
    if not data.startswith(PDF_HEADER):
        raise ValueError("not a fixture PDF")
    return [data[len(PDF_HEADER):].decode("utf-8")]


def uploads_from_text(docs: DataFrame) -> DataFrame:
    """Derive upload bytes from stored text by document type: TXT as UTF-8, DOCX / DOC as an
    archive with one paragraph per line, PDF as bytes with a PDF header (needs an extractor)."""
    def make(it):
        for pdf in it:
            contents = []
            for typ, text in zip(pdf["document_type"], pdf["text"]):
                t = text or ""
                if typ == "docx":
                    contents.append(build_docx(t.split("\n")))
                elif typ == "pdf":
                    contents.append(PDF_HEADER + t.encode("utf-8"))
                else:
                    contents.append(t.encode("utf-8"))
            out = pdf.drop(columns=["text"])
            out["content"] = contents
            yield out

    bound_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c != "text"]
    schema = docs.select(*cols).schema.add("content", "binary")
    return docs.mapInPandas(make, schema)


def chunks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunker output over every document (accepted or not)."""
    return chunk_text(doc_raw(spark, sf_dir))


def accepted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_id, text`` of accepted uploads (no metadata columns to analyse or compute)."""
    r = doc_raw(spark, sf_dir)
    return r.where(T.validation_reason("file_size", "filename").isNull()).select("document_id", "text")


def stored_chunks(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Chunks of stored (accepted) documents only: what ingest would have written.  With
    ``ids``, only the chunks of those documents (semi-join before chunking)."""
    docs = accepted_text(spark, sf_dir)
    if ids is not None:
        docs = docs.join(ids.select("document_id"), "document_id", "left_semi")
    return chunk_text(docs)


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors with their chunk metadata (one row each)."""
    e = read(spark, sf_dir, "embeddings")
    did = F.pmod(F.col("vec_id"), F.lit(VEC_DOCS)).cast("string")
    cidx = F.expr(f"CAST(vec_id DIV {VEC_DOCS} AS INT)")
    return e.select(
        F.col("vec_id").alias("vector_index_id"),
        did.alias("document_id"),
        cidx.alias("chunk_index"),
        F.concat_ws("-", did, cidx.cast("string")).alias("chunk_id"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"),
        "embedding",
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector used as a query (all-vs-all search)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def deleted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests: ids of uploads with ``doc_id % 7 = 0`` (some were never stored)."""
    return doc_raw(spark, sf_dir).where(F.pmod("doc_id", F.lit(7)) == 0).select("document_id")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert batch: changed rows given twice (arrival 1 and 2) plus brand-new ids."""
    d = doc(spark, sf_dir)
    base_cols = ["document_id", "filename", "file_size", "document_type", "upload_timestamp",
                 "processing_timestamp", "word_count", "page_count", "language"]
    changed = d.where(F.pmod("doc_id", F.lit(10)) == 0)
    a1 = changed.select(*[c for c in base_cols if c != "word_count"],
                        (F.col("word_count") + 1000).alias("word_count"), F.lit(1).alias("arrival"))
    a2 = changed.select(*[c for c in base_cols if c != "word_count"],
                        (F.col("word_count") + 2000).alias("word_count"), F.lit(2).alias("arrival"))
    new = d.where(F.pmod("doc_id", F.lit(10)) == 5).select(
        (F.col("doc_id") + 1_000_000).cast("string").alias("document_id"),
        *[c for c in base_cols if c != "document_id"], F.lit(1).alias("arrival"))
    return a1.unionByName(a2).unionByName(new)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-or-document requests from ``benchmark`` (every combination by ``item_id % 5``)."""
    b = read(spark, sf_dir, "benchmark")
    m = F.pmod("item_id", F.lit(5))
    txt = (F.when(m == 0, F.col("text")).when(m == 1, F.lit("")).when(m == 4, F.col("text"))
           .otherwise(F.lit(None).cast("string")))
    did = (F.when(m == 1, F.col("item_id").cast("string"))
           .when(m == 2, F.concat(F.lit("missing-"), F.col("item_id").cast("string")))
           .when(m == 4, F.col("item_id").cast("string"))
           .otherwise(F.lit(None).cast("string")))
    m3 = F.pmod("item_id", F.lit(3))   # each request's own summary lengths, or the defaults
    return b.select(F.col("item_id").alias("request_id"), txt.alias("text"), did.alias("document_id"),
                    F.when(m3 == 1, 20).when(m3 == 2, 60).otherwise(150).alias("max_length"),
                    F.when(m3 == 1, 5).when(m3 == 2, 10).otherwise(30).alias("min_length"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"),
                    F.col("item_id").cast("string").alias("document_id"),
                    # every fourth question is asked of sixty documents only
                    F.when(F.pmod("item_id", F.lit(4)) == 3, F.transform(
                        F.sequence(F.col("item_id") * 3, F.col("item_id") * 3 + 59), lambda x: x.cast("string"))).alias("document_ids"))


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id requests taken from ``labels`` (order = doc_id, may name unstored documents)."""
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("document_id"))


# ---------------------------------------------------------------------------------------
# DuckDB twins.  Word split pattern, extension pattern and markers are the same text as the
# Spark side.
WS = T.WS_CLASS
WORDS_SQL = "list_filter(regexp_split_to_array({t}, '" + WS + "+'), lambda x: x <> '')"
LANG_SQL = ("CASE WHEN (" + " + ".join(
    f"CAST(contains(lower({{t}}), '{m}') AS INTEGER)" for m in T.ENGLISH_MARKERS) +
    f") >= {T.ENGLISH_MIN_MARKERS} THEN 'en' ELSE 'unknown' END")
EXT_SQL = "regexp_extract({f}, '" + T.SPLITEXT_PATTERN + "', 1)"
REASON_SQL = ("CASE WHEN {s} > " + str(T.MAX_FILE_SIZE) + " THEN 'too_large' WHEN lower(" + EXT_SQL +
              ") NOT IN ('.pdf', '.docx', '.txt', '.doc') THEN 'bad_extension' END")
TYPE_SQL = ("CASE lower(" + EXT_SQL + ") WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' "
            "WHEN '.doc' THEN 'docx' WHEN '.txt' THEN 'txt' END")


def _fmt(tmpl: str, **kw) -> str:
    return tmpl.replace("{t}", kw.get("t", "")).replace("{f}", kw.get("f", "")).replace(
        "{s}", kw.get("s", "")).replace("{c}", kw.get("c", ""))


SQL_VIEWS = {
    "doc_raw": """
  SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id,
         'doc_' || CAST(doc_id AS VARCHAR) ||
           CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.txt'
                           WHEN 3 THEN '.doc' WHEN 4 THEN '.html' ELSE '' END AS filename,
         CAST(CASE WHEN doc_id % 50 = 0 THEN 52428801 WHEN doc_id % 50 = 1 THEN 52428800
                   ELSE n_chars END AS INTEGER) AS file_size,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id // 3 AS BIGINT)) AS upload_timestamp,
         text, lang
  FROM documents""",
    "doc": """
  SELECT document_id, doc_id, filename, file_size,
         """ + _fmt(TYPE_SQL, f="filename") + """ AS document_type,
         upload_timestamp, upload_timestamp AS processing_timestamp,
         CAST(len(""" + _fmt(WORDS_SQL, t="text") + """) AS INTEGER) AS word_count,
         CAST(NULL AS INTEGER) AS page_count,
         """ + _fmt(LANG_SQL, t="text") + """ AS language,
         text
  FROM doc_raw
  WHERE (""" + _fmt(REASON_SQL, s="file_size", f="filename") + """) IS NULL""",
    # chunker over a documents-like view (document_id, text); {src} is substituted
    "chunks_of": """
  SELECT document_id || '-' || CAST(CAST(s // 462 AS INTEGER) AS VARCHAR) AS chunk_id,
         document_id,
         array_to_string(w[s + 1 : s + 512], ' ') AS content,
         CAST(s // 462 AS INTEGER) AS chunk_index,
         CAST(s AS INTEGER) AS start_position,
         CAST(least(s + 512, len(w)) AS INTEGER) AS end_position
  FROM (SELECT document_id, w, unnest(range(0, len(w), 462)) AS s
        FROM (SELECT document_id, """ + _fmt(WORDS_SQL, t="text") + """ AS w FROM {src}))""",
    "vec": """
  SELECT vec_id AS vector_index_id, CAST(vec_id % 50 AS VARCHAR) AS document_id,
         CAST(vec_id // 50 AS INTEGER) AS chunk_index,
         CAST(vec_id % 50 AS VARCHAR) || '-' || CAST(CAST(vec_id // 50 AS INTEGER) AS VARCHAR) AS chunk_id,
         'chunk ' || CAST(vec_id AS VARCHAR) AS content,
         embedding
  FROM embeddings""",
    "del_ids": "SELECT document_id FROM doc_raw WHERE doc_id % 7 = 0",
}


def sql_with(*names: str) -> str:
    """A ``WITH`` clause defining the named fixture views (dependencies included, in order)."""
    order = []
    deps = {"doc": ["doc_raw"], "del_ids": ["doc_raw"], "chunks": ["doc_raw"],
            "stored_chunks": ["doc_raw", "doc"]}

    def add(n):
        for d in deps.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = []
    for n in order:
        if n == "chunks":
            body = SQL_VIEWS["chunks_of"].replace("{src}", "doc_raw")
        elif n == "stored_chunks":
            body = SQL_VIEWS["chunks_of"].replace("{src}", "doc")
        else:
            body = SQL_VIEWS[n]
        parts.append(f"{n} AS ({body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
