"""tessera: document ingestion, chunking, embedding, vector top-k search, retrieval QA
and corpus text analysis written as Spark DataFrame jobs.

Layout
------
functions/   Column-expression helpers (words, strip, extension, language, vectors)
sources/     readers and writers: raw files, landed uploads, versioned parquet tables
operators/   table-scale operators: chunking, embedding, k-NN, table changes, NLP rules
plans/       composite jobs (ingest, search, QA) and the query catalogue
streaming/   Structured Streaming ingest and search
"""

from tessera.session import get_session, scratch_dir  # noqa: F401

__all__ = ["get_session", "scratch_dir"]
