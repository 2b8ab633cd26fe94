"""Batch ingest: validate -> extract -> metadata -> chunk -> embed, as one plan without joins.

Every stage is a DataFrame over all uploads of the batch.  One narrow pass extracts the text and keeps
the metadata and the error beside it; documents, chunks and status are projections of that pass, so it
is persisted when all three are written (recomputed from lineage if an executor is lost).
``tessera.plans.store`` writes the results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, embed, tables
from tessera.sources import files


@dataclass
class IngestResult:
    """The outputs are projections of ``extracted``; each is planned when it is asked for."""
    extracted: DataFrame     # the pass they share; call ``release()`` when done
    size: int
    overlap: int
    embedder: object

    @cached_property
    def accepted(self) -> DataFrame:
        """The documents' uploads with text, word count and, if kept, their bytes (``upload``)."""
        return self.extracted.where("reason IS NULL AND error IS NULL")

    @cached_property
    def documents(self) -> DataFrame:
        """Stored document rows (9 columns)."""
        return self.accepted.select(
            "document_id", "filename", F.col("file_size").cast("int").alias("file_size"), "document_type",
            "upload_timestamp", F.col("upload_timestamp").alias("processing_timestamp"),
            "word_count", F.lit(None).cast("int").alias("page_count"),
            T.language_substring("text").alias("language"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunk rows."""
        return chunking.chunk_text(self.accepted.select("document_id", "text"), size=self.size, overlap=self.overlap)

    @cached_property
    def vectors(self) -> DataFrame:
        """Chunk rows with their embedding."""
        return embed.embed_chunks(self.chunks, self.embedder)

    @cached_property
    def status(self) -> DataFrame:
        """``document_id, status`` (completed / failed / rejected), ``reason``."""
        return self.extracted.select(
            "document_id",
            F.when(F.col("reason").isNotNull(), F.lit("rejected"))
            .when(F.col("error").isNotNull(), F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
            F.coalesce("reason", "error").alias("reason"))

    def release(self) -> None:
        if self.extracted.storageLevel.useMemory or self.extracted.storageLevel.useDisk:
            self.extracted.unpersist()


def ingest(uploads: DataFrame, *, embedder=None, size: int = chunking.CHUNK_SIZE,
           overlap: int = chunking.CHUNK_OVERLAP, pdf_extractor=None, persist: bool = False, keep_uploads: bool = False) -> IngestResult:
    """``uploads``: ``document_id, filename, file_size, upload_timestamp, content``.

    ``persist=True`` keeps the extracted text for the outputs (call ``release()`` after
    writing them); a caller that needs one output leaves it off.  ``keep_uploads`` keeps accepted bytes beside it, so that
    uploads which are stored too are read (or derived) once."""
    reason = T.validation_reason("file_size", "filename")   # on the size as given; accepted sizes fit an INT
    checked = uploads.select("document_id", "filename", "file_size", "upload_timestamp", "content", reason.alias("reason"))
    taken = {"document_type": T.document_type("filename"), "content": F.col("content")} | ({"upload": F.col("content")} if keep_uploads else {})
    ext = files.extract(checked.withColumns({c: F.when(F.col("reason").isNull(), x) for c, x in taken.items()}), pdf_extractor)
    ext = ext.withColumn("word_count", T.word_count("text"))
    if persist:
        ext = ext.persist(StorageLevel.MEMORY_AND_DISK)
    return IngestResult(ext, size, overlap, embedder)
