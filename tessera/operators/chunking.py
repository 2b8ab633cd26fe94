"""Word-window chunking and text reassembly.

Chunking is a narrow, shuffle-free projection: the window starts are a ``sequence`` and
each chunk is a ``slice`` of the word array, built as one array of structs per document and
then exploded, so the (possibly huge) word array is not copied into every chunk row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words

# Default window of the reference, in words.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50


def _check(size: int, overlap: int) -> int:
    if size < 1:
        raise ValueError("chunk size must be >= 1")
    if overlap < 0 or overlap >= size:
        raise ValueError("overlap must satisfy 0 <= overlap < size")
    return size - overlap


def chunk_id(document_id, chunk_index) -> Column:
    """Deterministic chunk key, so reruns and stream replays land on the same rows."""
    return F.concat_ws("-", F.col(document_id) if isinstance(document_id, str) else document_id,
                       (F.col(chunk_index) if isinstance(chunk_index, str) else chunk_index).cast("string"))


def chunk_count(word_count: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """How many chunks ``chunk_text`` makes of a text of so many words."""
    n = F.col(word_count)
    return F.when(n > 0, F.floor((n - 1) / F.lit(_check(size, overlap))) + 1).otherwise(F.lit(0)).cast("long")


def chunk_text(docs: DataFrame, text_col: str = "text", id_col: str = "document_id",
               size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: ``chunk_id, document_id, content, chunk_index, start_position,
    end_position`` (word offsets, end exclusive), and the document's columns ``keep``.

    Windows start every ``size - overlap`` words; the last window may lie wholly inside the one
    before it, which the reference keeps, so do we.  Empty text gives no chunk.
    """
    step = _check(size, overlap)
    w = docs.select(F.col(id_col).alias("document_id"), words(text_col).alias("_w"), *keep)
    n = F.size("_w")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>"))
    windows = F.transform(starts, lambda s: F.struct(
        s.alias("start_position"),
        F.least(s + size, n).alias("end_position"),
        F.array_join(F.slice("_w", s + 1, F.lit(size)), " ").alias("content"),
    ))
    exploded = w.select("document_id", *keep, F.posexplode(windows).alias("chunk_index", "c"))
    return exploded.select(
        chunk_id("document_id", "chunk_index").alias("chunk_id"),
        "document_id",
        F.col("c.content").alias("content"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("c.start_position").cast("int").alias("start_position"),
        F.col("c.end_position").cast("int").alias("end_position"),
        *keep,
    )


def reassemble_text(chunks: DataFrame, dedup_overlap: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Document text rebuilt from its chunks in ``chunk_index`` order, joined by one space.

    Parity mode repeats the overlapping words, as the reference does.  ``dedup_overlap``
    drops from each chunk the words the previous chunk already covered (by word offsets), so
    the result is the original word sequence.  One shuffle on ``document_id``; one document's
    chunks are bounded by the largest accepted file.  ``ids`` limits the work to the documents
    a request names.
    """
    if ids is not None:
        # Requested documents only: the semi-join runs before the per-document aggregate.
        chunks = chunks.join(ids.select("document_id"), "document_id", "left_semi")
    if not dedup_overlap:
        part = F.col("content")
    else:
        w = Window.partitionBy("document_id").orderBy("chunk_index")
        skip = F.greatest(F.coalesce(F.lag("end_position").over(w) - F.col("start_position"), F.lit(0)),
                          F.lit(0))
        tail = F.array_join(F.slice(F.split("content", " "), skip + 1, F.lit(1 << 30)), " ")
        # array_join skips NULL elements, so a chunk wholly covered by the previous one vanishes.
        part = F.when(tail != "", tail)
    parts = chunks.select("document_id", F.struct("chunk_index", part.alias("content")).alias("p"))
    agg = parts.groupBy("document_id").agg(F.array_sort(F.collect_list("p")).alias("_ps"))
    return agg.select("document_id",
                      F.array_join(F.transform("_ps", lambda x: x["content"]), " ").alias("text"),
                      F.size("_ps").cast("long").alias("chunk_count"))
