"""Operator 8: exact deduplication by content-defined chunk recipes.

A text is normalised (each run of blank, tab, line feed, vertical tab, form feed or return becomes
one blank), cut where a rolling hash of its last bytes meets a mask, and described by its recipe:
the ordered identifiers of its chunks.  Chunks are deduplicated by content over the whole corpus,
and an identifier is trusted only if all chunks that carry it are equal byte for byte; where they are
not, the chunk's rank among the different contents joins the identifier.  Documents are then
compared by recipe alone, so each text moves once, as chunks, and never again.

Defined cases: null text = empty text; empty texts equal each other; null doc_ids lose against any
other and tie among themselves; of repeated rows one stays; a text of any length is cut whole, and only its chunk
names leave the scan; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

AVERAGE = 4096          # mean distance of cuts, a power of two
SMALLEST, LARGEST = 1024, 65536
HASH_BYTES = 16

_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_GEAR = np.random.default_rng(8).integers(0, 2**32, 256, dtype=np.uint32)


def normalise(text: str | None) -> bytes:
    b = (text or "").encode("utf-8", "surrogatepass").translate(_BLANKS)
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    return b


def cut(b: bytes) -> list[bytes]:
    """The chunks of ``b``; cuts depend only on the bytes before them."""
    if len(b) <= SMALLEST:
        return [b]
    g = _GEAR[np.frombuffer(b, np.uint8)]
    for w in (1, 2, 4, 8):  # after these the sum covers 16 bytes, each shifted by its distance
        g[w:] += g[:-w] << np.uint32(2 * w)
    marks = np.flatnonzero(g >> np.uint32(32 - AVERAGE.bit_length() + 1) == 0) + 1
    out, start = [], 0
    for m in [*marks.tolist(), len(b)]:
        while m - start > LARGEST:
            out.append(b[start:start + LARGEST])
            start += LARGEST
        if m - start >= SMALLEST or m == len(b):
            if m > start:
                out.append(b[start:m])
            start = m
    return out


def _name(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(docs: DataFrame, row_id: str, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """``row_id, doc_id, recipe, text_sha256``: the small rows that stand for the documents."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        texts = [normalise(t) for t in part["text"]]
        return pd.DataFrame({"row_id": part["row_id"], "doc_id": part["doc_id"],
                             "recipe": [b"".join(_name(c, hash_bytes) for c in cut(t)) for t in texts],
                             "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})
    # Ids pass Python as text: pandas would turn longs with nulls into doubles.
    return docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        C.per_batch(run), "row_id long, doc_id string, recipe binary, text_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))


def chunks(docs: DataFrame, row_id: str, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """``row_id, seq, name, chunk`` of every chunk."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(r, i, _name(c, hash_bytes), c) for r, t in zip(part["row_id"], part["text"], strict=True)
                for i, c in enumerate(cut(normalise(t)))]
        return pd.DataFrame(rows, columns=["row_id", "seq", "name", "chunk"])
    return docs.select(F.col(row_id).alias("row_id"), "text").mapInPandas(
        C.per_batch(run), "row_id long, seq int, name binary, chunk binary")


def group_equal_texts(docs: DataFrame, hash_bytes: int = HASH_BYTES, row_id: str | None = None) -> DataFrame:
    """``row_id, doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    if row_id is None:
        docs, row_id = C.numbered(docs.select("doc_id", "text"), "exact-rows")
    found = chunks(docs, row_id, hash_bytes)
    distinct = found.select("name", "chunk").dropDuplicates()
    clashing = C.materialise(distinct.groupBy("name").count().where("count > 1").select("name"), "clashing")
    docs_by_recipe = C.materialise(recipes(docs, row_id, hash_bytes), "recipes").withColumn("ranks", F.lit(""))
    if not clashing.isEmpty():
        # Different chunks under one name: their rank by content completes the identifier.
        order = Window.partitionBy("name").orderBy("chunk")
        ranked = distinct.join(clashing, "name", "left_semi").withColumn("rank", F.row_number().over(order))
        extra = (found.join(ranked, ["name", "chunk"]).groupBy("row_id")
                 .agg(F.sort_array(F.collect_list(F.struct("seq", "rank"))).cast("string").alias("extra")))
        docs_by_recipe = (docs_by_recipe.join(extra, "row_id", "left")
                          .withColumn("ranks", F.coalesce("extra", F.lit(""))).drop("extra"))
    out = C.equal_groups(docs_by_recipe, ["recipe", "ranks"], "row_id", "doc_id")
    return out.select("row_id", "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")
