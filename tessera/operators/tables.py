"""Table operators: validation, keyed lookups, paging, upsert, delete, compaction, key
checks, statistics and dense id assignment.

Spark enforces no keys, so primary-key replacement is an anti-join plus union, deletes are
anti-joins, and the foreign key is a check job.  Nothing here collects rows to the driver beyond a bounded number of
range ends.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

DOCUMENT_COLUMNS = ["document_id", "filename", "file_size", "document_type", "upload_timestamp",
                    "processing_timestamp", "word_count", "page_count", "language"]
CHUNK_COLUMNS = ["chunk_id", "document_id", "content", "chunk_index", "start_position",
                 "end_position", "vector_index_id"]


def validate_uploads(uploads: DataFrame, size_col: str = "file_size", name_col: str = "filename") -> DataFrame:
    """Accept / reject each upload with the first failing reason (size before extension)."""
    reason = T.validation_reason(size_col, name_col)
    return uploads.select(
        "document_id", name_col, size_col,
        F.lower(T.extension(name_col)).alias("extension"),
        F.when(reason.isNull(), T.document_type(name_col)).alias("document_type"),
        F.when(reason.isNull(), F.lit("accepted")).otherwise(F.lit("rejected")).alias("status"),
        reason.alias("reason"),
    )


def lookup_documents(requests: DataFrame, documents: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Keyed lookup for many ids at once; every request row is kept with a ``found`` flag."""
    joined = requests.join(documents, requests[id_col] == documents["document_id"], "left")
    return joined.select(requests[id_col], documents["document_id"].isNotNull().alias("found"),
                         *[documents[c] for c in documents.columns])


def restrict_to_ids(table: DataFrame, ids, key: str = "document_id") -> DataFrame:
    """``WHERE key IN (...)``, in the form the caller chooses: a list becomes an ``In`` predicate that
    reaches the parquet scan (row-group pruning), a DataFrame a semi-join."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select(key), key, "left_semi")
    return table.where(F.col(key).isin([str(i) for i in ids]))


def id_ranges(rows: DataFrame, key: str, most: int = 256) -> Column:
    """A predicate on ``key`` that every key of ``rows`` meets: at most ``most`` ranges, which reach the Parquet scan of a table
    clustered by that key and let it skip row groups.  Runs two small aggregates over ``rows``; the join with them stays
    what decides."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return F.lit(False)
    width = -(-(high - low + 1) // most)
    cells = rows.groupBy(F.expr(f"({key} - {low}L) DIV {width}L").alias("cell")).agg(F.min(key).alias("a"), F.max(key).alias("b"))
    found = [F.col(key).between(r.a, r.b) for r in cells.where("a IS NOT NULL").orderBy("a").collect()]
    return reduce(Column.__or__, found)


def list_documents(documents: DataFrame, limit: int = 50, offset: int = 0, with_total: bool = False) -> DataFrame:
    """Newest first, ``document_id`` breaking ties; ``LIMIT``/``OFFSET`` become one
    ``TakeOrderedAndProject``.  ``page_position`` is 1-based within the page."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be >= 1 and offset >= 0")
    order = [F.col("upload_timestamp").desc(), F.col("document_id").asc()]
    if with_total:   # a scalar subquery: one count beside the page, no join of rows
        documents = documents.withColumn("total_count", documents.agg(F.count(F.lit(1))).scalar())
    page = documents.orderBy(*order).offset(offset).limit(limit)
    # The page is at most ``limit`` rows, so numbering it in one partition is bounded.
    return page.withColumn("page_position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def write_listing(documents: DataFrame, path: str, part_rows: int = 100_000) -> int:
    """A listing table for pages of any depth: ``documents`` in range partitions of about ``part_rows`` in page order (newest
    first, then id), each sorted, in folders ``part=<n>``; returns how many rows it has.  ``sizes`` beside them holds the
    rows of each part."""
    spark = documents.sparkSession
    total = documents.count()
    order = [F.col("upload_timestamp").desc(), F.col("document_id").asc()]
    rows = documents.repartitionByRange(max(1, -(-total // part_rows)), *order).withColumn("part", F.spark_partition_id())
    writer = rows.sortWithinPartitions("part", *order).write
    (writer.partitionBy("part") if total else writer).parquet(f"{path}/rows")   # an empty table keeps its columns in a file
    spark.read.parquet(f"{path}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/sizes")
    return total


def read_page(spark: SparkSession, path: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a listing table, with ``page_position``: the sizes tell which parts hold it, and only those are read, the
    last page as cheaply as the first."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be >= 1 and offset >= 0")
    sizes = [(r.part, r.n) for r in spark.read.parquet(f"{path}/sizes").orderBy("part").collect()]   # one row a part
    starts = [0, *accumulate(n for _, n in sizes)][:len(sizes)]
    held = [(p, s) for (p, n), s in zip(sizes, starts, strict=True) if s < offset + limit and s + n > offset]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("part").isin([p for p, _ in held])).drop("part")
    return list_documents(rows, limit, offset - held[0][1] if held else 0)


def list_documents_after(documents: DataFrame, after_timestamp, after_id: str, limit: int = 50) -> DataFrame:
    """Keyset page for deep paging: rows strictly after the cursor ``(timestamp, id)`` in
    (newest first, id) order.  The cursor predicate is pushed to the scan and the page is a
    ``TakeOrderedAndProject``; cost does not grow with the page number as OFFSET does."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    ts, did = F.col("upload_timestamp"), F.col("document_id")
    if hasattr(after_timestamp, "isoformat"):
        # naive UTC wall-clock text, so no driver or session time zone shifts the cursor
        after_timestamp = after_timestamp.isoformat(sep=" ")
    c_ts = F.lit(str(after_timestamp)).cast("timestamp_ntz")
    after = (ts < c_ts) | ((ts == c_ts) & (did > F.lit(after_id)))
    order = [ts.desc(), did.asc()]
    page = documents.where(after).orderBy(*order).limit(limit)
    return page.withColumn("page_position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def document_chunks(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the requested documents (ids without chunks give no rows, the 404 case), by request and in the
    order of the chunks."""
    return requests.join(chunks, "document_id", "inner").select(
        "pos", "document_id", "chunk_id", "content", "chunk_index", "start_position", "end_position").orderBy("pos", "document_id", "chunk_index")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per document; partial counts are combined map-side before the shuffle."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return documents.select("document_id").join(counts, "document_id", "left").select(
        "document_id", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))


def orphan_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Foreign-key check: chunks whose document is not stored (must be empty in a sound store)."""
    return chunks.join(documents.select("document_id"), "document_id", "left_anti").select("chunk_id", "document_id")


def latest_per_key(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The row with the highest ``order_col`` per key, as an aggregate (``max_by``) so that a
    hot key is reduced map-side instead of gathering all its rows in one task."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.max_by(packed, F.struct(F.col(order_col), packed)).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, changes: DataFrame, key: str | list[str], order_col: str = "arrival") -> DataFrame:
    """``INSERT OR REPLACE`` by key: the last arrival per key wins, replaced keys leave the base.

    The change batch is reduced to one row per key (partial aggregation map-side), then
    ``base anti-join changes`` united with the latest rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    latest = latest_per_key(changes, keys, order_col).drop(order_col).select(*base.columns)
    kept = base.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest)


def delete_by_ids(table: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of ``table`` whose key is not in ``ids``."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def delete_status(ids: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per delete request: found or not, and how many chunks go with it."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunks_removed"))
    found = documents.select("document_id").withColumn("_f", F.lit(True))
    return (ids.join(found, "document_id", "left").join(n, "document_id", "left")
            .select("document_id",
                    F.when(F.col("_f"), F.lit("deleted")).otherwise(F.lit("not_found")).alias("status"),
                    F.when(F.col("_f"), F.coalesce("chunks_removed", F.lit(0))).otherwise(F.lit(0))
                    .cast("long").alias("chunks_removed")))


def compact_vectors(vectors: DataFrame, live_chunks: DataFrame, key: str = "vector_index_id") -> DataFrame:
    """Drop tombstoned vectors: keep those whose chunk is still stored."""
    return vectors.join(live_chunks.select(key), key, "left_semi")


def corpus_stats(documents: DataFrame, chunks: DataFrame, vectors: DataFrame,
                 key: str = "vector_index_id") -> DataFrame:
    """One statistics row from a single aggregate over the three tables, tagged and unioned
    (partial counts map-side, no joins of one-row frames, no driver round trips).

    ``vector_count`` includes tombstones as the reference does; ``live``/``stale`` split it.
    """
    none_i = F.lit(None).cast("int")
    d = documents.select(F.lit("d").alias("_t"), none_i.alias("_live"), none_i.alias("_dim"))
    c = chunks.select(F.lit("c").alias("_t"), none_i.alias("_live"), none_i.alias("_dim"))
    v = (vectors.join(chunks.select(key).distinct().withColumn("_l", F.lit(1)), key, "left")
         .select(F.lit("v").alias("_t"), F.col("_l").cast("int").alias("_live"),
                 F.size("embedding").alias("_dim")))
    agg = d.unionByName(c).unionByName(v).agg(
        F.count_if(F.col("_t") == "d").alias("document_count"),
        F.count_if(F.col("_t") == "c").alias("chunk_count"),
        F.count_if(F.col("_t") == "v").alias("vector_count"),
        F.count("_live").alias("live_vector_count"),
        F.max("_dim").cast("long").alias("index_dimension"))
    return agg.select("document_count", "chunk_count", "vector_count", "live_vector_count",
                      (F.col("vector_count") - F.col("live_vector_count")).alias("stale_vector_count"),
                      "index_dimension")
