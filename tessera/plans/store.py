"""The document store: append per batch, merge on read, deletes, reindex, compaction of touched buckets.

Layout: ``<root>/<table>/batch=<n>/bucket=<b>/`` with tables ``uploads`` (raw bytes), ``documents``, ``chunks``,
``embeddings`` (vector by vector id and model) and ``status``; the bucket is a hash of the document id.  A batch only adds
files, under a number of its own, and counts once its commit, written last, is in ``<root>/commits``: what a failed
job left is never read, and nothing is ever overwritten.  A commit may carry a key (for a stream: its checkpoint and
epoch); a batch whose key is committed already is not written again.

A document's latest batch in ``documents`` replaces all it had before: its chunks are those of that batch, so a
shorter version leaves no old chunk behind.  A delete appends tombstones (``deleted``).  A reindex appends embeddings; the
newest of each vector id counts.  Compaction writes the live rows of the buckets with dead ones as a new batch, from
which on those buckets are read; other buckets' files stay as they are.  One writer at a time: two that take the same
number fail at the commit.

Vector ids are dense: a chunk key that is stored keeps its id, new keys are numbered on from the largest id ever given
(the commits carry it), in the order of (md5 of the document id, document id, chunk index).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tessera.operators import chunking, embed, knn, tables
from tessera.plans.ingest import IngestResult, ingest
from tessera.session import ensure_checkpoint_dir, scratch_dir
from tessera.sources import files
from tessera.sources import tables as io

UPLOADS = Ty.StructType([
    Ty.StructField("document_id", Ty.StringType()), Ty.StructField("filename", Ty.StringType()),
    Ty.StructField("file_size", Ty.LongType()), Ty.StructField("upload_timestamp", Ty.TimestampNTZType()),
    Ty.StructField("content", Ty.BinaryType())])
STATUS = Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in ("document_id", "status", "reason")])
EMBEDDINGS = Ty.StructType([
    Ty.StructField("document_id", Ty.StringType()), Ty.StructField("vector_index_id", Ty.LongType()),
    Ty.StructField("of_batch", Ty.LongType()), Ty.StructField("model", Ty.StringType()),
    Ty.StructField("embedding", Ty.ArrayType(Ty.FloatType(), False))])
SCHEMAS = {
    "uploads": UPLOADS, "status": STATUS, "chunks": io.CHUNKS_SCHEMA, "embeddings": EMBEDDINGS,
    "documents": Ty.StructType([*io.DOCUMENTS_SCHEMA.fields, Ty.StructField("deleted", Ty.BooleanType())])}
BUCKETS = 16


# ---------------------------------------------------------------------------------- commits

@dataclass(frozen=True)
class Commit:
    batch: int
    kind: str        # append, delete, reindex or compact
    key: str         # md5 of the caller's key, or ''
    next_id: int     # the first vector id not given yet

    @property
    def name(self) -> str:
        return f"{self.batch:012d}-{self.kind}-{self.key}-{self.next_id}"


def _path(spark: SparkSession, *parts: str):
    where = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))  # noqa: SLF001
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001


def _names(spark: SparkSession, *parts: str) -> list[str]:
    """Names in a folder of the store (none holds a '/' or ', '), in as many calls to the JVM however many they are."""
    where, fs = _path(spark, *parts)
    if not fs.exists(where):
        return []
    listed = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(where))  # noqa: SLF001
    paths = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, len(listed))  # noqa: SLF001
    spark._jvm.java.lang.System.arraycopy(listed, 0, paths, 0, len(paths))  # noqa: SLF001
    head = f"{fs.makeQualified(where).toString()}/"
    return sorted(p.removesuffix(", ") for p in spark._jvm.java.util.Arrays.toString(paths)[1:-1].split(head)[1:])  # noqa: SLF001


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """The committed batches in order; only names are listed."""
    parts = [n.split("-") for n in _names(spark, root, "commits")]
    return [Commit(int(n), kind, key, int(nxt)) for n, kind, key, nxt in parts]


def _commit(spark: SparkSession, root: str, number: int, kind: str, key: str | None, next_id: int) -> int:
    done = commits(spark, root)
    mine = Commit(number, kind, _digest(key), next_id)
    where, fs = _path(spark, root, "commits", mine.name)
    if any(c.batch >= number for c in done) or not fs.createNewFile(where):
        raise RuntimeError(f"batch {number} of {root} was committed by another writer")
    return number


def _digest(key: str | None) -> str:
    return hashlib.md5(key.encode()).hexdigest() if key else ""


def _committed(spark: SparkSession, root: str, key: str | None, done: list[Commit] | None = None) -> int | None:
    found = [c.batch for c in (commits(spark, root) if done is None else done) if key and c.key == _digest(key)]
    return found[0] if found else None


def _batches(spark: SparkSession, root: str, table: str) -> list[int]:
    return [int(n[6:]) for n in _names(spark, root, table) if n.startswith("batch=")]


def _next_batch(spark: SparkSession, root: str, done: list[Commit] | None = None) -> int:
    """A number that no batch has, finished or not."""
    used = [c.batch for c in (commits(spark, root) if done is None else done)] + [n for t in SCHEMAS for n in _batches(spark, root, t)]
    return 1 + max([-1, *used])


def _next_id(spark: SparkSession, root: str) -> int:
    return max([0, *(c.next_id for c in commits(spark, root))])


def bucket_count(spark: SparkSession, root: str) -> int:
    """How many buckets the store was made with."""
    names = _names(spark, root, "layout")
    return int(names[0].split("=")[1]) if names else BUCKETS


def _make(spark: SparkSession, root: str, buckets: int | None) -> int:
    names = _names(spark, root, "layout")
    if not names:
        where, fs = _path(spark, root, "layout", f"buckets={buckets or BUCKETS}")
        fs.createNewFile(where)
    elif buckets and names != [f"buckets={buckets}"]:
        raise ValueError(f"the store at {root} has {names[0]}")
    return int(names[0].split("=")[1]) if names else buckets or BUCKETS


def _compacted(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """Batch -> buckets that begin with it, for the last compaction of each bucket."""
    since: dict[int, int] = {}
    for c in commits(spark, root):
        if c.kind == "compact":
            since |= {int(b): c.batch for b in _names(spark, root, "compactions", str(c.batch))}
    return {n: sorted(b for b, m in since.items() if m == n) for n in sorted(set(since.values()))}


# ---------------------------------------------------------------------------------- rows

def bucket_of(document_id: str | Column, buckets: int) -> Column:
    """Ranges of the id's md5, the order in which vector ids are given: the ids of a batch's bucket follow each other."""
    return F.floor(F.conv(F.substring(F.md5(document_id), 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int")


def _log(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Every committed row of a table that no compaction replaced, with its ``batch`` and ``bucket``."""
    base = f"{root.rstrip('/')}/{table}"
    schema = Ty.StructType([*SCHEMAS[table].fields, Ty.StructField("batch", Ty.LongType()), Ty.StructField("bucket", Ty.IntegerType())])
    done = {c.batch for c in commits(spark, root)}
    batches = [n for n in _batches(spark, root, table) if n in done]
    if not batches:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/batch={n}" for n in batches])
    for batch, buckets in _compacted(spark, root).items():   # on partition columns: prunes folders
        rows = rows.where(~(F.col("bucket").isin(buckets) & (F.col("batch") < batch)))
    return rows


def _write(df: DataFrame, root: str, table: str, batch: int) -> None:
    """A column ``_deal`` bears, beside its name, the store's buckets and into how many tasks they are dealt."""
    spark = df.sparkSession
    out = df.select(*[F.col(f.name) if f.name == "embedding" else F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])
    deal = df.schema["_deal"].metadata if "_deal" in df.columns else {}
    tasks, buckets = deal.get("tasks"), deal.get("buckets") or bucket_count(spark, root)
    out = out.withColumn("bucket", bucket_of("document_id", buckets))
    order = ["bucket", *(c for c in ("vector_index_id",) if c in out.columns)]   # clustered: a filter on ids skips row groups
    dealt = out.repartitionById(tasks, F.floor(F.col("bucket") * tasks / buckets).cast("int")) if tasks else out.repartition("bucket")
    rows, folder = dealt.sortWithinPartitions(*order), f"{root.rstrip('/')}/{table}/batch={batch}"
    # Tasks move their files into place themselves: nobody reads a batch before its commit, so none is seen half written.
    if not (tasks and files.write_parquet(rows, folder, "bucket")):
        writer = rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.mode("errorifexists").partitionBy("bucket").parquet(folder)


def _together(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Run writes that don't depend on each other at the same time; the first one's error is raised when all have ended.  A small
    batch's writes wait for their files' making more than for cores."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]:
            done.result()


@contextmanager
def _as_planned(spark: SparkSession) -> Iterator[None]:
    """Plans that deal their rows into a stated number of tasks and join nothing leave nothing to adapt: their stages run as one job."""
    name = "spark.sql.adaptive.enabled"
    held = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def _latest(spark: SparkSession, root: str) -> DataFrame:
    """``document_id, batch`` of the documents that are not deleted."""
    log = _log(spark, root, "documents").select("document_id", "batch", "deleted")
    return (log.groupBy("document_id").agg(F.max("batch").alias("batch"), F.max_by("deleted", "batch").alias("deleted"))
            .where("NOT deleted").drop("deleted"))


def _live(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The log's rows of the documents' latest batches."""
    return _log(spark, root, table).join(_latest(spark, root), ["document_id", "batch"], "left_semi")


def _live_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """The newest embedding of every live vector id."""
    rows = _log(spark, root, "embeddings").join(
        _latest(spark, root).withColumnRenamed("batch", "of_batch"), ["document_id", "of_batch"], "left_semi")
    if any(c.kind == "reindex" for c in commits(spark, root)):
        newest = rows.groupBy("vector_index_id").agg(F.max("batch").alias("batch"))   # ids only; vectors stay where they are
        rows = rows.join(newest, ["vector_index_id", "batch"], "left_semi")
    return rows


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    return _live(spark, root, "documents").select(*io.DOCUMENTS_SCHEMA.names)


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Live chunk rows with their vector ids: what hits are joined to."""
    return _live(spark, root, "chunks").select(*io.CHUNKS_SCHEMA.names)


def read_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """``vector_index_id, document_id, model, embedding`` of the live chunks: what a search scores; reads no text."""
    return _live_embeddings(spark, root).select("vector_index_id", "document_id", "model", "embedding")


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Live chunk rows with their vectors and ids."""
    vectors = read_embeddings(spark, root).select("vector_index_id", "embedding")
    return read_chunks(spark, root).join(vectors, "vector_index_id").select(*io.VECTORS_SCHEMA.names)


def read_uploads(spark: SparkSession, root: str) -> DataFrame:
    return _live(spark, root, "uploads").select(*UPLOADS.names)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``document_id, n_versions``: how many batches since the last compaction ingested each document."""
    log = _log(spark, root, "documents").where("NOT deleted")
    return log.groupBy("document_id").agg(F.count_distinct("batch").cast("int").alias("n_versions"))


def read_status(spark: SparkSession, root: str) -> DataFrame:
    """The latest status of every upload, rejected and failed ones too."""
    return tables.latest_per_key(_log(spark, root, "status"), ["document_id"], "batch").select(*STATUS.names)


def search(spark: SparkSession, root: str, queries: DataFrame, *, limit: int = 10, threshold: float = 0.5,
           vector_dim: int | None = None) -> DataFrame:
    """``semantic_search`` over the store.  Scoring reads ids and vectors; the hits, queries x 2 x limit ids and scores at most,
    are written down, and only the row groups of chunks that may hold one of them are read for their text."""
    vectors = read_embeddings(spark, root).select("vector_index_id", "embedding")
    hits = knn.knn(queries, vectors, 2 * limit, vector_dim=vector_dim).where(F.col("score") >= F.lit(threshold))
    path = scratch_dir(spark, "hits")
    hits.write.parquet(path)
    hits = spark.read.schema(hits.schema).parquet(path)
    chunks = read_chunks(spark, root).where(tables.id_ranges(hits, "vector_index_id"))
    return knn.first_hits(hits.join(chunks, "vector_index_id"), F.lit(limit))


# ---------------------------------------------------------------------------------- appends

def duplicate_ids(uploads: DataFrame) -> DataFrame:
    """Ids that more than one upload of a batch bears (a thin pass; contents are not read)."""
    return uploads.groupBy("document_id").count().where("count > 1")


def _one_per_id(uploads: DataFrame) -> DataFrame:
    """The latest upload of each id (upload time, then file name, then size)."""
    order = F.struct("upload_timestamp", "filename", "file_size")
    return uploads.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy(order.desc()))).where("_n = 1").drop("_n")


def number_chunks(chunks: DataFrame, stored: DataFrame, first_id: int) -> DataFrame:
    """``chunks`` with ``vector_index_id``: a stored (document, chunk index) keeps its id, the others are
    numbered from ``first_id`` in the order of (md5 of the document id, document id, chunk index).

    Only counts per document are ordered: ranges of md5 prefixes are summed, a window over the
    (4,096 at most) ranges and one inside each range give every document's first number."""
    old = stored.select("document_id", "chunk_index", F.col("vector_index_id").alias("_old"))
    known = chunks.join(old, ["document_id", "chunk_index"], "left")
    fresh = known.where("_old IS NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    ensure_checkpoint_dir(chunks.sparkSession)
    # Keys and counts only; the numbering must not change if a task runs again.  New names: a stream's batch lends its own.
    fresh = fresh.checkpoint().toDF("document_id", "n")
    fresh = fresh.withColumn("m", F.md5("document_id")).withColumn("range", F.substring("m", 1, 3))
    ranges = fresh.groupBy("range").agg(F.sum("n").alias("rn"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("head"))
    inside = Window.partitionBy("range").orderBy("m", "document_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (fresh.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ranges, "range")
               .select("document_id", (F.col("head") + F.col("at")).alias("_off")))
    pos = Window.partitionBy("document_id").orderBy(F.col("_old").isNotNull(), "chunk_index")
    numbered = known.join(offsets, "document_id", "left").withColumn("_k", F.row_number().over(pos) - 1)
    new_id = F.lit(first_id).cast("long") + F.col("_off") + F.col("_k")
    return numbered.withColumn("vector_index_id", F.coalesce("_old", new_id)).drop("_old", "_off", "_k")


_RANGES = 4096          # of md5 prefixes: what the driver gets of a batch is a row for each at most
_IDS_OF_RANGE = 64      # hashes of ids in such a row; of a batch with more the driver knows none
_TASK_BYTES = 4 << 20   # of text for a task that writes


@dataclass(frozen=True)
class Counts:
    heads: list[int]             # by range, chunks of the batch before it (in the order of vector ids)
    total: int                   # vector ids that a batch takes whose documents are all new
    repeated: bool               # two uploads may share an id
    ids: np.ndarray | None       # hashes of the ids, None for a large batch
    tasks: int                   # that write a table


def _counts(res: IngestResult) -> Counts:
    """What the driver has to know of a batch: one pass, which fills the persisted text too."""
    n = F.when(F.col("reason").isNull() & F.col("error").isNull(), chunking.chunk_count("word_count")).otherwise(F.lit(0))
    rows = res.extracted.select("document_id", n.alias("n"), F.xxhash64("document_id").alias("h"), F.octet_length("text").alias("b"))
    hashes = F.collect_list("h")
    got = rows.groupBy(_range_of("document_id").alias("range")).agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("rows"), F.slice(hashes, 1, _IDS_OF_RANGE).alias("ids"),
        (F.size(F.array_distinct(hashes)) < F.size(hashes)).alias("repeated")).collect()
    sums = np.zeros(_RANGES + 1, np.int64)   # no id comes first, as NULL does
    for r in got:
        sums[0 if r.range is None else r.range + 1] = r.n
    few = all(r.rows <= _IDS_OF_RANGE for r in got)
    ids = np.array([h for r in got for h in r.ids], np.int64) if few else None
    tasks = max(4, -(-sum(r.b or 0 for r in got) // _TASK_BYTES))
    return Counts(np.cumsum(sums)[:-1].tolist(), int(sums.sum()) if sums[1:].any() else 0, any(r.repeated for r in got), ids, tasks)


def _range_of(document_id: str) -> Column:
    return F.conv(F.substring(F.md5(document_id), 1, 3), 16, 10).cast("int")


def _numbered(accepted: DataFrame, counts: Counts, first_id: int, batch: int) -> DataFrame:
    """The chunks of new documents, with their ``batch`` and the ids that ``number_chunks`` gives them: texts are dealt by range,
    and a window inside each range goes on from the range's head.  What differs from batch to batch comes out of one array, which
    compiled code refers to: as numbers in that code they would have it compiled for every micro-batch.  Plans and their
    descriptions bear it, so few tasks have fewer, wider ranges."""
    width = 16 if counts.tasks <= 16 else 1
    given = F.from_json(F.lit(json.dumps([first_id + n for n in counts.heads[::width]] + [batch])), "array<bigint>")
    docs = accepted.select("document_id", "text", chunking.chunk_count("word_count").alias("_n"), F.md5("document_id").alias("_m"),
                           F.floor(_range_of("document_id") / width).cast("int").alias("_range"))
    docs = docs.repartition(min(_RANGES, counts.tasks), "_range")
    inside = Window.partitionBy("_range").orderBy("_m", "document_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_off", F.element_at(given, F.col("_range") + 1) + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    chunks = chunking.chunk_text(docs, keep=("_off",))
    return chunks.withColumns({"vector_index_id": F.col("_off") + F.col("chunk_index"),
                               "batch": F.element_at(given, F.col("chunk_index") * 0 - 1)}).drop("_off")


class KnownIds:
    """A Bloom filter over the ids of a store's documents, held by the driver while a stream appends to it: it can tell that no id
    of a batch is stored, so that the batch need not read what all earlier ones wrote.  16 MB whatever the store's size: with
    more ids it errs more often, to the safe side (the batch looks them up).  A batch of another writer has it made anew."""

    BITS, PROBES, LOADED = 1 << 27, 7, 1 << 20   # LOADED: ids of a store that it is made from; with more it rules out none

    def __init__(self):
        self.bits, self.seen = np.zeros(self.BITS // 8, np.uint8), []

    def _places(self, ids: np.ndarray) -> np.ndarray:
        h = ids.astype(np.int64).view(np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(self.PROBES, dtype=np.uint64)) % np.uint64(self.BITS)

    def _set(self, ids: np.ndarray | None) -> None:
        if ids is None:
            self.bits = None
        elif self.bits is not None:
            at = self._places(ids).ravel()
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, spark: SparkSession, root: str, done: list[Commit], ids: np.ndarray | None) -> bool:
        """Whether a document of the batches ``done`` may bear one of the ids (hashes)."""
        if self.seen != [c.name for c in done]:
            stored = _log(spark, root, "documents").select(F.xxhash64("document_id").alias("h")).limit(self.LOADED + 1).toArrow()["h"]
            self.bits, self.seen = np.zeros(self.BITS // 8, np.uint8), [c.name for c in done]
            self._set(stored.to_numpy().astype(np.int64) if len(stored) <= self.LOADED else None)
        if ids is None or self.bits is None:
            return True
        at = self._places(ids)
        return bool(((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1).any())

    def add(self, done: list[Commit], mine: Commit, ids: np.ndarray | None) -> None:
        """The batch committed after ``done`` has documents of these ids."""
        if self.seen == [c.name for c in done]:   # else it is made anew
            self._set(ids)
            self.seen = [*self.seen, mine.name]


def _embedded(chunks: DataFrame, embedder) -> DataFrame:
    """Rows of the table ``embeddings`` for chunk rows with their ``batch``."""
    backend = embedder or embed.HashingEmbedder()
    rows = embed.embed_chunks(chunks, backend).withColumns({"of_batch": F.col("batch"), "model": F.lit(embed.model_name(backend))})
    return sound_vectors(rows, backend.dim)


def append_batch(uploads: DataFrame, root: str, *, key: str | None = None, buckets: int | None = None, keep_uploads: bool = True,
                 embedder=None, pdf_extractor=None, on_duplicates: str = "fail", known: KnownIds | None = None) -> int:
    """Ingest a batch of uploads and append it to the store; returns the batch number.

    With a ``key`` the batch is written at most once: a second call with it returns the first one's number.
    ``buckets``: for a new store, how many buckets of documents it has (compaction rewrites whole buckets).

    Ids must be unique in a batch: ``on_duplicates="fail"`` raises before anything is written and names
    some, ``"latest"`` keeps the latest upload of each id.  Ingesting the same uploads again leaves the
    documents, chunks and vector ids as they are.

    A batch none of whose ids can be stored (the store is empty, or a stream's ``known`` ids rule it out) is numbered and
    embedded without a look at the store, all its tables at the same time."""
    spark = uploads.sparkSession
    done = commits(spark, root)
    mine = _committed(spark, root, key, done)
    if mine is not None:
        return mine
    options = {"embedder": embedder, "pdf_extractor": pdf_extractor, "persist": True, "keep_uploads": keep_uploads}
    res = ingest(uploads, **options)
    try:
        with ThreadPoolExecutor(1) as beside:   # the driver plans while the executors count
            counting = beside.submit(inheritable_thread_target(spark)(_counts), res)
            number, first = _next_batch(spark, root, done), max([0, *(c.next_id for c in done)])
            counts = counting.result()
        if counts.repeated and (twice := [r.document_id for r in duplicate_ids(res.extracted).limit(5).collect()]):
            if on_duplicates == "fail":
                raise ValueError(f"several uploads share a document_id: {twice}")
            res.release()
            res = ingest(_one_per_id(uploads), **options)
            counts = _counts(res)
        made = _make(spark, root, buckets)
        old = bool(done) and (known is None or known.may_hold(spark, root, done, counts.ids))
        dealt = F.lit(None).cast("int").alias("_deal", metadata={"buckets": made, "tasks": min(made, counts.tasks)})
        # planned by the thread that writes it
        write = lambda rows, table: lambda: _write(rows().select("*", dealt), root, table, number)
        writes = [write(lambda: res.documents.withColumn("deleted", F.lit(False)), "documents"), write(lambda: res.status, "status")]
        if keep_uploads:   # a row without an id is no document that anything could find
            writes.append(write(lambda: res.accepted.where("document_id IS NOT NULL").withColumn("content", F.col("upload")), "uploads"))
        if old:
            last = _log(spark, root, "documents").groupBy("document_id").agg(F.max("batch").alias("batch"))
            stored = _log(spark, root, "chunks").join(last, ["document_id", "batch"], "left_semi")

            def parts() -> None:
                write(lambda: number_chunks(res.chunks, stored, first), "chunks")()
                write(lambda: _embedded(_chunks_of(spark, root, number), embedder), "embeddings")()
            writes.insert(0, parts)
            _together(spark, *writes)
        else:
            chunks = lambda: _numbered(res.accepted, counts, first, number)
            with _as_planned(spark):
                _together(spark, write(lambda: _embedded(chunks(), embedder), "embeddings"), write(chunks, "chunks"), *writes)
    finally:
        res.release()
    if old:
        given = _chunks_of(spark, root, number).agg(F.max("vector_index_id")).first()[0]
        after = first if given is None else max(first, given + 1)
    else:
        after = first + counts.total
    _commit(spark, root, number, "append", key, after)
    if known is not None:
        known.add(done, Commit(number, "append", _digest(key), after), counts.ids)
    return number


def _chunks_of(spark: SparkSession, root: str, number: int) -> DataFrame:
    """The chunk rows of a batch as written, with its ``batch``."""
    rows = spark.read.schema(io.CHUNKS_SCHEMA).parquet(f"{root.rstrip('/')}/chunks/batch={number}")
    return rows.withColumn("batch", F.lit(number).cast("long"))


def sound_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Fail the write on a vector that is NULL, of another width than ``dim`` or not finite throughout: such
    a row could never be found, or would break a search later."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = F.coalesce((F.size("embedding") == dim) & finite, F.lit(False))
    message = F.concat(F.lit("unusable vector of chunk "), F.coalesce("chunk_id", F.lit("NULL")))
    return vectors.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(message).cast("array<float>")))


# ---------------------------------------------------------------------------------- changes

def delete(spark: SparkSession, root: str, ids: DataFrame, key: str | None = None) -> int:
    """Delete documents with their chunks and raw uploads: appends a tombstone for each stored id of
    ``ids(document_id)``.  ``tables.delete_status`` over the tables before tells what was found."""
    done = _committed(spark, root, key)
    if done is not None:
        return done
    number = _next_batch(spark, root)
    gone = read_documents(spark, root).join(ids.select("document_id"), "document_id", "left_semi")
    _write(gone.withColumn("deleted", F.lit(True)), root, "documents", number)
    told = gone.select("document_id", F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("reason"))
    _write(told, root, "status", number)
    return _commit(spark, root, number, "delete", key, _next_id(spark, root))


def reindex(spark: SparkSession, root: str, document_ids=None, embedder=None, key: str | None = None) -> int:
    """Embed the live chunks of all documents, or of ``document_ids`` (a DataFrame or a list), anew.  Only the table
    ``embeddings`` grows; the new vectors count as soon as the batch is committed, all at once."""
    done = _committed(spark, root, key)
    if done is not None:
        return done
    chunks = _live(spark, root, "chunks")
    if document_ids is not None:
        chunks = tables.restrict_to_ids(chunks, document_ids)
    number = _next_batch(spark, root)
    _write(_embedded(chunks, embedder), root, "embeddings", number)
    return _commit(spark, root, number, "reindex", key, _next_id(spark, root))


def dead_buckets(spark: SparkSession, root: str) -> list[int]:
    """Buckets that hold deleted, replaced or outdated rows; at most as many as the store has."""
    documents = _log(spark, root, "documents").join(_latest(spark, root), ["document_id", "batch"], "left_anti").select("bucket")
    live = _live_embeddings(spark, root).select("vector_index_id", "batch")
    vectors = _log(spark, root, "embeddings").join(live, ["vector_index_id", "batch"], "left_anti").select("bucket")
    return sorted(r.bucket for r in documents.unionByName(vectors).distinct().collect())


def compact(spark: SparkSession, root: str) -> int | None:
    """Write the live rows of the buckets with dead ones as a new batch; readers begin those buckets with it once it is
    committed, and the other buckets' files stay.  Vector ids stay as they are.  None if there is nothing to do."""
    touched = dead_buckets(spark, root)
    if not touched:
        return None
    number = _next_batch(spark, root)
    here = F.col("bucket").isin(touched)
    for table in ("uploads", "chunks", "documents"):
        _write(_live(spark, root, table).where(here), root, table, number)
    _write(_live_embeddings(spark, root).where(here).withColumn("of_batch", F.lit(number)), root, "embeddings", number)
    _write(tables.latest_per_key(_log(spark, root, "status").where(here), ["document_id"], "batch"), root, "status", number)
    for b in touched:
        where, fs = _path(spark, root, "compactions", str(number), str(b))
        fs.createNewFile(where)
    return _commit(spark, root, number, "compact", None, _next_id(spark, root))


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove the folders that compactions replaced and those of batches that failed; returns how many.  Not while older
    readers or a writer are at work."""
    done = commits(spark, root)
    if not done:
        return 0
    numbers, since, n = {c.batch for c in done}, {}, 0
    for batch, buckets in _compacted(spark, root).items():
        since |= dict.fromkeys(buckets, batch)
    for table in SCHEMAS:
        for batch in _batches(spark, root, table):
            names = _names(spark, root, table, f"batch={batch}")
            old = [b for b in names if b.startswith("bucket=") and batch < since.get(int(b[7:]), 0)] if batch in numbers else [""]
            for name in old if batch <= done[-1].batch else []:
                where, fs = _path(spark, root, table, f"batch={batch}", *([name] if name else []))
                n += fs.delete(where, True)
    return n


# ---------------------------------------------------------------------------------- keys

def _repeated(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Keys that more than one row bears: counted by a hash of the key first, exactly where the hash is met twice."""
    hashed = rows.select(F.col(key).cast("string").alias("key")).withColumn("h", F.xxhash64("key"))
    twice = hashed.groupBy("h").count().where("count > 1").select("h")
    exact = hashed.join(twice, "h", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    return exact.select(F.lit(name).alias("problem"), "key", "n_rows")


def key_report(spark: SparkSession, root: str) -> DataFrame:
    """``problem, key, n_rows`` for every key of the live tables that is not unique (documents, chunks, vector ids,
    embeddings), every stored chunk of a document never stored and every live embedding without its chunk.  A sound
    store has no rows here."""
    documents = _log(spark, root, "documents")
    lost = _log(spark, root, "chunks").join(documents.select("document_id"), "document_id", "left_anti")
    chunks = _live(spark, root, "chunks").unionByName(lost)
    return key_problems(_live(spark, root, "documents"), chunks, _live_embeddings(spark, root))


def key_problems(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The report over given tables."""
    orphan = tables.orphan_chunks(chunks, documents).groupBy(F.col("chunk_id").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    bare = (vectors.join(chunks.select("vector_index_id"), "vector_index_id", "left_anti")
            .groupBy(F.col("vector_index_id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n_rows")))
    parts = [_repeated(documents, "document_id", "document_id"), _repeated(chunks, "chunk_id", "chunk_id"),
             _repeated(chunks, "vector_index_id", "vector_index_id"), _repeated(vectors, "vector_index_id", "embedding"),
             orphan.select(F.lit("chunk without document").alias("problem"), "key", "n_rows"),
             bare.select(F.lit("embedding without chunk").alias("problem"), "key", "n_rows")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
