"""Stored vectors dealt into blocks beforehand: what many searches score without moving a vector.

A block is one bucket of a bucketed Parquet table, sorted by vector id.  Its number ``vb`` is chosen so that the hash
Spark buckets by sends every block to a bucket of its own; queries sent to a block number therefore meet its vectors
where they lie, and a plan over the two needs no exchange of the vectors."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every query crosses a shuffle to every block, and each block returns its best of every query: few and large ones.
BLOCK_BYTES = 64 << 20
#: ``tag`` is 0, what follows ``v`` is null: the columns of the packed queries that a search puts beside them.
_COLUMNS = "vb INT, tag INT, id BIGINT, v ARRAY<FLOAT>, ids BINARY, pack BINARY, width INT, k INT"


@dataclass(frozen=True)
class Blocks:
    """``rows``: ``vb, tag, id, v, ids, pack, width, k``, bucketed by ``vb``; ``numbers``: the block numbers, one a bucket."""
    rows: DataFrame
    numbers: list[int]


def estimated_bytes(df: DataFrame) -> int | None:
    """The planner's size estimate, None where it has none.  It takes a join for the product of its sides; joined by their
    keys they hold no more than all that is read, which bounds the estimate."""
    plan = df._jdf.queryExecution().optimizedPlan()  # noqa: SLF001
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = min(int(str(plan.stats().sizeInBytes())), read)
    return size if size <= 1 << 60 else None


def block_numbers(spark: SparkSession, count: int) -> list[int]:
    """For each of ``count`` buckets the smallest number that Spark's hash puts there."""
    reach = 16 * count + 64
    while True:
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(count))
        got = {r.b: r.x for r in spark.range(reach).groupBy(bucket.alias("b")).agg(F.min("id").alias("x")).collect()}
        if len(got) == count:
            return [got[b] for b in range(count)]
        reach *= 2


def write_blocks(vectors: DataFrame, path: str, count: int | None = None, *, vec_id: str = "vector_index_id",
                 emb: str = "embedding", block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Deal ``vectors`` into ``count`` blocks (left out: by the planner's size estimate) under ``path``, in one shuffle."""
    spark = vectors.sparkSession
    if count is None:
        size = estimated_bytes(vectors)
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        count = usual if size is None else max(spark.sparkContext.defaultParallelism, math.ceil(size / block_bytes))
    numbers = block_numbers(spark, count)
    vid = F.col(vec_id).cast("long")
    place = F.element_at(F.array(*[F.lit(n) for n in numbers]), (F.pmod(F.xxhash64(vid), F.lit(count)) + 1).cast("int"))
    null = [F.lit(None).cast(kind).alias(name) for name, kind in (("ids", "binary"), ("pack", "binary"), ("width", "int"), ("k", "int"))]
    rows = vectors.select(place.alias("vb"), F.lit(0).alias("tag"), vid.alias("id"), F.col(emb).cast("array<float>").alias("v"), *null)
    name = f"blocks_{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/blocks={count}"
    (rows.repartition(count, "vb").write.format("parquet").bucketBy(count, "vb").sortBy("vb", "id")
     .option("path", folder).saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")   # the files stay
    return read_blocks(spark, path)


def read_blocks(spark: SparkSession, path: str) -> Blocks:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    names = [s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]  # noqa: SLF001
    count = int(next(n for n in names if n.startswith("blocks="))[7:])
    name = f"blocks_{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/blocks={count}"
    spark.sql(f"CREATE TABLE {name} ({_COLUMNS}) USING parquet CLUSTERED BY (vb) SORTED BY (vb, id) INTO {count} BUCKETS LOCATION '{folder}'")
    rows = spark.table(name)
    rows.schema   # resolved: the entry in the catalogue is not needed any more
    spark.sql(f"DROP TABLE {name}")
    return Blocks(rows, block_numbers(spark, count))
