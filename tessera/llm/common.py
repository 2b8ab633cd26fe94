"""Helpers shared by the operators: row ids, written tables, equal-key groups, components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_dir

MAX_LONG = 2**63 - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (names compare without case in Spark)."""
    used = {c.lower() for c in df.columns}
    while base in used:
        base += "_"
    return base


def with_row_id(df: DataFrame, base: str = "row_id") -> tuple[DataFrame, str]:
    """``df`` with a unique long per row, and that column's name, for a single pass over ``df``: the ids
    depend on how a scan is split, so a plan that reads ``df`` twice takes ``numbered``."""
    name = free_name(df, base)
    return df.withColumn(name, F.monotonically_increasing_id()), name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``with_row_id`` written and read again: the ids are data then, the same for every later pass even if
    the cluster changes in between and scans are split another way."""
    rows, row_id = with_row_id(df)
    return materialise(rows, name), row_id


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (see ``scratch_dir``) and read it back: cuts the
    lineage so that lost executors cost no recomputation.  The folder goes when the application ends, or
    with the innermost ``recorded`` block's list (``keep``: with that of the block around it)."""
    path = scratch_dir(df.sparkSession, name)
    recorders = _recorders.get()[:-1] if keep else _recorders.get()
    if recorders:
        recorders[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()  # noqa: SLF001
    _written[path] = df.sparkSession._jvm.java.lang.ref.WeakReference(files)  # noqa: SLF001
    return out


#: The written tables, each with a weak reference to the listing of its files that every plan over it holds.
_written: dict = {}


def delete_unused_tables(spark: SparkSession) -> None:
    """Remove the written tables that no DataFrame and no running query reads any more, as Spark's own cleaner
    does with shuffle files: their listing has been collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()  # noqa: SLF001
    app = scratch_dir(spark, "").rsplit("/", 1)[0]
    gone = [path for path, files in list(_written.items()) if path.startswith(app) and files.get() is None]
    delete_tables(spark, gone)


#: The lists that written tables are added to, of this thread or task.
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables written meanwhile, for ``delete_tables``."""
    paths: list[str] = []
    before = _recorders.set((*_recorders.get(), paths))
    try:
        yield paths
    finally:
        _recorders.reset(before)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables that nothing reads any more."""
    jvm = spark._jvm  # noqa: SLF001
    for path in paths:
        _written.pop(path, None)
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def equal_groups(df: DataFrame, keys: list[str], row_id: str, doc_id: str, salts: int = 64) -> DataFrame:
    """``df`` with ``keep_row``, ``keep_id`` and ``group_size`` of the rows that share ``keys``.

    The kept row has the smallest ``doc_id`` (nulls last, ties: any one row).  Rows are first summed
    per key and salt, then per key, and come back through (key, salt), so a key that holds a
    third of all rows is spread over ``salts`` tasks at every step."""
    order = F.coalesce(F.col(doc_id), F.lit(MAX_LONG))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(
        F.min_by(F.col(row_id), order).alias("_row"), F.min(order).alias("_ord"), F.count(F.lit(1)).alias("_n"))
    total = part.groupBy(*keys).agg(
        F.min_by("_row", "_ord").alias("keep_row"), F.min("_ord").alias("_min"), F.sum("_n").alias("group_size"))
    back = part.select(*keys, "_salt").join(total, keys)
    keep_id = F.when(F.col("_min") < MAX_LONG, F.col("_min"))
    return salted.join(back, [*keys, "_salt"]).withColumn("keep_id", keep_id).drop("_salt", "_min")


def least_mates(edges: DataFrame) -> DataFrame:
    """Links ``(a, b)`` with the same components as ``edges(a, b)``: each ``a`` keeps its least mate, and its other
    mates link with that one.  Rows that name the same few mates, each again and again, leave one link a
    row and a few between the mates."""
    mates = edges.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("mates"))
    first = mates.select("a", F.col("least").alias("b"))
    others = mates.select(F.explode(F.array_remove("mates", F.col("least"))).alias("a"), F.col("least").alias("b"))
    return first.unionByName(others.distinct())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component = smallest node reached.

    Minimum labels spread over the links, and each round also jumps to the label's own label, so
    the rounds grow with the logarithm of the longest path.  Every round is a written table; joins
    have plain shuffles on both sides, so AQE can split a hub's links over several tasks."""
    both = least_mates(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"))
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "component")
        spread = seen.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        spread = materialise(spread, f"{name}-{step}a")
        own = spread.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        nxt = spread.join(own, "component").select("node", F.col("_up").alias("component"))
        nxt = materialise(nxt, f"{name}-{step}")
        # Sums of labels fall until nothing changes; DECIMAL keeps them exact.
        total = lambda t: t.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total(nxt) == total(labels):
            return nxt
        labels = nxt


def block_pairs(members: DataFrame, group: str, row: str, size: Column, block_rows: int) -> DataFrame:
    """Deal the rows of each group into blocks of about ``block_rows`` and send each row to every
    pair of blocks it belongs to: columns ``bi <= bj`` (the pair) and ``side`` (0: of ``bi``, 1: of
    ``bj``).  A group of one block is one task's work, a group of b blocks b (b + 1) / 2 tasks' work,
    each over at most two blocks."""
    n = F.greatest(F.lit(1), F.ceil(size / F.lit(block_rows))).cast("int")
    out = members.withColumn("_nb", n).withColumn("_own", F.pmod(F.xxhash64(row, F.lit(7)), F.col("_nb")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return (out.withColumn("bi", F.least("_own", "_other")).withColumn("bj", F.greatest("_own", "_other"))
            .withColumn("side", F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1)).drop("_nb", "_own", "_other"))


def per_batch(fn: Callable[[pd.DataFrame], pd.DataFrame], rows: int = 512):
    """A ``mapInPandas`` function that applies ``fn`` to slices of at most ``rows`` rows, so that what
    ``fn`` builds stays small beside the Arrow batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), rows):
                yield fn(b.iloc[i:i + rows])
    return run


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of ``n`` nodes joined by links ``a[i] - b[i]``."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return lab


def whole_groups(keys: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]):
    """A ``mapInPandas`` function for partitions sorted by ``keys``: calls ``fn(rows, starts)`` with whole groups
    only (``starts``: where each begins, and the end).  One call serves many small groups; a group that
    runs over several Arrow batches is held until it ends."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            first = held[0][keys].iloc[0] if held else b[keys].iloc[0]
            if (b[keys].iloc[-1] == first).all():  # still the same group
                held.append(b)
                continue
            rows = pd.concat([*held, b], ignore_index=True)
            starts = _starts(rows, keys)
            cut = starts[-1]
            yield fn(rows.iloc[:cut], starts)
            held = [rows.iloc[cut:]]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield fn(rows, np.append(_starts(rows, keys), len(rows)))
    return run


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in keys:
        v = rows[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pairs_within(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ``i < j`` of the same group, for groups that begin at ``starts[:-1]``."""
    size = np.diff(starts)
    ends = np.repeat(starts[1:], size)
    i = np.arange(starts[0], starts[-1])
    after = ends - i - 1
    a = np.repeat(i, after)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
    return a, b
