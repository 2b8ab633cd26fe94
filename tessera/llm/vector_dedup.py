"""Operator 4: embedding near-duplicates by cross-polytope hashing.

Vectors link when their labels are equal and not null and their cosine, in double precision, is at
least ``threshold``.

1. Equal vectors of one label become one representative.
2. A hash is the nearest signed axis after three rounds of random signs and a fast Hadamard transform; a
   table's key joins some of them with the label and the width.  Multiprobe: every vector stands in its own
   bucket and in the next likeliest ones (second-nearest axes by margin) of each table; ``parameters_for``
   sets the counts.
3. Buckets are counted; those with one vector drop out, large ones are dealt over pairs of blocks.
4. Inside a bucket all cosines are computed.  A linked pair counts in the smallest key the two
   share, so it counts once though it meets in several buckets.  A task returns one row a vector (count,
   smallest vector it hangs with).
5. Connected components over these give the groups.

Recall is measured in tests against all pairs (at least 0.99 of links at the default parameters).

Defined cases: a vector that is null, empty, all zero or holds a null or non-finite part, or has a null
label, links with nothing and is kept; widths may differ (different widths never link); null vec_ids
come last when a component picks its smallest; repeated rows link with each other; empty tables work; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

THRESHOLD = 0.98
BLOCK_ROWS = 256
_U = np.uint64


def parameters_for(rows: int, axes: int, bucket: int = 64) -> tuple[int, int, int]:
    """(tables, hashes a key, probes a table) for a corpus of ``rows`` vectors of ``axes`` parts: as many hashes as keep an
    average bucket under ``bucket`` vectors, and tables for a recall over 0.999 at cosine 0.98 (tests plant
    pairs for each number of hashes).  The settings change what is compared, not what links."""
    axes = max(2, 1 << max(0, axes - 1).bit_length())
    hashes = max(2, int(np.ceil(np.log(max(1, rows / bucket)) / np.log(2 * axes))))
    return (6, 2, 3) if hashes == 2 else (4 * hashes, hashes, hashes + 1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (width a power of two), scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def probe_keys(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, tables * probes) bucket numbers of unit vectors: per table the own bucket, then the buckets
    in which one hash takes its second axis, by rising margin."""
    n, width = x.shape
    padded = 1 << max(1, (width - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, padded - width)))
    rows, out = np.arange(n), []
    for t in range(tables):
        axis, other, margin = [], [], []
        for k in range(hashes):
            rng = np.random.default_rng([4, t, k, padded])
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], padded))
            size = np.abs(y)
            top = np.argpartition(-size, 1, 1)[:, :2]
            swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
            top[swap] = top[swap, ::-1]
            a, b = top[:, 0], top[:, 1]
            axis.append(2 * a + (y[rows, a] < 0))
            other.append(2 * b + (y[rows, b] < 0))
            margin.append(size[rows, a] - size[rows, b])
        axis, other, margin = np.stack(axis, 1), np.stack(other, 1), np.stack(margin, 1)
        rank = np.argsort(margin, 1, kind="stable")
        for p in range(probes):
            pick = axis.copy()
            if p:
                k = rank[:, (p - 1) % hashes]
                pick[rows, k] = other[rows, k]
            number = np.full(n, t, np.int64)
            for k in range(hashes):
                number = number * (2 * padded) + pick[:, k]
            out.append(number)
    return np.stack(out, 1)


def _usable(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    a = np.asarray(v)
    if a.dtype == object and any(x is None for x in a):
        return None
    a = a.astype(np.float64)
    top = np.abs(a).max()
    if not 0 < top < np.inf:   # zero, or a part that is no finite number
        return None
    # A power of two brings the largest part near 1: cosines stay as they are and squares neither over- nor underflow.
    return np.ldexp(np.ldexp(a, -int(np.frexp(top)[1]) // 2), -int(np.frexp(top)[1]) + int(np.frexp(top)[1]) // 2)


def hashed(vectors: DataFrame, row_id: str, tables: int, hashes: int, probes: int) -> DataFrame:
    """``row_id, vec_id, tag, vector, same_key, keys``: tag is label and width; vector null if it cannot link."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        got = [_usable(v) if lab is not None and lab == lab else None for v, lab in zip(part["embedding"], part["label"], strict=True)]
        keys: list = [[] for _ in got]
        for width in {len(a) for a in got if a is not None}:
            at = [i for i, a in enumerate(got) if a is not None and len(a) == width]
            x = np.stack([got[i] for i in at])
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            for i, numbers in zip(at, probe_keys(x, tables, hashes, probes), strict=True):
                tag = f"{part['label'].iloc[i]}/{width}/".encode()
                keys[i] = [int.from_bytes(hashlib.blake2b(tag + m.tobytes(), digest_size=8).digest(), "little", signed=True)
                           for m in np.unique(numbers)]
        return pd.DataFrame({
            "row_id": part["row_id"], "vec_id": part["vec_id"], "tag": [None if a is None else f"{lab}/{len(a)}" for a, lab in zip(got, part["label"], strict=True)],
            "vector": [None if a is None else a.tobytes() for a in got],
            "same_key": [b"" if a is None else hashlib.blake2b(f"{lab}/".encode() + a.tobytes(), digest_size=16).digest()
                         for a, lab in zip(got, part["label"], strict=True)], "keys": keys})
    return vectors.select(F.col(row_id).alias("row_id"), F.col("vec_id").cast("string").alias("vec_id"),
                          F.col("label").cast("string").alias("label"), "embedding").mapInPandas(
        C.per_batch(run, 2048), "row_id long, vec_id string, tag string, vector binary, same_key binary, keys array<long>").withColumn(
        "vec_id", F.col("vec_id").cast("long"))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None])


def _share_smaller(keys: list[np.ndarray], key: int) -> np.ndarray:
    """(n, n) bool: the two vectors share a key below ``key``."""
    below = [k[k < key] for k in keys]
    names, column = np.unique(np.concatenate(below), return_inverse=True)
    m = np.zeros((len(keys), len(names)), np.float32)
    m[np.repeat(np.arange(len(keys)), [len(k) for k in below]), column] = 1
    return m @ m.T > 0


def _verify(threshold: float):
    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ids, side = rows["row_id"].to_numpy(), rows["side"].to_numpy()
        across = rows["bi"].to_numpy() != rows["bj"].to_numpy()
        weight = rows["copies"].to_numpy(np.int64)
        vec = [np.frombuffer(v) for v in rows["vector"]]
        keys = [np.asarray(k, np.int64) for k in rows["keys"]]
        key, tag = rows["key"].to_numpy(), rows["tag"].to_numpy(object)
        count, low = np.zeros(len(rows), np.int64), ids.copy()
        # Two labels or widths may share a key by chance: they are told apart here.
        for of in (s + np.flatnonzero(tag[s:e] == t) for s, e in zip(starts[:-1], starts[1:], strict=True) for t in dict.fromkeys(tag[s:e])):
            if len(of) < 2:
                continue
            x = np.stack([vec[i] for i in of])
            linked = _cosines(x, x) >= threshold
            np.fill_diagonal(linked, False)
            if across[of[0]]:
                linked &= side[of, None] != side[of][None]
            if not linked.any():
                continue
            i, j = np.nonzero(linked)
            low[of] = ids[of][C.local_components(len(of), i, j)]
            first = linked & ~_share_smaller([keys[i] for i in of], key[of[0]])
            count[of] = first @ weight[of]
        return pd.DataFrame({"row_id": ids, "links": count, "low": low})
    return run


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS,
          parameters: tuple[int, int, int] | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.  ``parameters`` are (tables, hashes a key, probes a table);
    left out, they follow from the number of vectors and their median width (``parameters_for``)."""
    rows, row_id = C.with_row_id(vectors)
    if parameters is None:
        size = rows.agg(F.count(F.lit(1)), F.percentile_approx(F.when(F.size("embedding") > 0, F.size("embedding")), 0.5)).first()
        parameters = parameters_for(size[0], size[1] or 2)
    tables, hashes, probes = parameters
    known = C.materialise(hashed(rows, row_id, tables, hashes, probes), "hashed")
    able = known.where("vector IS NOT NULL").select("row_id", "vec_id", "same_key")
    groups = C.materialise(C.equal_groups(able, ["same_key"], "row_id", "vec_id"), "vector-groups")
    heads = groups.where("row_id = keep_row").select("row_id", F.col("group_size").alias("copies"))
    reps = C.materialise(heads.join(known.select("row_id", "tag", "vector", "keys"), "row_id"), "vector-heads")
    thin = reps.select("row_id", F.explode("keys").alias("key"))
    counts = C.materialise(thin.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = thin.join(counts, "key").join(reps, "row_id")
    dealt = C.block_pairs(met, "key", "row_id", F.col("n"), block_rows).drop("n")
    keys = ["key", "bi", "bj"]
    checked = (dealt.repartition(*keys).sortWithinPartitions(*keys, "row_id")
               .mapInPandas(C.whole_groups(keys, _verify(threshold)), "row_id long, links long, low long").where("links > 0 OR low <> row_id"))
    checked = C.materialise(checked, "verified-vectors")
    classes = C.connected_components(checked.where("row_id <> low").select(F.col("row_id").alias("a"), F.col("low").alias("b")), "vector-classes")
    links = checked.groupBy("row_id").agg(F.sum("links").alias("links"))
    linked = C.materialise(classes.join(links, classes["node"] == links["row_id"]).select("node", "component", "links"), "vector-links")
    ids = groups.where("row_id = keep_row").select("keep_row", "keep_id")
    smallest = C.materialise(linked.join(ids, linked["node"] == ids["keep_row"]).groupBy("component").agg(F.min("keep_id").alias("smallest")), "smallest")
    per_head = C.materialise(linked.join(smallest, "component").select(F.col("node").alias("keep_row"), "links", "smallest"), "head-links")
    placed = groups.join(per_head, "keep_row", "left").select(
        "row_id", "vec_id", (F.col("group_size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("smallest", "keep_id").alias("component_id"))
    alone = known.where("vector IS NULL").select("row_id", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = placed.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
