"""Exact inner-product top-k for many queries at once, and the search chains built on it.

Block top-k
-----------
One plan for every size.  Vectors are dealt at random into blocks of bounded bytes and cross the
shuffle once; queries are sent to each block, packed many to a row; rows are ordered so that a block's
vectors come before its queries.  A task holds one vector block and screens the queries of a row by a
matrix product ``Q @ V.T`` in float32: only pairs that its rounding error lets reach the best k so far
are scored, in float64, keeping the best k per query (ties at the cut kept, so the id tie-break stays
exact).  A ``row_number`` window on ``query_id`` (``WindowGroupLimit`` partial + final)
then picks the global top k.  Nothing is collected or broadcast and no job runs before the action;
the number of blocks comes from the planner's size estimate.

Scores are float64 inner products of the L2-normalised query with the stored (already
normalised) float32 vector, rounded to 10 decimals so that equal vectors tie exactly; ranks
break score ties by ascending vector id.  A vector that is NULL or holds a NULL or non-finite
value matches nothing, as does such a query; vectors of another width than the query's are an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import bound_batches
from tessera.sources.blocks import BLOCK_BYTES, Blocks, estimated_bytes

VECTOR_BLOCK_BYTES = BLOCK_BYTES

KNN_SCHEMA = "query_id long, vector_index_id long, score double"
SCORE_DECIMALS = 10
SCORE_CELLS = 1_000_000    # scores of one product: 8 MB, whatever the sizes of block and batch
SCORE_QUERIES = 512        # queries scored together, and packed in a row
BITMAP_BITS = 8 * 4096   # of one bitmap of Spark's bitmap functions


def l2_normalize(col) -> Column:
    """``x / ||x||`` in double; the zero vector stays zero (no division by zero under ANSI)."""
    c = F.col(col) if isinstance(col, str) else col
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(c, lambda x: x.cast("double")))


def dot(a, b) -> Column:
    """Inner product of two numeric arrays in double (single-pair form, for small cases)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


# ------------------------------------------------------------------------------- numpy core

def _normalise_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1))
    out = m.copy()
    nz = norms > 0
    out[nz] = m[nz] / norms[nz, None]
    return out


def _matrix(rows, ids: np.ndarray, dim: int | None, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows' ids and their vectors as a matrix; one width only."""
    rows = list(rows)
    if rows and all(isinstance(v, np.ndarray) and v.dtype.kind == "f" for v in rows) and {len(v) for v in rows} == {dim or len(rows[0])}:
        m = np.stack(rows)
        good = np.isfinite(m).all(axis=1)
        return np.asarray(ids)[good], m[good].astype(dtype, copy=False)
    ok, vecs = [], []
    for i, v in enumerate(rows):
        if v is None:
            continue
        a = np.asarray(v, dtype=np.float64)
        if dim is not None and len(a) != dim:
            raise ValueError(f"vector width {len(a)} differs from query width {dim}")
        dim = len(a)
        if np.isfinite(a).all():
            ok.append(i)
            vecs.append(a.astype(dtype))
    return np.asarray(ids)[ok], np.stack(vecs) if vecs else np.zeros((0, dim or 0), dtype)


def _batch_candidates(scores: np.ndarray, k: int):
    """Per query row, all entries scoring at least the k-th best (ties kept)."""
    n_q, n_b = scores.shape
    if n_b <= k:
        qi, ci = np.nonzero(np.ones_like(scores, dtype=bool))
        return qi, ci
    thr = np.partition(scores, n_b - k, axis=1)[:, n_b - k]
    return np.nonzero(scores >= thr[:, None])


def _merge_topk(qi: np.ndarray, ids: np.ndarray, sc: np.ndarray, k: int):
    """Exact top k per query by (score desc, id asc)."""
    if len(qi) == 0:
        return qi, ids, sc
    order = np.lexsort((ids, -sc, qi))
    qi, ids, sc = qi[order], ids[order], sc[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    group_start = np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
    keep = (np.arange(len(qi)) - group_start) < k
    return qi[keep], ids[keep], sc[keep]


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))


def _exact(q_mat: np.ndarray, v: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Scores of single pairs, as many at a time as fill ``SCORE_CELLS``."""
    out, step = np.empty(len(qi)), max(1, SCORE_CELLS // max(1, q_mat.shape[1]))
    for a in range(0, len(qi), step):
        at = slice(a, a + step)
        out[at] = np.einsum("ij,ij->i", q_mat[qi[at]], v[ci[at]].astype(np.float64))
    return np.round(out, SCORE_DECIMALS)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix, several times as fast where little is set."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _slice_candidates(q_mat, q32, v, reach: float, floor: np.ndarray, k: int, may):
    """``(query, vector, score, many)`` of a slice: every pair that scores its query's ``floor`` or more and is among the
    query's best k of the slice (further ones may be there too).

    A float32 product tells which pairs may: it is off by (width + 4) x 2^-24 x the norms at most (``reach``: the largest
    of the vectors'; a query's is 1).  Where its error would leave too many (equal or huge vectors), all are scored."""
    limit, many = 4 * k * len(q_mat), False
    slack = (q_mat.shape[1] + 16) * 2.0 ** -24 * reach + 1e-9
    if slack < 1e12:
        least = np.float32(np.finfo(np.float32).min)     # leaves out what is masked
        below = lambda x: np.maximum(np.nextafter((x - slack).astype(np.float32), np.float32(-np.inf)), least)[:, None]
        s = q32 @ v.T.astype(np.float32, copy=False)
        if may is not None:
            s[~may] = -np.inf
        qi, ci = _places(s >= below(floor))
        if len(qi) > limit:
            many = True
            if len(v) > k:
                best = np.partition(s, len(v) - k, axis=1)[:, len(v) - k].astype(np.float64)
                qi, ci = _places(s >= below(np.maximum(floor, best - slack)))
        if len(qi) <= limit:
            sc = _exact(q_mat, v, qi, ci)
            real = sc >= floor[qi]
            return qi[real], ci[real], sc[real], many
    # Rounded to 1e-10 so equal vectors tie exactly whatever the summation order.
    s = np.round(q_mat @ v.T.astype(np.float64), SCORE_DECIMALS)
    if may is not None:
        s[~may] = -np.inf
    qi, ci = np.nonzero(s >= floor[:, None])
    if len(qi) > limit:
        qi, ci = _batch_candidates(s, k)
    sc = s[qi, ci]
    real = (sc > -np.inf) & (sc >= floor[qi])
    return qi[real], ci[real], sc[real], many


def _score_blocks(q_ids, q_mat, batches, k: int, allowed=None, least: float | None = None):
    """Exact top k of some queries over an iterator of (ids, matrix) blocks, or (ids, matrix, norms of its rows).

    ``allowed(first, last)``: optional mask (queries x vectors of this slice) of the pairs that count; ``least``: the
    lowest score that counts."""
    acc_q, acc_i, acc_s = [], [], []
    pending = 0
    lowest = np.full(len(q_ids), -np.inf if least is None else least)
    floor = lowest   # the k-th best score so far: what is below cannot enter
    q32 = q_mat.astype(np.float32)
    # Bound each score matrix to SCORE_CELLS entries by slicing the vectors.
    step = max(1, SCORE_CELLS // max(1, len(q_ids)))
    for v_ids, v_mat, *norms in batches:
        norms = norms[0] if norms else _norms(v_mat)
        for a in range(0, len(v_ids), step):
            part, v = v_ids[a:a + step], v_mat[a:a + step]
            may = None if allowed is None else allowed(a, a + step)
            qi, ci, sc, many = _slice_candidates(q_mat, q32, v, float(norms[a:a + step].max()), floor, k, may)
            acc_q.append(qi)
            acc_i.append(part[ci])
            acc_s.append(sc)
            pending += len(qi)
            if pending > 2 * k * len(q_ids) or many:
                m = _merge_topk(np.concatenate(acc_q), np.concatenate(acc_i), np.concatenate(acc_s), k)
                acc_q, acc_i, acc_s = [m[0]], [m[1]], [m[2]]
                pending = len(m[0])
                full, last = np.bincount(m[0], minlength=len(q_ids)) == k, np.full(len(q_ids), -np.inf)
                last[m[0]] = m[2]   # in order: a query's last one stays
                floor = np.where(full, last, lowest)
    if not acc_q:
        return None
    qi, ids, sc = _merge_topk(np.concatenate(acc_q), np.concatenate(acc_i), np.concatenate(acc_s), k)
    return pd.DataFrame({"query_id": q_ids[qi].astype(np.int64), "vector_index_id": ids.astype(np.int64),
                         "score": sc.astype(np.float64)})


# ------------------------------------------------------------------------------- block plan

def _final_rank(cands: DataFrame, k) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vector_index_id").asc())
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_count(vectors: DataFrame, block_bytes: int) -> int:
    """Blocks for a vector table, from the planner's size estimate (no job runs)."""
    spark = vectors.sparkSession
    size = estimated_bytes(vectors)
    if size is None:   # no estimate: as many blocks as the cluster's shuffles have partitions
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, math.ceil(size / block_bytes))


def _runs(pdf: pd.DataFrame):
    """``(vb, tag, rows)`` for each run of equal block and tag in a sorted batch."""
    vb, tag = pdf["vb"].to_numpy(), pdf["tag"].to_numpy()
    edges = np.flatnonzero((vb[1:] != vb[:-1]) | (tag[1:] != tag[:-1])) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, len(pdf)], strict=True):
        yield vb[a], tag[a], pdf.iloc[a:b]


def _score_partition(dim: int | None, least: float | None = None):
    """Scores a partition sorted by (vb, tag): vectors (tag 0) of a block, then its queries (tag 1), packed or one a row; where vectors bear
    documents, a filter's bitmaps (``bitmap`` not null) come before the queries of that filter (``filter``)."""
    def run(batches):
        block, held, ids, mat, norms = None, [], None, None, None
        column, names, masks = None, 0, {}
        for pdf in batches:
            if not len(pdf):
                continue
            for vb, tag, rows in _runs(pdf):
                if tag == 0:
                    if vb != block:
                        block, held, mat = vb, [], None
                    at, m = _matrix(rows["v"], np.arange(len(rows)), dim, np.float32)
                    docs = rows["doc"].to_numpy(object) if "doc" in rows else None
                    held.append((rows["id"].to_numpy(np.int64)[at], m, docs, at))   # the rows themselves keep their whole batch
                    continue
                if vb != block:
                    continue     # a block without vectors
                if mat is None:
                    widths = {m.shape[1] for i, m, _, _ in held if len(i)}
                    if len(widths) > 1:
                        raise ValueError(f"stored vectors have widths {sorted(widths)}")
                    ids = np.concatenate([i for i, _, _, _ in held])
                    docs_at = [(docs, at) for _, _, docs, at in held]
                    parts, held = [m for i, m, _, _ in held if len(i)], []
                    mat = _emptied(parts)
                    norms = _norms(mat)
                    if "doc" in rows:
                        code = {d: i for i, d in enumerate(sorted({d for docs, _ in docs_at for d in docs if d is not None}))}
                        column = np.array([code.get(d, -1) for docs, at in docs_at for d in docs[at]], np.int64)
                        names, masks = len(code), {}
                if not len(ids):
                    continue
                if "ids" in rows:
                    for pack in rows[["ids", "pack", "width", "k"]].itertuples(index=False):
                        of, q = _unpacked(*pack[:3], mat.shape[1])
                        if len(of):
                            out = _score_blocks(of, _normalise_rows(q), [(ids, mat, norms)], int(pack.k), least=least)
                            if out is not None:
                                yield out
                    continue
                may, which = None, None
                if column is not None:
                    of = rows["filter"].to_numpy(np.int64)
                    maps = rows["bitmap"].notna().to_numpy()
                    _read_bitmaps(masks, of[maps], rows[maps], names)
                    rows, of = rows[~maps], of[~maps]
                    here, which = np.unique(of, return_inverse=True)
                    may = [masks[f] for f in here.tolist()]
                for a in range(0, len(rows), SCORE_QUERIES):
                    part = rows.iloc[a:a + SCORE_QUERIES]
                    at, q = _matrix(part["q"], np.arange(len(part)), mat.shape[1], np.float64)
                    if not len(at):
                        continue
                    allowed = None
                    if may is not None:
                        own = np.stack([may[i] for i in which[a:a + SCORE_QUERIES][at]])
                        allowed = lambda x, y: own[:, column[x:y]]  # noqa: B023, E731
                    k = int(part["k"].to_numpy(np.int64)[at].max())
                    out = _score_blocks(part["id"].to_numpy(np.int64)[at], _normalise_rows(q), [(ids, mat, norms)], k, allowed, least)
                    if out is not None:
                        yield out
                if masks:   # the last filter's rows may go on in the next batch
                    last = max(masks)
                    masks = {last: masks[last]}
    return run


def _read_bitmaps(masks: dict[int, np.ndarray], filters: np.ndarray, rows: pd.DataFrame, n: int) -> None:
    """Put into ``masks`` per filter which of a block's ``n`` documents it lets through; a last place is for none."""
    for f, number, bitmap in zip(filters.tolist(), rows["number"], rows["bitmap"], strict=True):
        may = masks.setdefault(f, np.zeros(n + 1, bool))
        first = (int(number) - 1) * BITMAP_BITS   # 32,768 documents each; what is cut off is zero
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")[:max(0, n - first)]
        may[first:first + len(bits)] = bits


def _emptied(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one matrix; each part goes as soon as it is copied, so that the block is not held twice."""
    if not parts:
        return np.zeros((0, 0), np.float32)
    out = np.empty((sum(map(len, parts)), parts[0].shape[1]), np.float32)
    end = len(out)
    while parts:
        m = parts.pop()
        out[end - len(m):end] = m
        end -= len(m)
    return out


PACK_SCHEMA = "id long, ids binary, pack binary, width int, k int"
_NO_ID = np.iinfo(np.int64).min   # what a null id counts as


def _pack(batches):
    """Queries (``id, q, k``) of one width as rows of ``SCORE_QUERIES`` at most: their ids and vectors as bytes, float32
    where that loses nothing.  Null vectors and such with null or non-finite components are left out."""
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.greater_equal(batch.column(2), 1), False))
        ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        ks = batch.column(2).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        lens = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)   # of the rows that are not null
        first = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
        for width in np.unique(lens[lens >= 0]).tolist():
            rows = np.flatnonzero(lens == width)
            for a in range(0, len(rows), SCORE_QUERIES):
                own = rows[a:a + SCORE_QUERIES]
                m = values[first[own][:, None] + np.arange(width)]
                good = np.isfinite(m).all(axis=1)
                m, of = m[good], ids[own][good]
                with np.errstate(over="ignore"):
                    small = m.astype(np.float32)
                m = small if (small == m).all() else m
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(of.min()) if len(of) else None], pa.int64()), pa.array([of.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()),
                     pa.array([width], pa.int32()), pa.array([int(ks[own].max())], pa.int32())], ["id", "ids", "pack", "width", "k"])


def _unpacked(ids: bytes, q: bytes, width: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if width != dim:
        raise ValueError(f"vector width {dim} differs from query width {int(width)}")
    of = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(q) == 4 * len(of) * dim else np.float64
    return of, np.frombuffer(q, kind).reshape(len(of), dim).astype(np.float64)


def _packed(queries: DataFrame, query_id: str, emb: str, k: Column) -> DataFrame:
    """A narrow pass: what a shuffle carries to every block is a row for some hundred queries."""
    bound_batches(queries.sparkSession)
    rows = queries.select(F.col(query_id).cast("long").alias("id"), F.col(emb).cast("array<double>").alias("q"), k.cast("int").alias("k"))
    return rows.mapInArrow(_pack, PACK_SCHEMA)


def _block_plan(vrows: DataFrame, qrows: DataFrame, dim: int | None, *order: Column, least: float | None = None) -> DataFrame:
    bound_batches(vrows.sparkSession)
    rows = vrows.unionByName(qrows, allowMissingColumns=True)
    return (rows.repartition("vb").sortWithinPartitions("vb", "tag", *order, "id")
            .mapInPandas(_score_partition(dim, least), KNN_SCHEMA))


def _vector_rows(vectors: DataFrame, vec_id: str, emb: str, blocks: int, *extra: Column) -> DataFrame:
    vid = F.col(vec_id).cast("long")
    # NULL vectors are skipped while scoring: a filter here would evaluate an embedding UDF twice.
    return vectors.select(
        F.pmod(F.xxhash64(vid), F.lit(blocks)).cast("int").alias("vb"), F.lit(0).alias("tag"), vid.alias("id"),
        F.col(emb).cast("array<float>").alias("v"), *extra)


def _knn_in_place(queries: DataFrame, blocks: Blocks, k: int | str, query_id: str, dim: int | None, least: float | None) -> DataFrame:
    """``knn`` over stored blocks: the queries cross a shuffle to the blocks, the vectors stay in their buckets.  The window
    asks for rows by block, vectors first; the scan and the shuffle, united as they are, already are by block.  Its parts
    are single rows: it keeps no block and no queries a second time."""
    kk = F.lit(k) if isinstance(k, int) else F.col(k).cast("int")
    q = _packed(queries, query_id, "embedding", kk).select(
        F.explode(F.array(*[F.lit(n) for n in blocks.numbers])).alias("vb"), F.lit(1).alias("tag"), "id",
        F.lit(None).cast("array<float>").alias("v"), "ids", "pack", "width", "k")
    rows = blocks.rows.union(q.repartition(len(blocks.numbers), "vb"))
    bound_batches(queries.sparkSession)
    order = F.row_number().over(Window.partitionBy("vb", "tag", "id").orderBy("tag"))
    cands = rows.withColumn("at", order).mapInPandas(_score_partition(dim, least), KNN_SCHEMA)
    if isinstance(k, int):
        return _final_rank(cands, k)
    own = queries.select(F.col(query_id).cast("long").alias("query_id"), kk.alias("_k"))
    return _final_rank(cands.join(own, "query_id"), F.col("_k")).drop("_k")


def knn(queries: DataFrame, vectors: DataFrame | Blocks, k: int | str, *, query_id: str = "query_id",
        vec_id: str = "vector_index_id", emb: str = "embedding", vector_dim: int | None = None,
        vector_blocks: int | None = None, block_bytes: int = VECTOR_BLOCK_BYTES, least: float | None = None) -> DataFrame:
    """Top ``k`` stored vectors per query, of those that score ``least`` or more where given: ``query_id, vector_index_id,
    score, rank``.

    ``vectors`` are rows, dealt into blocks by this plan, or ``Blocks`` that were dealt beforehand.
    ``queries`` has a LONG ``query_id`` and an array ``embedding``; ``k`` is a number, or the name of a
    column of ``queries`` with each query's own.  Query vectors are L2-normalised, stored vectors are
    taken as stored.  Widths are checked while scoring (against ``vector_dim`` where given)."""
    if isinstance(k, int) and k < 1:
        raise ValueError("k must be >= 1")
    if isinstance(vectors, Blocks):
        return _knn_in_place(queries, vectors, k, query_id, vector_dim, least)
    blocks = vector_blocks or _block_count(vectors, block_bytes)
    kk = F.lit(k) if isinstance(k, int) else F.col(k).cast("int")
    q = _packed(queries, query_id, emb, kk).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("vb"), F.lit(1).alias("tag"), "id", "ids", "pack", "width", "k")
    cands = _block_plan(_vector_rows(vectors, vec_id, emb, blocks), q, vector_dim, least=least)
    if isinstance(k, int):
        return _final_rank(cands, k)
    own = queries.select(F.col(query_id).cast("long").alias("query_id"), kk.alias("_k"))
    return _final_rank(cands.join(own, "query_id"), F.col("_k")).drop("_k")


# ------------------------------------------------------------------------------- search chains

def semantic_search(queries: DataFrame, vectors: DataFrame | Blocks, chunks: DataFrame, *, limit: int = 10,
                    threshold: float = 0.5, document_ids=None, filter_mode: str = "post",
                    live_first: bool = False, vector_dim: int | None = None, document_sets: DataFrame | None = None) -> DataFrame:
    """Reference order of operations per query: best ``2 * limit`` candidates -> keep
    ``score >= threshold`` -> drop vectors whose chunk is gone -> document filter -> first
    ``limit``.  ``filter_mode="pre"`` restricts vectors before scoring; ``live_first`` drops
    tombstoned vectors before scoring.

    ``document_ids``: a list (an ``IN`` predicate; empty = no filter), or a DataFrame (a semi-join); a
    frame with a ``query_id`` column filters per query (in pre mode each query is scored against its
    allowed documents only).  In pre mode it may name sets, ``query_id, set_id``, whose documents are in
    ``document_sets`` (``set_id, document_id``).

    ``chunks``: ``vector_index_id, chunk_id, document_id, content, chunk_index`` (live rows).
    Output: ``query_id, rank, vector_index_id, document_id, chunk_id, content, chunk_index,
    similarity_score``.
    """
    if limit < 1:
        raise ValueError("limit must be >= 1")
    if filter_mode not in ("post", "pre"):
        raise ValueError("filter_mode must be 'post' or 'pre'")
    frame = document_ids if isinstance(document_ids, DataFrame) else None
    ids = [str(i) for i in document_ids] if frame is None and document_ids is not None else []
    meta = chunks.select("vector_index_id", "chunk_id", "document_id", "content", "chunk_index")
    dealt = isinstance(vectors, Blocks)
    if dealt and (live_first or filter_mode == "pre"):
        raise ValueError("blocks hold vectors without documents: filter after scoring")
    vecs = vectors if dealt else vectors.select("vector_index_id", "embedding")
    per_query = frame is not None and "query_id" in frame.columns
    if filter_mode == "pre" and (ids or frame is not None) and not per_query:
        allowed = meta.where(F.col("document_id").isin(ids)) if ids else meta.join(frame.select("document_id"), "document_id", "left_semi")
        vecs = vecs.join(allowed.select("vector_index_id"), "vector_index_id", "left_semi")
    if live_first:
        vecs = vecs.join(meta.select("vector_index_id"), "vector_index_id", "left_semi")
    if per_query and filter_mode == "pre":
        cand = prefiltered_knn(queries, frame, vecs, meta, 2 * limit, sets=document_sets, vector_dim=vector_dim)
    else:
        cand = knn(queries, vecs, 2 * limit, vector_dim=vector_dim, least=threshold)
    hits = cand.where(F.col("score") >= F.lit(threshold)).join(meta, "vector_index_id", "inner")
    if filter_mode == "post":
        if ids:
            hits = hits.where(F.col("document_id").isin(ids))
        elif frame is not None:
            keys = ["query_id", "document_id"] if per_query else ["document_id"]
            hits = hits.join(frame.select(*keys).distinct(), keys, "left_semi")
    return first_hits(hits, F.lit(limit))


def first_hits(hits: DataFrame, limit) -> DataFrame:
    """The first ``limit`` of each query's candidates that found their chunk, numbered anew."""
    w = Window.partitionBy("query_id").orderBy("rank")
    out = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return out.select("query_id", F.col("_r").alias("rank"), "vector_index_id", "document_id", "chunk_id",
                      "content", "chunk_index", F.col("score").alias("similarity_score"))


def search_requests(requests: DataFrame, vectors: DataFrame, chunks: DataFrame, *, limit: int = 10,
                    threshold: float = 0.5, vector_dim: int | None = None) -> DataFrame:
    """``semantic_search`` for requests that carry their own parameters: ``query_id, embedding`` and,
    where not NULL, ``limit``, ``similarity_threshold`` and ``document_ids`` (an array; empty = no filter).
    The NULL ones take the defaults; a request whose limit is below 1 has no hits."""
    q = requests.select(
        F.col("query_id").cast("long").alias("query_id"), "embedding",
        F.coalesce(F.col("limit").cast("int"), F.lit(limit)).alias("limit"),
        F.coalesce(F.col("similarity_threshold").cast("double"), F.lit(threshold)).alias("similarity_threshold"),
        "document_ids").where("limit >= 1").withColumn("fetch", F.col("limit") * 2)
    cand = knn(q, vectors.select("vector_index_id", "embedding"), "fetch", vector_dim=vector_dim)
    meta = chunks.select("vector_index_id", "chunk_id", "document_id", "content", "chunk_index")
    own = q.select("query_id", "limit", "similarity_threshold", "document_ids")
    free = F.col("document_ids").isNull() | (F.size("document_ids") == 0)
    hits = (cand.join(own, "query_id").where("score >= similarity_threshold").join(meta, "vector_index_id")
            .where(free | F.array_contains("document_ids", F.col("document_id"))))
    return first_hits(hits, F.col("limit"))


def prefiltered_knn(queries: DataFrame, allowed: DataFrame, vectors: DataFrame, meta: DataFrame, k: int, *,
                    sets: DataFrame | None = None, vector_dim: int | None = None, vector_blocks: int | None = None,
                    block_bytes: int = VECTOR_BLOCK_BYTES) -> DataFrame:
    """Exact top k per query over the vectors of that query's allowed documents only.

    ``allowed``: ``query_id, document_id``; or, with ``sets`` (``set_id, document_id``), ``query_id, set_id``: the sets
    whose documents a query may match, so that queries with one filter share it.  Scored in blocks like ``knn``.  A block
    numbers its documents; a set's documents of a block are a bitmap over those numbers, cut behind its last one.  Queries
    with the same sets have one filter, whose sets' bitmaps are or-ed and sent to each block that holds one of its documents,
    once; its queries come behind it and bear its number only.  No row per (query, vector) pair exists, no bitmap per query
    of a shared filter, and with ``sets`` no row per (query, document)."""
    blocks = vector_blocks or _block_count(vectors, block_bytes)
    if sets is None:
        allowed, sets = allowed.select("query_id", F.col("query_id").alias("set_id")).distinct(), allowed.withColumnRenamed("query_id", "set_id")
    placed = vectors.join(meta.select("vector_index_id", "document_id"), "vector_index_id")
    vrows = _vector_rows(placed, "vector_index_id", "embedding", blocks, F.col("document_id").alias("doc"), F.lit(0).cast("long").alias("filter"))
    held = vrows.select("vb", F.col("doc").alias("document_id")).where("document_id IS NOT NULL").distinct()
    # the numbers that the scoring task gives its block's documents: their place in order
    held = held.withColumn("ordinal", F.row_number().over(Window.partitionBy("vb").orderBy("document_id")))
    member = sets.select("set_id", "document_id").join(held, "document_id")
    member = member.select("set_id", "vb", F.bitmap_bucket_number("ordinal").alias("number"), F.bitmap_bit_position("ordinal").alias("bit"))
    used = F.expr("substring(bitmap, 1, CAST(last DIV 8 + 1 AS INT))")
    # bits cross the shuffle, not bitmaps of 4 KB: the groups are whole before the aggregate
    maps = (member.repartition("set_id", "vb", "number").groupBy("set_id", "vb", "number")
            .agg(F.bitmap_construct_agg("bit").alias("bitmap"), F.max("bit").alias("last")).withColumn("bitmap", used))
    own = (allowed.where("query_id IS NOT NULL AND set_id IS NOT NULL").groupBy(F.col("query_id").cast("long").alias("query_id"))
           .agg(F.array_sort(F.collect_set("set_id")).alias("sets")))
    filters = own.groupBy("sets").agg(F.min("query_id").alias("filter"))
    own = own.join(filters, "sets").select("query_id", "filter")
    maps = (filters.select("filter", F.explode("sets").alias("set_id")).join(maps, "set_id").groupBy("filter", "vb", "number")
            .agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.max("last").alias("last")).withColumn("bitmap", used))
    routed = maps.groupBy("filter").agg(F.collect_set("vb").alias("vbs"))
    q = queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    qrows = own.join(routed, "filter").join(q, "query_id").select(
        F.explode("vbs").alias("vb"), F.lit(1).alias("tag"), F.col("query_id").alias("id"), "q", F.lit(k).alias("k"), "filter")
    frows = maps.select("vb", F.lit(1).alias("tag"), "filter", "number", "bitmap")
    rows = qrows.unionByName(frows, allowMissingColumns=True)
    return _final_rank(_block_plan(vrows, rows, vector_dim, F.col("filter"), F.col("bitmap").isNull()), k)


def attach_metadata(hits: DataFrame, documents: DataFrame, iso) -> DataFrame:
    """One left join for all hits (not one lookup per hit); no document row -> NULL metadata."""
    d = documents.select("document_id", "filename", "document_type", "upload_timestamp",
                         F.lit(True).alias("_m"))
    j = hits.join(d, "document_id", "left")
    meta = F.when(F.col("_m"), F.struct(
        F.col("filename"), F.col("document_type"), iso("upload_timestamp").alias("upload_timestamp"),
        F.col("chunk_index")))
    return j.select(*hits.columns, meta.alias("metadata"))


def similar_documents(vectors: DataFrame, chunks: DataFrame, *, limit: int = 10, threshold: float = 0.5,
                      sources: DataFrame | None = None) -> DataFrame:
    """For every source document: its lowest-index chunk's stored vector is the query; a search
    for ``limit + 10`` kept chunks (``2 * (limit + 10)`` candidates, ``>= threshold``, live), from which the
    source's own chunks are dropped; of the first ``limit`` chunks left, each other document's best.

    Output: ``source_document_id, position, document_id, chunk_id, similarity_score, total_found``.
    """
    meta = chunks.select("vector_index_id", "chunk_id", "document_id", "content", "chunk_index")
    reps = meta.groupBy("document_id").agg(
        F.min_by("vector_index_id", F.struct("chunk_index", "vector_index_id")).alias("rep_vid"))
    if sources is not None:
        reps = reps.join(sources.select("document_id"), "document_id", "left_semi")
    q = (reps.join(vectors.select(F.col("vector_index_id").alias("rep_vid"), "embedding"), "rep_vid")
         .select(F.col("rep_vid").alias("query_id"), F.col("document_id").alias("source_document_id"),
                 "embedding"))
    src_of = q.select("query_id", "source_document_id")
    cand = knn(q.select("query_id", "embedding"), vectors.select("vector_index_id", "embedding"), 2 * (limit + 10))
    hits = first_hits(cand.where(F.col("score") >= F.lit(threshold)).join(meta, "vector_index_id", "inner"), F.lit(limit + 10))
    others = hits.join(src_of, "query_id", "inner").where(F.col("document_id") != F.col("source_document_id"))
    w = Window.partitionBy("query_id").orderBy("rank")
    cut = others.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    wd = Window.partitionBy("query_id", "document_id").orderBy("_r")
    best = cut.withColumn("_d", F.row_number().over(wd)).where(F.col("_d") == 1)
    wp = Window.partitionBy("query_id")
    return best.select("source_document_id", F.row_number().over(wp.orderBy("_r")).alias("position"), "document_id",
                       "chunk_id", "similarity_score", F.count("*").over(wp).alias("total_found"))
