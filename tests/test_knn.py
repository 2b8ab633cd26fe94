"""Vector search: golden scenarios of the reference filter chain, strategies and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn as K

# Scores by vector id for one query: 0->0.9 (A), 1->0.8 (A), 2->0.7 (B), 3->0.6 (C), 4->0.6 (B), 5->0.2 (D)
SCORES = [(0, 0.9, "A"), (1, 0.8, "A"), (2, 0.7, "B"), (3, 0.6, "C"), (4, 0.6, "B"), (5, 0.2, "D")]


def _vec(s):
    return [float(s), math.sqrt(1 - s * s)]


@pytest.fixture()
def store(spark):
    vectors = spark.createDataFrame([(i, _vec(s)) for i, s, _ in SCORES], "vector_index_id long, embedding array<float>")
    chunks = spark.createDataFrame([(i, f"{d}-{i}", d, f"c{i}", i) for i, _, d in SCORES],
                                   "vector_index_id long, chunk_id string, document_id string, content string, chunk_index int")
    queries = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<float>")
    return queries, vectors, chunks


def _ids(df):
    return [r.vector_index_id for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("limit,threshold,filt,mode,deleted,expected", [
    (2, 0.5, None, "post", None, [0, 1]),
    (2, 0.5, ["C"], "post", None, [3]),
    (1, 0.5, ["B"], "post", None, []),
    (1, 0.5, ["B"], "pre", None, [2]),
    (2, 0.5, None, "post", "A", [2, 3]),
    (1, 0.5, None, "post", "A", []),
    (5, 0.6, None, "post", None, [0, 1, 2, 3, 4]),
    (5, 0.5, [], "post", None, [0, 1, 2, 3, 4]),
])
def test_golden_search(spark, store, limit, threshold, filt, mode, deleted, expected):
    q, v, c = store
    if deleted:
        c = c.where(F.col("document_id") != deleted)
    got = K.semantic_search(q, v, c, limit=limit, threshold=threshold, document_ids=filt, filter_mode=mode)
    assert _ids(got) == expected


def test_similar_documents_counts_own_chunks_in_the_search(spark):
    """Worked by hand: source S has 16 chunks on top, then 24 other documents with one chunk each.  The
    search keeps 10 + 10 chunks, S's 16 among them, so 4 documents are left, not 10."""
    rows = [(i, 1.0 - i / 1000, "S", i) for i in range(16)] + [(100 + i, 0.9 - i / 100, f"d{i:02d}", 0) for i in range(24)]
    v = spark.createDataFrame([(i, _vec(s)) for i, s, _, _ in rows], "vector_index_id long, embedding array<float>")
    c = spark.createDataFrame([(i, f"{d}-{x}", d, "t", x) for i, _, d, x in rows],
                              "vector_index_id long, chunk_id string, document_id string, content string, chunk_index int")
    src = spark.createDataFrame([("S",)], "document_id string")
    got = K.similar_documents(v, c, limit=10, threshold=0.5, sources=src).orderBy("position").collect()
    assert [(r.position, r.document_id, r.total_found) for r in got] == [(i + 1, f"d{i:02d}", 4) for i in range(4)]


def test_unusable_vectors_match_nothing(spark):
    """NULL and non-finite vectors, stored or asked, have no hits and disturb no others."""
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [0.0, 1.0]), (5, [1.0, None])],
                              "vector_index_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 0.0])], "query_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vector_index_id) for r in K.knn(q, v, 1).collect()]
    assert got == [(1, 1, 0)]


def test_requests_bring_their_own_parameters(spark, store):
    _, v, c = store
    rows = [(1, None, None, None), (2, 2, None, None), (3, 5, 0.65, []), (4, 1, 0.1, ["B"]), (5, 2, 0.1, ["B"]), (6, 0, None, None)]
    req = spark.createDataFrame([(i, [1.0, 0.0], n, t, d) for i, n, t, d in rows],
                                "query_id long, embedding array<float>, limit int, similarity_threshold double, document_ids array<string>")
    got = {}
    for r in K.search_requests(req, v, c).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vector_index_id)
    assert got == {1: [0, 1, 2, 3, 4], 2: [0, 1], 3: [0, 1, 2], 5: [2]}


def test_similar_documents_cut_then_group(spark):
    # Query = document A's first vector (id 0, along x); hits 2 (B, 0.7), 4 (B, 0.65), 3 (C, 0.6)
    rows = [(0, 1.0, "A", 0), (2, 0.7, "B", 0), (4, 0.65, "B", 1), (3, 0.6, "C", 0)]
    v = spark.createDataFrame([(i, _vec(s)) for i, s, _, _ in rows], "vector_index_id long, embedding array<float>")
    c = spark.createDataFrame([(i, f"{d}-{x}", d, "t", x) for i, _, d, x in rows],
                              "vector_index_id long, chunk_id string, document_id string, content string, chunk_index int")
    src = spark.createDataFrame([("A",)], "document_id string")
    got = K.similar_documents(v, c, limit=2, threshold=0.5, sources=src).orderBy("position").collect()
    assert [r.document_id for r in got] == ["B"]          # cut to 2 chunks (2, 4) -> only B
    got3 = K.similar_documents(v, c, limit=3, threshold=0.5, sources=src).orderBy("position").collect()
    assert [(r.document_id, r.chunk_id) for r in got3] == [("B", "B-0"), ("C", "C-0")]


def _brute(qs, vs, k):
    out = {}
    for qid, q in qs:
        qn = np.asarray(q, dtype=np.float64)
        n = np.linalg.norm(qn)
        qn = qn / n if n > 0 else qn
        sc = sorted(((round(float(qn @ np.asarray(v, dtype=np.float64)), 10), vid) for vid, v in vs),
                    key=lambda x: (-x[0], x[1]))
        out[qid] = [vid for _, vid in sc[:k]]
    return out


@pytest.mark.parametrize("blocks", [None, 1, 9])
def test_blocks_match_brute_force(spark, blocks):
    rng = np.random.default_rng(7)
    vs = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    vs += [(1000 + i, vs[i][1]) for i in range(20)]          # exact duplicates -> tied scores
    qs = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(25)] + [(99, [0.0] * 8)]
    vdf = spark.createDataFrame(vs, "vector_index_id long, embedding array<float>").repartition(5)
    qdf = spark.createDataFrame(qs, "query_id long, embedding array<float>")
    got = K.knn(qdf, vdf, 7, vector_blocks=blocks)
    res = {}
    for r in got.orderBy("query_id", "rank").collect():
        res.setdefault(r.query_id, []).append(r.vector_index_id)
    assert res == _brute(qs, vs, 7)


def test_wrong_width_and_bad_limit_raise(spark, store):
    q, v, c = store
    bad = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="differs from query width"):
        K.knn(bad, v, 3).collect()
    mixed = v.unionByName(spark.createDataFrame([(9, [1.0])], "vector_index_id long, embedding array<float>"))
    with pytest.raises(Exception, match="width"):
        K.knn(q, mixed, 3, vector_blocks=1).collect()
    with pytest.raises(ValueError):
        K.knn(q, v, 0)
    with pytest.raises(ValueError):
        K.semantic_search(q, v, c, limit=0)


def test_scores_in_unit_interval(spark, store):
    q, v, c = store
    got = K.knn(q, v, 6).collect()
    assert all(-1.0 - 1e-9 <= r.score <= 1.0 + 1e-9 for r in got)


def test_post_is_prefix_of_pre(spark):
    rng = np.random.default_rng(3)
    vs = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(200)]
    v = spark.createDataFrame(vs, "vector_index_id long, embedding array<float>")
    c = spark.createDataFrame([(i, f"{i % 9}-{i}", str(i % 9), "t", i) for i, _ in vs],
                              "vector_index_id long, chunk_id string, document_id string, content string, chunk_index int")
    q = spark.createDataFrame([(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(10)],
                              "query_id long, embedding array<float>")
    post = K.semantic_search(q, v, c, limit=5, threshold=-1.0, document_ids=["1", "2"], filter_mode="post")
    pre = K.semantic_search(q, v, c, limit=5, threshold=-1.0, document_ids=["1", "2"], filter_mode="pre")
    gp, gr = {}, {}
    for r in post.orderBy("rank").collect():
        gp.setdefault(r.query_id, []).append(r.vector_index_id)
    for r in pre.orderBy("rank").collect():
        gr.setdefault(r.query_id, []).append(r.vector_index_id)
    for qid, ids in gp.items():
        assert gr[qid][:len(ids)] == ids


def test_per_query_pre_filter(spark):
    rng = np.random.default_rng(11)   # several blocks: each query meets a block once, with its documents there
    vs = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(120)]
    v = spark.createDataFrame(vs, "vector_index_id long, embedding array<float>")
    c = spark.createDataFrame([(i, f"{i % 6}-{i}", str(i % 6), "t", i) for i, _ in vs],
                              "vector_index_id long, chunk_id string, document_id string, content string, chunk_index int")
    qs = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(8)]
    q = spark.createDataFrame(qs, "query_id long, embedding array<float>")
    allowed = {qid: {str(qid % 6), str((qid + 1) % 6)} for qid, _ in qs}
    flt = spark.createDataFrame([(qid, d) for qid, ds in allowed.items() for d in ds], "query_id long, document_id string")
    got = K.semantic_search(q, v, c, limit=4, threshold=-1.0, document_ids=flt, filter_mode="pre")
    res = {}
    for r in got.orderBy("rank").collect():
        res.setdefault(r.query_id, []).append(r.vector_index_id)
    for qid, qv in qs:
        sub = [(i, e) for i, e in vs if str(i % 6) in allowed[qid]]
        assert res[qid] == _brute([(qid, qv)], sub, 4)[qid]


def test_score_slicing_keeps_exact_results(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vs = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(150)]
    qs = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(9)]
    monkeypatch.setattr(K, "SCORE_CELLS", 20)        # forces slices of 2 vectors
    got = K._score_blocks(np.array([q for q, _ in qs]), K._normalise_rows(np.array([e for _, e in qs], dtype=np.float64)),
                          [(np.array([i for i, _ in vs]), np.array([e for _, e in vs], dtype=np.float64))], 5)
    res = {}
    for r in got.sort_values(["query_id", "score", "vector_index_id"], ascending=[True, False, True]).itertuples():
        res.setdefault(r.query_id, []).append(r.vector_index_id)
    assert res == _brute(qs, vs, 5)


def test_document_sets_as_bitmaps(spark):
    """Several sets a query, more documents in a block than one bitmap holds, unusable vectors among them."""
    rng = np.random.default_rng(8)
    rows = [(i, f"d{i % 40_000}", [float(x) for x in rng.normal(size=2)] if i % 11 else None) for i in range(50_000)]
    v = spark.createDataFrame(rows, "vector_index_id long, document_id string, embedding array<float>")
    sets = [(s, f"d{j}") for s, step in ((0, 7), (1, 1000), (2, 39_999), (3, 10**6)) for j in range(0, 40_000, step)] + [(1, "unknown"), (None, "d5"), (2, None)]
    own = [(0, 0), (1, 1), (1, 2), (2, 3), (3, 1), (3, 1), (4, 9), (5, None)]
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "query_id long, embedding array<double>")
    args = spark.createDataFrame(own, "query_id long, set_id int"), v.select("vector_index_id", "embedding"), v.select("vector_index_id", "document_id")
    got = K.prefiltered_knn(q, *args, 5, sets=spark.createDataFrame(sets, "set_id int, document_id string"), vector_blocks=1)
    got = {(r.query_id, r["rank"]): r.vector_index_id for r in got.collect()}
    want = {}
    for i in range(6):
        ids = {d for s, d in sets for j, t in own if j == i and s == t and s is not None}
        unit = np.array([1.0, i]) / np.hypot(1, i)
        scored = sorted((-round(float(np.float32(e[0]) * unit[0] + np.float32(e[1]) * unit[1]), 10), k) for k, d, e in rows if e and d in ids)
        want |= {(i, n + 1): k for n, (_, k) in enumerate(scored[:5])}
    assert got == want and len(want) == 16


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e30])
def test_screened_scores_are_exact(monkeypatch, scale):
    """scores closer than float32 tells apart, groups of equal vectors, vectors of any size, masked pairs."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(40, 6))
    v = np.concatenate([base, base[:20] + 1e-7 * rng.normal(size=(20, 6)), np.repeat(base[:3], 60, axis=0), np.zeros((2, 6))]).astype(np.float32)
    v = np.concatenate([v, (v[:30] * scale).astype(np.float32)])
    q = K._normalise_rows(np.concatenate([base[:15], rng.normal(size=(6, 6)), np.zeros((1, 6))]))
    ids = rng.permutation(len(v)) + 5
    s = np.round(q @ v.astype(np.float64).T, K.SCORE_DECIMALS)
    may = rng.random(s.shape) < 0.7
    for cells in (100, 700, 10**6):
        monkeypatch.setattr(K, "SCORE_CELLS", cells)
        for allowed, least in ((None, None), (None, 0.3), (lambda a, b: may[:, a:b], None)):
            got = K._score_blocks(np.arange(len(q)), q, [(ids, v)], 5, allowed, least)
            for i in range(len(q)):
                own = [(-s[i, j], ids[j]) for j in range(len(v)) if (allowed is None or may[i, j]) and s[i, j] >= (-np.inf if least is None else least)]
                want = sorted(own)[:5]
                mine = got[got["query_id"] == i]
                assert mine["vector_index_id"].tolist() == [j for _, j in want]
                np.testing.assert_allclose(-mine["score"].to_numpy(float), [x for x, _ in want], rtol=1e-12, atol=2e-10)


def test_queries_go_to_the_blocks_packed(spark, monkeypatch):
    """every block got a row of every query."""
    v = spark.range(50).select(F.col("id").alias("vector_index_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    bad = F.when(F.col("id") % 10 == 7, F.lit(None).cast("array<double>")).when(F.col("id") % 10 == 8, F.array(F.lit(1.0), F.lit(None)))
    q = spark.range(0, 700, 1, 1).select(F.col("id").alias("query_id"), bad.otherwise(F.array(F.lit(1.0), F.col("id") * 0.1)).alias("embedding"),
                                         (F.col("id") % 3).alias("n"))
    sent, plan = [], K._block_plan
    monkeypatch.setattr(K, "_block_plan", lambda vrows, rows, *a, **k: sent.append(rows) or plan(vrows, rows, *a, **k))
    got = {(r.query_id, r["rank"]): r.vector_index_id for r in K.knn(q, v, 2, vector_blocks=3).collect()}
    assert sent[0].count() <= 3 * 2
    assert got == {(i, n): 50 - n for i in range(700) if i % 10 not in (7, 8) for n in (1, 2)}
    own = {(r.query_id, r["rank"]) for r in K.knn(q, v, "n", vector_blocks=2).collect()}   # none where its own number is 0
    assert own == {(i, n) for i in range(700) if i % 10 not in (7, 8) for n in range(1, i % 3 + 1)}
    assert {r.vector_index_id for r in K.knn(q.where("query_id = 0"), v, 9, vector_blocks=2, least=47.0).collect()} == {47, 48, 49}
