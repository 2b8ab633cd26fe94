"""Exact dedup, n-gram join, repeated passages and vector dedup against brute force."""

import os
import sys
from collections import Counter

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from cases import edge_rows  # noqa: E402

from tessera.llm import common, exact_dedup, near_dup, suffix_dedup, vector_dedup  # noqa: E402


def tally(rows):
    return Counter(tuple(r) for r in rows)


def exact(df, **kw):
    return exact_dedup.group_equal_texts(df, **kw)


@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_exact_dedup_edges(edges, hash_bytes):
    """One byte of hash makes chunks clash: their contents must still be told apart."""
    got = exact(edges, hash_bytes=hash_bytes).collect()
    want = brute.exact_groups(edge_rows())
    assert tally((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == tally(want)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({w[3] for w in want})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_documents(documents, document_rows):
    got = exact(documents).collect()
    assert tally((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == tally(brute.exact_groups(document_rows))


def test_chunks_rebuild_their_text():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 5000, 200_000):
        b = rng.integers(97, 123, n, dtype=np.uint8).tobytes()
        parts = exact_dedup.cut(b)
        assert b"".join(parts) == b and all(len(p) <= exact_dedup.LARGEST for p in parts)
    # an insertion at the front leaves the later cuts alone
    assert set(exact_dedup.cut(b"new" + b)[2:]) & set(exact_dedup.cut(b)[2:])


@pytest.mark.parametrize("block_rows", [256, 2])
def test_ngram_join_edges(edges, block_rows):
    got = near_dup.join(edges, block_rows=block_rows).collect()
    assert tally((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got) == tally(brute.near_classes(edge_rows()))
    kept = Counter((r.class_id, r.class_size) for r in got if r.kept)
    assert sum(kept.values()) == sum(1 for _ in {(r.class_id, r.class_size, r.row_id if r.class_size == 1 else 0) for r in got})


def test_ngram_join_documents(documents, document_rows):
    got = near_dup.join(documents).collect()
    assert tally((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got) == tally(brute.near_classes(document_rows))


def test_bands_meet_the_recall():
    for threshold, recall in ((0.8, 0.9995), (0.5, 0.95), (0.9, 0.999)):
        bands, rows = near_dup.bands_for(threshold, recall, 400)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 400


def test_ngram_join_large_near_group(spark):
    """A group of near copies over several blocks: every link counted once, one class."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(60):
        t = list(base)
        t[int(rng.integers(0, 200))] = f"only{i}"
        rows.append((i, " ".join(t)))
    got = near_dup.join(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=8).collect()
    assert tally((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got) == tally(brute.near_classes(rows))


def boilerplate(n, words, own):
    """``n`` texts that share a passage of ``words`` words and have ``own`` words of their own."""
    shared = " ".join(f"s{k}" for k in range(words))
    return [(i, shared + " " + " ".join(f"d{i}x{k}" for k in range(own))) for i in range(n)]


def dealt_rows(spark, rows, block_rows):
    docs, row_id = common.with_row_id(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    signed = near_dup.signatures(docs, row_id, near_dup.THRESHOLD, near_dup.RECALL)
    reps = common.materialise(signed.selectExpr("row_id", "1L AS copies", "1L AS weight", "bands"), "test-reps")
    return near_dup.places(reps, block_rows).count()


def test_ngram_join_shared_passages(spark):
    """Documents that only share a passage (Jaccard 0.44) hang together over their band mates: nothing links, and no
    more rows are dealt than there are bands."""
    rows = boilerplate(400, 62, 38)
    got = near_dup.join(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=16).collect()
    assert all(r.kept and r.n_links == 0 for r in got)
    assert dealt_rows(spark, rows, 16) <= 400 * near_dup.bands_for()[0]


def test_ngram_join_deals_a_large_group_in_block_pairs(spark):
    """Near copies that all link: each home's documents meet each other home's once."""
    rows = boilerplate(600, 190, 1)
    blocks = 600 / 32
    assert dealt_rows(spark, rows, 32) <= 600 * (blocks + 2)


def test_least_mates_keep_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, m) for i in range(400, 700) for m in (400, 405, 410, 415)]
    edges = spark.createDataFrame(links, "a long, b long")
    few = [(r.a, r.b) for r in common.least_mates(edges).collect()]
    assert brute.components(700, few) and len(few) < len(links)
    name = lambda pairs: [min(k for k, c in enumerate(comp) if c == mine) for comp in [brute.components(700, pairs)] for mine in comp]
    assert name(few) == name(links)
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert all(name(links)[n] == c for n, c in got.items())


def ordered_edges():
    """The rows in the operator's order: null ids first, then ids, repeated rows as they come."""
    rows = edge_rows()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "hot": 2}, {"block_bytes": 3000}])
def test_repeats_edges(edges, options):
    got = suffix_dedup.remove_repeats(edges, **options).collect()
    named = lambda rows: tally(tuple(r) for r in rows if r[0] is not None and r[0] != 1)
    want = brute.repeats(ordered_edges())
    mine = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]
    assert named(mine) == named(want)
    # rows that share an id (or have none) may come in either order: together they lose the same
    assert sum(r[2] for r in mine) == sum(r[2] for r in want) and len(mine) == len(want)


def test_repeats_documents(documents, document_rows):
    got = suffix_dedup.remove_repeats(documents, block_bytes=60_000).collect()
    assert tally((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == tally(brute.repeats(document_rows))


def test_repeats_kept_bytes(spark):
    t = "The quick brown fox jumps over the lazy dog while nobody is looking at the river bank tonight, says the old man. "
    df = spark.createDataFrame([(1, t), (2, "a" + t + "b")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, keep_text=True).collect()}
    assert got == {1: t.encode(), 2: b"ab"}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row_id string, keys int")


def links_of(rows, threshold=0.98):
    use = []
    for k, (_, e, lab, *_rest) in enumerate(rows):
        ok = lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        use.append(np.array(e, np.float32).astype(float) if ok else None)
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
             if use[a] is not None and use[b] is not None and rows[a][2] == rows[b][2] and len(use[a]) == len(use[b])
             and use[a] @ use[b] / (np.sqrt(use[a] @ use[a]) * np.sqrt(use[b] @ use[b])) >= threshold]
    comp, count, members = brute.components(len(rows), links), Counter(x for link in links for x in link), {}
    for k, c in enumerate(comp):
        members.setdefault(c, []).append(rows[k][0])
    return [(rows[k][0], count[k], brute.first(members[c])) for k, c in enumerate(comp)]


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1), (7, [1.0, 2.0], None),
           (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0], 2), (None, [1.0, 2.01], 1), (11, [1.0, 2.0, 0.0], 1),
           (12, [-1.0, -2.0], 1), (13, [5.0], 1), (14, [1e-30, 2e-30], 1)]
    rows = [(*r, "x", 1) for r in odd]
    got = vector_dedup.dedup(vectors(spark, rows)).collect()
    assert tally((r.vec_id, r.n_links, r.component_id) for r in got) == tally(links_of(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_vector_doubles_of_any_size(spark):
    """Squares that over- or underflow a double do not keep vectors from linking; nothing else changes."""
    big, tiny = 1e200, 1e-200
    rows = [(1, [big, 2 * big], 1), (2, [tiny, 2 * tiny], 1), (3, [1.0, 2.0], 1), (4, [5e-324, 1e-323], 1), (5, [1.7e308, 1.7e308], 1),
            (6, [1.0, 1.0], 1), (7, [0.0, 0.0], 1), (8, [big, -big], 2), (9, [1e-320, -1e-320], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.dedup(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (1, 8), 9: (1, 8)}


def test_vector_keys_shared_by_chance():
    """Equal keys of two labels or widths link nothing across them."""
    vec = [np.array(v).tobytes() for v in ([1.0, 2.0], [1.0, 2.0], [1.0, 2.0], [1.0, 2.0, 0.0], [1.0, 2.0, 0.0])]
    rows = pd.DataFrame({"row_id": range(5), "side": 0, "bi": 0, "bj": 0, "copies": 1, "vector": vec, "keys": [[7]] * 5, "key": 7,
                         "tag": ["a/2", "b/2", "a/2", "a/3", "b/3"]})
    got = vector_dedup._verify(0.98)(rows, np.array([0, 5]))
    assert got["links"].tolist() == [1, 0, 1, 0, 0] and got["low"].tolist() == [0, 1, 0, 3, 4]


@pytest.mark.parametrize("width,rows", [(16, 10**4), (16, 10**7), (64, 10**4), (64, 10**7), (64, 10**9), (384, 10**7), (384, 3 * 10**10)])
def test_vector_recall_of_planted_pairs(width, rows):
    """Pairs at the threshold share a key, with the settings for each size of corpus."""
    tables, hashes, probes = vector_dedup.parameters_for(rows, width)
    rng = np.random.default_rng(width + hashes)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    a = unit(rng.normal(size=(300, width)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    ka, kb = (vector_dedup.probe_keys(x, tables, hashes, probes) for x in (a, b))
    met = sum(bool(set(x) & set(y)) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))
    assert met >= 0.99 * len(a)


def test_vector_clusters(spark):
    """Planted clusters around the threshold: links, counts and components as by all pairs; small blocks."""
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.normal(size=64)
        for k in range(25):
            rows.append((c * 25 + k, (centre + rng.normal(size=64) * rng.choice([0.05, 0.12, 0.2])).tolist(), c % 3, "x", 1))
    want = links_of(rows)
    got = vector_dedup.dedup(vectors(spark, rows), block_rows=8).collect()
    assert sum(w[1] for w in want) > 500
    assert tally((r.vec_id, r.n_links, r.component_id) for r in got) == tally(want)


def test_empty_tables(spark, nothing):
    assert exact(nothing).count() == 0
    assert near_dup.join(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert vector_dedup.dedup(vectors(spark, [])).count() == 0
