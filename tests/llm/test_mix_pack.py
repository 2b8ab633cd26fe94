"""Source mixing, packing and the pipeline."""

import math
import os
import sys
import time
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from cases import SF, edge_rows  # noqa: E402

from tessera.llm import common, mixing, packing  # noqa: E402


def plan(df, **kw):
    rows, row_id = common.with_row_id(df)
    return mixing.plan(rows, row_id, **kw)


def test_exponent_meets_its_bounds(spark):
    tokens = {"a": 100_000, "b": 20_000, "c": 3_000, "d": 500}
    df = spark.createDataFrame(list(tokens.items()), "source string, tokens long")

    def entropy(a):
        w = np.array(list(tokens.values()), float) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum()
    a = mixing.fit_exponent(df, 4.0, None)
    assert math.isclose(200 ** (1 - a), 4.0, rel_tol=1e-6)
    a = mixing.fit_exponent(df, 1e9, 1.0)
    assert abs(entropy(a) - 1.0) < 1e-6
    assert mixing.fit_exponent(df, 1e9, 5.0) == 0.0
    assert mixing.fit_exponent(df, 1.0, None) == pytest.approx(1.0, abs=1e-6)
    assert mixing.fit_exponent(df.limit(0), 2.0, None) == 1.0


def check_plan(rows, want_docs, max_repeat):
    assert Counter(r.doc_id for r in rows if r.epoch == 0) == want_docs
    tokens, used = Counter(), Counter()
    for r in rows:
        used[r.source] += r.n_tokens
        tokens[r.source] += r.n_tokens * (r.epoch == 0)
    longest = max(r.n_tokens for r in rows)
    top = max(tokens.values())
    alpha = 1 - math.log(max_repeat) / math.log(top / min(tokens.values())) if top / min(tokens.values()) > max_repeat else 0.0
    for s in tokens:
        assert abs(used[s] - tokens[s] * (top / tokens[s]) ** (1 - alpha)) <= longest + 1e-6 * top
    by_block = defaultdict(list)
    for r in rows:
        by_block[r.block].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by_block.values())
    assert len({(r.row_id, r.epoch) for r in rows}) == len(rows)


def test_mixing_documents(documents, document_rows, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    rows = plan(documents, block_tokens=10_000).collect()
    check_plan(rows, Counter(i for i, _ in document_rows), mixing.MAX_REPEAT)
    # every full block holds the sources' weights
    total = Counter()
    for r in rows:
        total[r.source] += r.n_tokens
    blocks = max(r.block for r in rows) + 1
    top = max(total, key=total.get)
    per = Counter()
    for r in rows:
        if r.source == top:
            per[r.block] += r.n_tokens
    longest = max(r.n_tokens for r in rows)
    assert all(abs(per[b] - total[top] / blocks) <= 2 * longest for b in range(blocks))


def test_mixing_edges(edges, nothing):
    check_plan(plan(edges).collect(), Counter(i for i, _ in edge_rows()), mixing.MAX_REPEAT)
    assert plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    out = mixing.mix(edges)
    assert out.columns == edges.columns
    assert set(Counter(r.doc_id for r in edges.collect())) == set(r.doc_id for r in out.collect())


def tokens_of(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.vocabulary_path())
    t.encode_special_tokens = True
    return [np.append(np.array(e.ids, "<u4"), np.uint32(1)) for e in t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]


def check_pack(pieces, rows, sequence):
    """Exact round trip of every document's ids, gapless sequences, no padding."""
    want = Counter((i, a.tobytes()) for (i, _), a in zip(rows, tokens_of(rows), strict=True))
    by_row = defaultdict(list)
    for p in pieces:
        by_row[p.row_id].append(p)
    sums = defaultdict(Counter)
    for i, ids in want:
        sums[i][len(ids) // 4, ids] += want[i, ids]
    for parts in by_row.values():
        parts.sort(key=lambda p: p.start)
        at = 0
        for p in parts:
            assert p.start == at and p.length > 0
            at += p.length
        assert at == parts[0].doc_tokens
        fits = [k for k in sums[parts[0].doc_id] if k[0] == at and all(
            zlib.crc32(k[1][4 * p.start:4 * (p.start + p.length)]) == p.ids_crc32 for p in parts)]
        assert fits
        sums[parts[0].doc_id][fits[0]] -= 1
    assert not any(+c for c in sums.values())
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == sequence or (at < sequence and at & (at - 1) == 0)


@pytest.mark.parametrize("options", [{}, {"shard_tokens": 5000, "sequence": 256, "window": 4}, {"in_order": True, "shard_tokens": 3000}])
def test_packing(edges, documents, document_rows, options):
    check_pack(packing.pack(edges, **options).collect(), edge_rows(), options.get("sequence", 2048))
    check_pack(packing.pack(documents, **options).collect(), document_rows, options.get("sequence", 2048))


def test_packing_empty(nothing):
    assert packing.pack(nothing).count() == 0


def test_service_follows_the_shares():
    """After each window every source is within one document and one window's credit of its share, and
    a source that is owed from earlier shards catches up."""
    rng = np.random.default_rng(4)
    share, window = np.array([0.6, 0.3, 0.1]), 4096
    source = rng.choice(3, 6000, p=share)
    tokens = rng.integers(1, 800, 6000)
    order = packing.serve_order(source, tokens, share, np.zeros(3), window)
    served = np.cumsum(np.eye(3)[source[order]] * tokens[order][:, None], 0)
    done = served.sum(1)
    steady = done < 0.9 * done[-1]
    assert np.abs(served[steady] - done[steady][:, None] * share).max() < window + 2 * 800
    owed = np.array([0.0, 0.0, 5000.0])
    early = packing.serve_order(source, tokens, share, owed, window)[:40]
    assert tokens[early][source[early] == 2].sum() >= 4000


def test_balances_carry_over_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(s, f"s{k}", int(rng.integers(1, 1000))) for s in range(30) for k in range(4) if rng.random() < 0.8]
    total = sum(r[2] for r in rows)
    got = {(r.shard, r.source): r.owed for r in packing.balances(spark.createDataFrame(rows, "shard long, source string, tokens long"), total, 7).collect()}
    assert set(got) == {(s, k) for s, k, _ in rows}
    for (shard, source), owed in got.items():
        share = sum(n for _, k, n in rows if k == source) / total
        want = share * sum(n for s, _, n in rows if s < shard) - sum(n for s, k, n in rows if s < shard and k == source)
        assert math.isclose(owed, want, abs_tol=1e-6)


def test_pipeline_stages(spark, documents):
    import corpus_pipeline as P
    kept = documents
    for name, stage in P.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = common.materialise(stage(spark, kept, SF), f"test-{name}")
        assert kept.columns == documents.columns
        after = Counter((r.doc_id, r.text) for r in kept.collect())
        if name == "exact_dedup":
            assert after == Counter({r: 1 for r, w in zip(before, brute.exact_groups(before), strict=True) if w[0] == w[1]})
        if name == "near_dup":
            assert after == Counter({r: 1 for r, w in zip(before, brute.near_classes(before), strict=True) if w[0] == w[1]})
        if name == "mixing":
            assert set(after) == set(before) and max(after.values()) <= 2
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    check_pack(P.STAGES[-1][1](spark, kept, SF).collect(), rows, 2048)


def test_pipeline_edges(spark, edges, nothing):
    """Null ids, repeated rows and clashing columns pass the row stages; an empty table passes all."""
    import corpus_pipeline as P
    stages = dict(P.STAGES)
    exact = stages["exact_dedup"](spark, edges, SF)
    assert exact.columns == edges.columns
    assert exact.count() == len({w[3] for w in brute.exact_groups(edge_rows())})
    near = stages["near_dup"](spark, edges, SF)
    sizes = brute.near_classes(edge_rows())
    assert near.columns == edges.columns and near.count() == round(sum(1 / w[3] for w in sizes))
    for name, stage in P.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_pipeline_stages_chained(spark, documents):
    """A stage takes the result of the one before as it is, and what others run meanwhile does not touch its tables."""
    import corpus_pipeline as P
    stages = dict(P.STAGES)
    exact = stages["exact_dedup"](spark, documents, SF)
    near = stages["near_dup"](spark, exact, SF)
    other = stages["near_dup"](spark, documents, SF)
    first = [(r.doc_id, r.text) for r in exact.collect()]
    want = {r: 1 for r, w in zip(first, brute.near_classes(first), strict=True) if w[0] == w[1]}
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter(want)
    assert other.count() > 0


def test_tables_go_when_nothing_reads_them(spark):
    exists = lambda path: os.path.exists(path.removeprefix("file:"))

    def settled(*want):
        """The last plans that ran may be held a little longer."""
        for _ in range(20):
            spark.range(10).count()
            common.delete_unused_tables(spark)
            if [exists(p) for p in paths] == list(want):
                return True
            time.sleep(0.3)
        return False
    with common.recorded() as paths:
        held = common.materialise(spark.range(5), "test-held")
        derived = common.materialise(spark.range(7), "test-derived").where("id > 2")
        common.materialise(spark.range(9), "test-loose").count()
    assert settled(True, True, False)
    assert held.count() == 5 and derived.count() == 4
    del held, derived
    assert settled(False, False, False)


def test_pipeline_runs_side_by_side(spark):
    import corpus_pipeline as P
    count = lambda df: Counter((r.doc_id, r.start, r.ids_crc32) for r in df.collect())
    with ThreadPoolExecutor(2) as pool:
        a, b = [f.result() for f in [pool.submit(P.run, spark, SF) for _ in range(2)]]
    assert count(a) == count(b) and a.count() > 0


def test_pipeline_row_stages_on_edge_rows(spark, edges):
    """Quality keeps or drops whole rows, mixing uses each at least once, packing packs all of them; columns pass through."""
    import corpus_pipeline as P
    stages, rows = dict(P.STAGES), Counter(edge_rows())
    pair = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    kept = stages["quality"](spark, edges, SF)
    assert kept.columns == edges.columns and not pair(kept) - rows
    mixed = common.materialise(stages["mixing"](spark, edges, SF), "test-edges")
    assert mixed.columns == edges.columns and not rows - pair(mixed) and set(pair(mixed)) == set(rows)
    check_pack(stages["packing"](spark, mixed, SF).collect(), list(pair(mixed).elements()), 2048)


def test_packing_in_order(spark, documents, document_rows):
    """Shards are runs of the input's order, and every document is packed once."""
    df = common.materialise(documents.orderBy("doc_id").coalesce(1), "test-ordered")
    options = {"shard_tokens": 5000, "sequence": 256, "window": 4}
    pieces = packing.pack(df, in_order=True, **options).collect()
    check_pack(pieces, document_rows, 256)
    shards = defaultdict(set)
    for p in pieces:
        shards[p.sequence_id >> 32].add((p.row_id, p.doc_tokens))
    assert len(shards) > 5
    runs = sorted((min(s), max(s)) for s in shards.values())
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))
    assert all(sum(n for _, n in s) <= 5000 + max(n for _, n in s) for s in shards.values())


def test_pipeline_packs_in_the_order_of_the_blocks(spark, documents, monkeypatch):
    """The blocks of the mixture come out of the packing stage as they went in."""
    import corpus_pipeline as P
    stages = dict(P.STAGES)
    monkeypatch.setattr(mixing.plan, "__defaults__", (*mixing.plan.__defaults__[:2], 4000, mixing.plan.__defaults__[3]))
    monkeypatch.setattr(packing.pack, "__defaults__", (*packing.pack.__defaults__[:3], 4000, packing.pack.__defaults__[4]))
    mixed = common.materialise(stages["mixing"](spark, documents, SF), "test-mixed")
    pieces = stages["packing"](spark, mixed, SF).collect()
    shards = defaultdict(set)
    for p in pieces:
        shards[p.sequence_id >> 32].add(p.row_id)
    assert len(shards) > 5
    runs = sorted((min(s), max(s)) for s in shards.values())
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))


def test_pipeline_quality_and_mixing_stages(spark, documents):
    """The quality stage keeps the rows that op7 scores at least 0.3; mixing uses each source as often as the exponent says."""
    import corpus_pipeline as P
    from tessera.llm import quality
    stages = dict(P.STAGES)
    scores = quality.classify(documents, common.read(spark, SF, "labels")).collect()
    kept = common.materialise(stages["quality"](spark, documents, SF), "test-quality")
    good = Counter(r.doc_id for r in scores if r.score >= 0.3)
    assert 0 < sum(good.values()) < len(scores)
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == good
    count = lambda df: [(r.source or "", len((r.text or "").split()) or 1) for r in df.select("source", "text").collect()]
    before, after = count(kept), count(common.materialise(stages["mixing"](spark, kept, SF), "test-mixing"))
    tokens, used = Counter(), Counter()
    for s, n in before:
        tokens[s] += n
    for s, n in after:
        used[s] += n
    top, least = max(tokens.values()), min(tokens.values())
    power = math.log(mixing.MAX_REPEAT) / math.log(top / least) if top / least > mixing.MAX_REPEAT else 1.0
    longest = max(n for _, n in before)
    for s in tokens:
        assert abs(used[s] - tokens[s] * (top / tokens[s]) ** power) <= longest + 1e-6 * top
