"""Best-fit packing, fill-in-the-middle and periodic runs."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import edge_rows  # noqa: E402

from tessera.llm import best_fit, fim, runs  # noqa: E402
from tessera.llm.packing import vocabulary_path  # noqa: E402


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def one_partition(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


# ---- best-fit packing

def ids_of(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path(best_fit.VOCABULARY))
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def check_packing(got, rows, size):
    """Every document's pieces are whole and right, and sequences are gapless and not too long."""
    want = Counter()
    for (i, _), ids in zip(rows, ids_of([t for _, t in rows]), strict=True):
        n = len(ids)
        cuts = [0, n] if n <= size else [*([0] if n % size else []), *range(n % size, n + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s]])[:-1].tolist() and sum(n for _, n in s) <= size
    return len(by), sum(r.length for r in got)


def test_best_fit_edges(spark, edges):
    rows = edge_rows()
    check_packing(best_fit.pack(edges).collect(), rows, best_fit.SEQUENCE)
    n, tokens = check_packing(best_fit.pack(edges.repartition(7), sequence=64).collect(), rows, 64)
    assert n <= -(-tokens // 64) + 3


def test_best_fit_documents(documents, document_rows):
    n, tokens = check_packing(best_fit.pack(documents).collect(), document_rows, 2048)
    assert n <= 1.01 * tokens / 2048 + 1


def test_best_fit_sequences(spark, documents, document_rows):
    packed = best_fit.pack(documents, sequence=256, keep_ids=True)
    rows = [(r.sequence_id, r.offset, bytes(r.ids)) for r in packed.select("sequence_id", "offset", "ids").collect()]
    want = defaultdict(bytes)
    for s, _, ids in sorted(rows):
        want[s] += ids
    got = {r.sequence_id: bytes(r.ids) for r in best_fit.sequences(packed).collect()}
    assert got == dict(want)


def test_best_fit_encodes_as_the_tokenizer():
    rng = random.Random(3)
    marks = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), 0x20AC, 0x370, 0x4E00, 0x1F600, 0x3000)] + ["'s", "'ll", " ", " ", "<|endoftext|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [a + b + c for a in "a1 .\n" for b in marks for c in "a1 .\n"]
    got = best_fit.encode(texts, vocabulary_path(best_fit.VOCABULARY))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [i[:-1] for i in ids_of(texts)]


@pytest.mark.parametrize("lengths", [[1500] * 30, [1500] * 30 + [548] * 4 + [7] * 5, [1] * 5000, [700] * 100 + [3] * 9, [2048] * 5, [], "uniform", "short"])
def test_plan_places_each_piece_once(lengths):
    rng = np.random.default_rng(1)
    if isinstance(lengths, str):
        lengths = (rng.integers(1, 2049, 4000) if lengths == "uniform" else np.minimum(2048, rng.lognormal(5, 1, 20_000).astype(int) + 1)).tolist()
    counts = np.bincount(lengths, minlength=2049).astype(np.int64)
    for plan in (best_fit.combinations(counts), best_fit.combinations(counts, 2, False), best_fit.combinations(counts, 1, False)):
        used = np.zeros_like(counts)
        for use, times in plan:
            assert times > 0 and sum(n * k for n, k in use.items()) <= 2048
            for n, k in use.items():
                used[n] += k * times
        assert (used == counts).all()
    plan = best_fit.Plan(counts)
    length = np.repeat(np.arange(2049), counts)
    nth = np.concatenate([np.arange(c) for c in counts])
    s, o = plan.place(length, nth)
    order = np.lexsort((o, s))
    s, o, length = s[order], o[order], length[order]
    new = np.append(True, s[1:] != s[:-1])[:len(s)]
    assert (o[new] == 0).all() and (o[1:] == o[:-1] + length[:-1])[~new[1:]].all() and ((o + length) <= 2048).all()
    assert plan.sequences == len(set(s.tolist()))


def test_plan_fills_exactly_where_it_can():
    """Single, pair and triple complements: nothing is left over."""
    for lengths in ([2000, 48] * 50, [1500, 300, 248] * 20, [1000, 500, 300, 248] * 20, [2040, 5, 2, 1] * 9):
        counts = np.bincount(lengths, minlength=2049).astype(np.int64)
        assert best_fit.Plan(counts).sequences == -(-sum(lengths) // 2048)


# ---- fill-in-the-middle

def brute_fim(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 50
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, "spm" if spm else "psm", len(pre), len(mid), sha(out), sha(text)


def fim_rows():
    odd = ["\n", "\n\n\n", "a\nb", "a\r\nb\r\n", "x<P>y\nz", "<S>", "< P>\n<", "<\nP>", "é\n漢字\n😀\n" * 40, "\n" * 70_000 + "end", "ab\n" * 50_000, "\u2028\nx\x85\ny"]
    return edge_rows() + [(100 + k, t) for k, t in enumerate(odd)] + [(200 + k, "one\ntwo\nthree\nfour") for k in range(40)]


def test_fim_edges(spark):
    got = fim.digests(fim.apply(one_partition(spark, fim_rows()))).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_fim(*r) for r in fim_rows())
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_takes_clashing_columns_and_empty_tables(spark, edges, nothing):
    assert Counter(tuple(r) for r in fim.digests(fim.apply(edges)).collect()) == Counter(brute_fim(*r) for r in edge_rows())
    assert fim.apply(nothing).count() == 0 and best_fit.pack(nothing).count() == 0 and runs.find(nothing).count() == 0


def test_fim_rates():
    rows = [fim.transform("a\nb\nc", str(i), rate=40, spm=10)[1] for i in range(2000)]
    n = Counter(rows)
    assert 0.5 < n["plain"] / 2000 < 0.7 and 0.01 < n["spm"] / 2000 < 0.08


@pytest.mark.parametrize("kind,name", [("few", "_Array"), ("many", "_Bitmap"), ("long", "_Runs")])
def test_boundary_sets_select_as_lists(kind, name):
    rng = np.random.default_rng(2)
    n = 300_000
    offsets = {"few": np.sort(rng.choice(n, 900, replace=False)), "many": np.flatnonzero(rng.random(n) < 0.4), "long": np.flatnonzero(np.arange(n) // 700 % 3 > 0)}[kind]
    s = fim.BoundarySet(offsets)
    assert {type(c).__name__ for c in s.containers} == {name} and len(s) == len(offsets)
    for k in [0, len(offsets) - 1, *rng.integers(0, len(offsets), 500).tolist()]:
        assert s.select(k) == offsets[k]
    with pytest.raises(IndexError):
        s.select(len(offsets))


# ---- periodic runs

def brute_runs(w, min_words=24, min_power=3):
    n, out = len(w), {}
    for q in range(1, n // min_power + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - s >= max(min_words, min_power * q):
                out.setdefault((s, i), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def sequences_with_runs(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randint(0, 150), rng.choice([1, 2, 3, 40])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w


@pytest.mark.parametrize("slice_words", [1, 3, 16, 1000])
def test_runs_by_slices(slice_words):
    """Whatever the slices, all runs and no others."""
    for w in sequences_with_runs(250, slice_words):
        for how in ((24, 3), (6, 3), (1, 3), (8, 4)):
            assert runs.runs_of(np.array(w, np.int64), slice_words, min_words=how[0], min_power=how[1]) == brute_runs(w, *how)


def test_runs_of_many_texts_at_once():
    texts = [[b"%d" % x for x in w] for w in sequences_with_runs(300, 77)]
    for slice_words in (40, 700, 1 << 16):
        assert runs.runs_of_all(texts, slice_words) == [brute_runs(w) for w in texts]


def test_runs_of_hard_texts():
    """Time stays near linear where everything repeats."""
    w = np.array(([0] * 40 + [1]) * 100)
    assert runs.runs_of(w) == brute_runs(w.tolist())
    assert runs.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    with pytest.raises(ValueError):
        runs.Catchers(min_power=2)


def brute_summary(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w) if n < 3000 else runs.runs_of(np.unique(w, return_inverse=True)[1], 997)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_edges(spark, edges):
    rng = random.Random(9)
    prose = [f"w{rng.randrange(90)}" for _ in range(160)]
    extra = [(300 + k, " ".join(prose[:40 + k % 60])) for k in range(60)]
    extra += [(400, " ".join(prose[:30] * 4 + ["end"])), (401, "\x1c".join(["a"] * 30)), (402, "a\x85a " * 30), (403, "a\x0ba\x0ca " * 12), (404, "x y " * 11 + "x"), (405, "x y " * 12)]
    want = Counter(brute_summary(*r) for r in edge_rows() + extra)
    got = runs.summarise(runs.find(one_partition(spark, edge_rows() + extra), repeated=True)).collect()
    assert Counter(tuple(r) for r in got) == want and sum(r.n_runs for r in got) >= 8
    assert Counter(tuple(r) for r in runs.summarise(runs.find(edges, repeated=True)).collect()) == Counter(brute_summary(*r) for r in edge_rows())


def test_runs_documents(documents, document_rows):
    got = runs.summarise(runs.find(documents, repeated=True)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_summary(*r) for r in document_rows)
