"""Default text-model rules checked against plain-Python brute force on small inputs."""

import random
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from tessera.operators import embed as E
from tessera.operators import models, nlp

TEXTS = [
    ("d1", "The cat sat. The cat ran! A dog barked?  Then the cat slept.\nNew line here"),
    ("d2", "One. Two two. Three three three."),
    ("d3", ""),
    ("d4", "  leading space. trailing   "),
    ("d5", "Odd \x01 marker here. After\x01 it. End"),
]


def _sentences(text):
    text = text.replace("\x01", " ")
    out, pos, off = [], 0, 0
    pieces = re.sub(r"([.!?]\s+|\n\s*)", lambda m: m.group(1) + "\x01", text).split("\x01")
    for i, p in enumerate(pieces):
        s = p.strip()
        if s:
            lead = len(p) - len(p.lstrip())
            out.append((i, s, off + lead, off + lead + len(s)))
        off += len(p)
    return out


def _summary(text, mx, mn):
    sents = _sentences(text)
    toks = [w.lower() for _, s, _, _ in sents for w in s.split()]
    freq = {}
    for t in toks:
        freq[t] = freq.get(t, 0) + 1
    scored = [(sum(freq[w.lower()] for w in s.split()) / len(s.split()), i, s) for i, s, _, _ in sents]
    ranked = sorted(scored, key=lambda x: (-x[0], x[1]))
    kept, cum = [], 0
    for rk, (_, i, s) in enumerate(ranked, 1):
        nw = len(s.split())
        cum += nw
        if rk == 1 or cum <= mx or cum - nw < mn:
            kept.append((i, s))
    summ = " ".join(s for _, s in sorted(kept))
    n = len(text.split())
    return summ, n, len(summ.split()), (len(summ.split()) / n if n else 0.0)


@pytest.mark.parametrize("mx,mn", [(150, 30), (5, 2), (3, 0)])
def test_summarize_matches_python(spark, mx, mn):
    df = spark.createDataFrame(TEXTS, "document_id string, text string")
    got = {r.document_id: (r.summary, r.original_length, r.summary_length, r.compression_ratio)
           for r in nlp.summarize(df, max_length=mx, min_length=mn).collect()}
    for k, t in TEXTS:
        assert got[k][:3] == _summary(t, mx, mn)[:3]
        assert got[k][3] == pytest.approx(_summary(t, mx, mn)[3])


def test_sentence_offsets(spark):
    df = spark.createDataFrame(TEXTS, "document_id string, text string")
    got = {}
    for r in nlp.sentences(nlp.by_key(df, "document_id"), "document_id").collect():
        got.setdefault(r.document_id, []).append((r.pos, r.sentence, r.start_position, r.end_position))
    for k, t in TEXTS:
        exp = _sentences(t)
        assert sorted(got.get(k, [])) == exp
        for _, s, a, b in exp:
            assert t.replace("\x01", " ")[a:b] == s


def test_answer_matches_python(spark):
    rows = [(1, "where did the cat sleep", TEXTS[0][1]), (2, "zebra", TEXTS[1][1]), (3, "two three", TEXTS[1][1])]
    df = spark.createDataFrame(rows, "question_id long, question string, context string")
    got = {r.question_id: r for r in nlp.answer(df).collect()}
    for qid, q, ctx in rows:
        terms = list(dict.fromkeys(q.lower().split()))
        best = None
        for i, s, a, b in _sentences(ctx):
            m = len(set(terms) & set(s.lower().split()))
            if m > 0 and (best is None or m > best[0]):
                best = (m, s, a, b)
        r = got[qid]
        if best is None:
            assert (r.answer, r.confidence, r.start_position) == ("", 0.0, None)
        else:
            assert (r.answer, r.start_position, r.end_position) == best[1:]
            assert r.confidence == pytest.approx(best[0] / len(terms))


def test_entities_offsets_and_counts_agree(spark):
    text = ("mail me at a.b@mail1.example.com or x@y.org, call 1 (743) 555-3824, card 4785 3805 9239 1139, "
            "ip 10.0.0.1, key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff see https://ex.example.net/a?b=1")
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    ents = nlp.extract_entities(df).collect()
    for e in ents:
        assert text[e.start_position:e.end_position] == e.text
    labels = {}
    for e in ents:
        labels[e.label] = labels.get(e.label, 0) + 1
    counts = {r.label: r.n_entities for r in nlp.entity_counts(df, "text").collect()}
    assert {k: v for k, v in counts.items() if v} == labels
    assert labels["EMAIL"] == 2 and labels["URL"] == 1 and labels["PHONE"] == 1


def test_resolve_text_cases(spark):
    req = spark.createDataFrame([(1, "given", None), (2, "", "a"), (3, None, "zz"), (4, None, None)],
                                "request_id long, text string, document_id string")
    docs = spark.createDataFrame([("a", "stored text")], "document_id string, text string")
    got = {r.request_id: (r.source, r.resolved_text, r.error) for r in nlp.resolve_text(req, docs).collect()}
    assert got == {1: ("text", "given", None), 2: ("document", "stored text", None),
                   3: (None, None, nlp.NOT_FOUND), 4: (None, None, nlp.NO_INPUT)}


def test_pluggable_text_model(spark):
    """A model backend is any ``texts -> outputs`` callable, built once per worker."""
    def factory():
        return lambda texts: [{"summary": " ".join(t.split()[:2]), "n": len(t.split())} for t in texts]
    model = nlp.PandasTextModel(factory, "document_id string, summary string, n long", batch_size=2)
    df = spark.createDataFrame([(k, t) for k, t in TEXTS], "document_id string, text string")
    got = {r.document_id: (r.summary, r.n) for r in model.apply(df, "document_id", "text").collect()}
    assert got["d2"] == ("One. Two", 6) and got["d3"] == ("", 0)


def test_own_lengths_per_row(spark):
    rows = [(k, t, mx, mn) for (k, t), (mx, mn) in zip(TEXTS, [(150, 30), (3, 0), (5, 2), (1, 0), (4, 4)])]
    df = spark.createDataFrame(rows, "document_id string, text string, mx int, mn int")
    got = {r.document_id: (r.summary, r.original_length, r.summary_length) for r in nlp.summarize(df, max_length="mx", min_length="mn").collect()}
    assert got == {k: _summary(t, mx, mn)[:3] for k, t, mx, mn in rows}


def test_models_take_the_rules_place(spark):
    """Stub models for summaries, for (question, context) and for entities (1:N)."""
    df = spark.createDataFrame(TEXTS, "document_id string, text string")
    short = nlp.PandasTextModel(lambda: lambda texts: [{"summary": t[:3]} for t in texts], "document_id string, summary string", batch_size=2)
    got = {r.document_id: (r.summary, r.original_length) for r in nlp.summarize(df, model=short).collect()}
    assert got["d2"] == ("One", 6) and got["d3"] == ("", 0)
    qa = nlp.PandasTextModel(lambda: lambda qs, cs: [{"answer": f"{q}/{len(c)}", "confidence": 0.5, "start_position": 0, "end_position": 1} for q, c in zip(qs, cs)],
                             "question_id long, answer string, confidence double, start_position int, end_position int", batch_size=1)
    asked = spark.createDataFrame([(1, "who", "abc"), (2, "why", None)], "question_id long, question string, context string")
    assert {r.question_id: r.answer for r in nlp.answer(asked, model=qa).collect()} == {1: "who/3", 2: "why/0"}
    ner = nlp.PandasTextModel(lambda: lambda texts: [[{"text": w, "label": "W", "confidence": 1.0, "start_position": 0, "end_position": 1} for w in t.split()[:2]] for t in texts],
                              nlp.ENTITY_SCHEMA.replace("key", "document_id"), many=True)
    found = nlp.extract_entities(df, model=ner).collect()
    assert sorted((e.document_id, e.text) for e in found if e.document_id in ("d2", "d3")) == [("d2", "One."), ("d2", "Two")]


def test_a_model_is_built_once_per_worker(spark):
    from tessera.operators import models
    calls = []
    for _ in range(3):
        models.built("test-key", lambda: calls.append(1) or (lambda t: t))
    assert len(calls) == 1


def test_entity_lists_keep_rows_without_entities(spark):
    df = spark.createDataFrame([(1, "a@b.org then 10.0.0.1"), (2, "none"), (3, None)], "request_id long, text string")
    got = {r.request_id: (r.entity_count, [(e.label, e.start_position) for e in r.entities]) for r in nlp.entity_lists(df, "request_id").collect()}
    assert got == {1: (2, [("EMAIL", 0), ("IP_ADDRESS", 13)]), 2: (0, []), 3: (0, [])}


def test_pluggable_embedder(spark):
    import numpy as np
    from tessera.operators import embed as E

    def factory():
        return lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts])
    emb = E.PandasEmbedder(factory, dim=3, batch_size=2)
    df = spark.createDataFrame([("a", "abc"), ("b", ""), ("c", "abcdef")], "chunk_id string, content string")
    got = {r.chunk_id: r.embedding for r in E.embed_chunks(df, emb).collect()}
    assert np.allclose(got["a"], np.array([3, 1, 0]) / np.sqrt(10), atol=1e-6)
    assert np.allclose(got["b"], [0, 1, 0])


def test_hashing_embedder_matches_python(spark):
    import hashlib
    import numpy as np
    from tessera.operators import embed as E
    text = "The the cat  SAT\ton the mat. Über straße"
    df = spark.createDataFrame([("x", text)], "chunk_id string, content string")
    vec = np.asarray(E.embed_chunks(df).first().embedding, dtype=np.float64)
    counts = np.zeros(384)
    for w in text.lower().split():
        counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 384] += 1
    assert np.allclose(vec, (counts / np.linalg.norm(counts)).astype(np.float32), atol=1e-7)


def test_hashing_udf_equals_jvm_rule(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from tessera.operators import embed as E
    from tessera.plans import fixtures as fx
    h = E.HashingEmbedder()
    ch = fx.stored_chunks(spark, "/root/testdata/sf0.001").limit(200)
    rows = ch.select(h.column("content").alias("e"), h.buckets("content").alias("b")).collect()
    for r in rows:
        c = np.bincount(np.asarray(r.b, dtype=np.int64), minlength=384).astype(np.float64)
        assert np.allclose(np.asarray(r.e), (c / np.linalg.norm(c)).astype(np.float32), atol=0)


# ---- models with a limited input

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # workers cannot import this file

def limited(rule, size):
    """A model that refuses more words than its input holds."""
    def model(*inputs):
        assert all(len(t.split()) <= size for t in inputs[-1])
        return [rule(*row) for row in zip(*inputs, strict=True)]
    return lambda: model


def limited_answer(q, c):
    a, conf, s, e = nlp.answer_of(q, c)
    return {"answer": a, "confidence": conf, "start_position": s, "end_position": e}


def limited_entities(t):
    return [dict(zip(("text", "label", "confidence", "start_position", "end_position"), e, strict=True)) for e in nlp.entities_of(t)]


def limited_summary(t):
    return {"summary": nlp.summary_of(t, 12, 3)[0]}


def long_texts():
    rng = random.Random(4)
    some = ["alpha", "beta", "gamma", "delta", "mail me@b.org now", "call 555-123-4567", "at 10.0.0.7", "4111 1111 1111 1111", "end."]
    return [" ".join(rng.choice(some) for _ in range(n)) for n in (0, 1, 5, 30, 39, 41, 80, 333, 2000)] + ["  spaced \n\n out  ", "x. " * 500]


def test_windows_hold_every_short_run_of_words():
    for text in long_texts():
        for size, overlap in ((40, 8), (7, 0), (5, 4)):
            got = models.windows(text, size, overlap)
            assert all(text[s:s + len(p)] == p and len(p.split()) <= size or p == text for s, p in got)
            words = [m.span() for m in re.finditer(r"\S+", text)]
            for i in range(len(words) - max(overlap, 1) + 1):
                a, b = words[i][0], words[i + max(overlap, 1) - 1][1]
                assert any(s <= a and b <= s + len(p) for s, p in got)
    with pytest.raises(ValueError):
        models.windows("a b", 3, 3)


def test_budget_batches_waste_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.minimum(512, rng.lognormal(4.5, 0.9, 4000).astype(int) + 1).tolist()
    cuts = models.budget_batches(lengths, 4096)
    assert sorted(i for c in cuts for i in c) == list(range(4000))
    assert all(len(c) * max(lengths[i] for i in c) <= 4096 for c in cuts)
    padded = lambda groups: sum(len(c) * max(lengths[i] for i in c) for c in groups)
    fixed = [range(a, min(a + 32, 4000)) for a in range(0, 4000, 32)]
    assert 1 - sum(lengths) / padded(cuts) < 0.10 < 1 - sum(lengths) / padded(fixed)


def test_budget_keeps_outputs_in_order(spark):
    texts = [(i, "w " * (i * 7 % 23)) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(texts, "id long, content string")
    def factory():
        return lambda ts: np.array([[len(t.split()) + 1.0, 1.0] for t in ts])
    one, other = (E.PandasEmbedder(factory, 2, **kw).column("content") for kw in ({}, {"budget": 50}))
    rows = df.select("id", one.alias("a"), other.alias("b")).collect()
    assert len(rows) == 61 and all(r.a == r.b for r in rows)


def test_limited_models_over_long_texts(spark):
    """Texts that fit go in whole; longer ones give the best answer, each entity once and a summary of summaries."""
    texts, size, overlap = long_texts(), 40, 8
    df = spark.createDataFrame([(i, "where is gamma and delta now", t) for i, t in enumerate(texts)], "id long, question string, text string")
    qa = nlp.PandasTextModel(limited(limited_answer, size), "id long, answer string, confidence double, start_position int, end_position int",
                             window=size, overlap=overlap, merge=nlp.best_answer, budget=200)
    ner = nlp.PandasTextModel(limited(limited_entities, size), "id long, text string, label string, confidence double, start_position int, end_position int",
                              many=True, window=size, overlap=overlap, merge=nlp.joined_entities)
    short = nlp.PandasTextModel(limited(limited_summary, size), "id long, summary string", window=size, overlap=overlap, merge=nlp.summary_of_summaries(size, overlap))
    answers = {r.id: r for r in nlp.answer(df, "id", context="text", model=qa).collect()}
    found = {}
    for r in nlp.extract_entities(df, "id", model=ner).collect():
        found.setdefault(r.id, []).append((r.text, r.label, r.confidence, r.start_position, r.end_position))
    summaries = {r.id: r.summary for r in nlp.summarize(df, "id", model=short).collect()}
    for i, t in enumerate(texts):
        parts = models.windows(t, size, overlap)
        scored = [(-a["confidence"], s + (a["start_position"] or 0), s, a) for s, p in parts for a in [limited_answer("where is gamma and delta now", p)]]
        _, _, s, best = min(scored, key=lambda x: x[:2])
        at = best["start_position"]
        assert (answers[i].answer, answers[i].confidence, answers[i].start_position) == (best["answer"], best["confidence"], None if at is None else at + s)
        if at is not None:
            assert t[answers[i].start_position:answers[i].end_position] == answers[i].answer
        assert sorted(found.get(i, []), key=lambda e: (e[3], e[1])) == sorted(nlp.entities_of(t), key=lambda e: (e[3], e[1]))
        if len(parts) == 1:
            assert summaries[i] == limited_summary(t)["summary"]
        else:
            text = " ".join(limited_summary(p)["summary"] for _, p in parts)
            while len(text.split()) > size:
                shorter = " ".join(limited_summary(p)["summary"] for _, p in models.windows(text, size, overlap))
                if len(shorter.split()) >= len(text.split()):
                    text = " ".join(text.split()[:size])
                    break
                text = shorter
            assert summaries[i] == limited_summary(text)["summary"] and len(summaries[i].split()) <= size
