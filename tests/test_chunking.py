"""Chunk windows (golden table), counts, and overlap-free reassembly."""

import math

import pytest

from tessera.operators import chunking


def _chunks(spark, n_words, size=512, overlap=50):
    text = " ".join(f"w{i}" for i in range(n_words))
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    return sorted((r.chunk_index, r.start_position, r.end_position, r.content)
                  for r in chunking.chunk_text(df, size=size, overlap=overlap).collect())


@pytest.mark.parametrize("n,windows", [
    (0, []), (1, [(0, 1)]), (462, [(0, 462)]), (463, [(0, 463), (462, 463)]), (512, [(0, 512), (462, 512)]),
    (513, [(0, 512), (462, 513)]), (924, [(0, 512), (462, 924)]), (925, [(0, 512), (462, 925), (924, 925)]),
    (1000, [(0, 512), (462, 974), (924, 1000)])])
def test_golden_windows(spark, n, windows):
    got = _chunks(spark, n)
    assert [(s, e) for _, s, e, _ in got] == windows
    assert [i for i, *_ in got] == list(range(len(windows)))
    for _, s, e, content in got:
        assert content == " ".join(f"w{i}" for i in range(s, e))


def test_count_property(spark):
    for n in (3, 100, 461, 1387, 2000):
        assert len(_chunks(spark, n)) == math.ceil(n / 462)


def test_reference_split_semantics(spark):
    df = spark.createDataFrame([("d", "  a b\tc　\n d  ")], "document_id string, text string")
    assert [r.content for r in chunking.chunk_text(df).collect()] == ["a b c d"]


def test_bad_parameters_raise(spark):
    df = spark.createDataFrame([("d", "a")], "document_id string, text string")
    with pytest.raises(ValueError):
        chunking.chunk_text(df, size=10, overlap=10)
    with pytest.raises(ValueError):
        chunking.chunk_text(df, size=0, overlap=0)


def test_reassemble_parity_and_dedup(spark):
    words = [f"w{i}" for i in range(1000)]
    df = spark.createDataFrame([("d", " ".join(words))], "document_id string, text string")
    ch = chunking.chunk_text(df)
    parity = chunking.reassemble_text(ch).first()
    dedup = chunking.reassemble_text(ch, dedup_overlap=True).first()
    assert dedup.text == " ".join(words)
    assert parity.chunk_count == 3
    # the 50-word overlaps appear twice, and the 50 tail words three times' worth of windows
    assert len(parity.text.split()) == 512 + 512 + 76
