"""Scalar text rules against Python's own behaviour and the golden tables."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T

WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029"
            "\u202f\u205f\u3000")


def _one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("name", ["a.pdf", "a.tar.txt", ".pdf", "..pdf", "a.", "unknown_file", "dir/x.DOCX",
                                  "dir.d/noext", ".hidden.txt", "a..b", "", "a.b.c.", "x/.y"])
def test_splitext_matches_python(spark, name):
    import os
    assert _one(spark, T.extension("v"), name) == os.path.splitext(name)[1]


@pytest.mark.parametrize("name,size,expected", [
    ("a.pdf", 52_428_800, None), ("a.pdf", 52_428_801, "too_large"), ("a.html", 52_428_801, "too_large"),
    ("a.html", 10, "bad_extension"), ("A.DOCX", 10, None), ("a.doc", 10, None), ("a.tar.txt", 0, None),
    (".pdf", 10, "bad_extension"), ("unknown_file", 10, "bad_extension")])
def test_validation_golden(spark, name, size, expected):
    df = spark.createDataFrame([(name, size)], "f string, s long")
    assert df.select(T.validation_reason("s", "f").alias("r")).first()["r"] == expected


def test_doc_maps_to_docx(spark):
    df = spark.createDataFrame([("a.doc",), ("A.DOCX",), ("x.TXT",), ("y.pdf",)], "f string")
    assert [r[0] for r in df.select(T.document_type("f")).collect()] == ["docx", "docx", "txt", "pdf"]


@pytest.mark.parametrize("text,expected", [("", "unknown"), ("zzz", "unknown"), ("the and", "unknown"),
                                           ("THE LAND OF", "en"), ("information", "en")])
def test_language_golden(spark, text, expected):
    assert _one(spark, T.language_substring("v"), text) == expected


def test_language_token_mode_needs_whole_words(spark):
    assert _one(spark, T.language_token("v"), "information") == "unknown"
    assert _one(spark, T.language_token("v"), "the cat and the dog in a box") == "en"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="abé中x.,", min_size=0, max_size=4),
                          st.text(alphabet=WS_CHARS, min_size=1, max_size=3)), max_size=12))
def test_words_and_strip_match_python(spark, parts):
    s = "".join(parts)
    row = spark.createDataFrame([(s,)], "v string").select(T.words("v").alias("w"), T.py_strip("v").alias("s")).first()
    assert row["w"] == s.split()
    assert row["s"] == s.strip()


def test_iso_timestamp(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 3),), (dt.datetime(2024, 1, 1, 0, 3, 0, 5),)],
                               "t timestamp_ntz")
    got = [r[0] for r in df.select(T.iso_timestamp("t")).collect()]
    assert got == ["2024-01-01T00:03:00", "2024-01-01T00:03:00.000005"]
