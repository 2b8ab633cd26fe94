"""Text expressions as Spark Columns (JVM side, no Python UDF).

Every helper returns a ``Column`` so Catalyst can fuse it into whole-stage code and push
projections down.  The regular expressions are written so that Java's engine (Spark) and
RE2 (the DuckDB oracle) read them the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Python's str.split() / str.strip() white space: U+0009-U+000D, U+001C-U+001F, U+0020,
# U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same set for Java's engine, in the form it matches fastest: Unicode white space and the four separators.
JAVA_WS = r"(?U)[\s\x1C-\x1F]"
# Largest accepted upload, bytes (equal passes).
MAX_FILE_SIZE = 52_428_800
# Accepted file extensions, compared lower-cased.
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".txt", ".doc"]
# Extension -> stored document type (".doc" goes to the DOCX reader).
EXTENSION_TYPES = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".txt": "txt"}
# English marker words of the language rule; "en" when at least 3 occur.
ENGLISH_MARKERS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
ENGLISH_MIN_MARKERS = 3
# ---------------------------------------------------------------------------------------

# Last-dot extension the way os.path.splitext finds it: leading dots of the base name do
# not start an extension, so ".pdf" has none.
SPLITEXT_PATTERN = r"^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$"
# Letters-and-digits runs, used by the whole-word language mode.
NON_WORD_PATTERN = r"[^\p{L}\p{N}]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """``text.split()``: array of non-empty white-space separated tokens."""
    # array_remove is a built-in (code-generated) expression, unlike a filter lambda.
    return F.array_remove(F.split(col_(text), JAVA_WS + "+"), "")


def word_count(text) -> Column:
    return F.size(words(text))


def py_strip(text) -> Column:
    """``str.strip()`` with Python's white-space set (``trim`` only strips U+0020)."""
    return F.regexp_replace(col_(text), rf"^{JAVA_WS}+|{JAVA_WS}+$", "")


def extension(filename) -> Column:
    """``os.path.splitext(name)[1]`` (may be ``''``)."""
    return F.regexp_extract(col_(filename), SPLITEXT_PATTERN, 1)


def document_type(filename) -> Column:
    """Stored type for an accepted extension, NULL otherwise."""
    ext = F.lower(extension(filename))
    expr = None
    for e, t in EXTENSION_TYPES.items():
        expr = (F.when(ext == e, F.lit(t)) if expr is None else expr.when(ext == e, F.lit(t)))
    return expr


def validation_reason(file_size, filename, max_size: int = MAX_FILE_SIZE) -> Column:
    """NULL when the upload is accepted; otherwise the first failing check.

    Size is tested before the extension, as the reference does.
    """
    ext = F.lower(extension(filename))
    return (F.when(col_(file_size) > F.lit(max_size), F.lit("too_large"))
            .when(~ext.isin(*ALLOWED_EXTENSIONS), F.lit("bad_extension")))


def mime_from_magic(content) -> Column:
    """Report-only MIME guess from the first bytes (never used to accept or reject)."""
    head = F.hex(F.substring(col_(content), 1, 4))
    return (F.when(head == "25504446", F.lit("application/pdf"))
            .when(head == "504B0304", F.lit("application/zip"))
            .when(head.startswith("D0CF11E0"), F.lit("application/msword"))
            .otherwise(F.lit("text/plain")))


def language_substring(text) -> Column:
    """Reference rule: count marker words that occur as *substrings* of the lower-cased text."""
    low = F.lower(col_(text))
    hits = sum(F.contains(low, F.lit(m)).cast("int") for m in ENGLISH_MARKERS)
    return F.when(F.coalesce(hits, F.lit(0)) >= ENGLISH_MIN_MARKERS, F.lit("en")).otherwise(F.lit("unknown"))


def language_token(text) -> Column:
    """Whole-word variant: count distinct marker words present as tokens."""
    toks = F.split(F.lower(col_(text)), NON_WORD_PATTERN)
    markers = F.array(*[F.lit(m) for m in ENGLISH_MARKERS])
    hits = F.size(F.array_intersect(markers, toks))
    return F.when(F.coalesce(hits, F.lit(0)) >= ENGLISH_MIN_MARKERS, F.lit("en")).otherwise(F.lit("unknown"))


def iso_timestamp(ts) -> Column:
    """``datetime.isoformat()``: seconds always, microseconds only when non-zero."""
    c = col_(ts)
    micros = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(
        micros == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
