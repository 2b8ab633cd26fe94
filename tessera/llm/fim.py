"""Operator 12: fill-in-the-middle transformation at line borders.

A text's lines (each with its line feed; the last one may lack it) are cut after the lower and the higher of two
line counts that a seeded hash of the document id names; prefix, middle and suffix are rearranged as

    psm   <P>prefix<S>suffix<M>middle          spm   <S>suffix<P>prefix<M>middle

or the text stays as it is (plain).  The offsets at which lines end are kept in a ``BoundarySet``: containers for every
2^16 offsets, each an array of offsets, a bitmap or a list of runs, whichever is smallest, with the cumulative
cardinalities of the containers.  "Where does line k end" is a search over the cardinalities and a select
inside one container.  Offsets count code points.  A row's result depends on that row alone: one narrow pass.

Defined cases: null text = empty text (plain, no lines); a text that contains one of the marks is plain; a null doc_id is
kept and hashed as the empty string; repeated rows each give their row; an empty table gives no rows; a text of any
length is cut and rebuilt whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

MARKS = ("<P>", "<S>", "<M>")
SEED = 7
RATE = 100          # of 100 texts that are rearranged
SPM = 50            # of 100 rearranged texts in the spm form
_HIGH, _LOW = 16, (1 << 16) - 1


class _Array:
    """At most a few values: themselves."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype("<u2")

    @staticmethod
    def size_of(low: np.ndarray) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class _Bitmap:
    """Many scattered values: a bit each, and the values before every 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))])

    @staticmethod
    def size_of(low: np.ndarray) -> int:
        return (1 << 13) + 2 * (1 << 10)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


class _Runs:
    """Values that follow each other: where each run begins, and the values before it."""

    def __init__(self, low: np.ndarray):
        new = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.first, self.before = low[new].astype("<u2"), np.append(new, len(low))

    @staticmethod
    def size_of(low: np.ndarray) -> int:
        return 4 * int(np.count_nonzero(np.diff(low, prepend=-2) != 1))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


class BoundarySet:
    """A sorted set of offsets that answers which is its k-th."""

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, np.int64)
        new = np.flatnonzero(np.diff(offsets >> _HIGH, prepend=-1))
        self.high = offsets[new] >> _HIGH
        self.before = np.append(new, len(offsets))
        self.containers = [min((_Array, _Runs, _Bitmap), key=lambda kind: kind.size_of(low))(low)  # noqa: B023
                           for low in np.split(offsets & _LOW, new[1:])] if len(offsets) else []

    def __len__(self) -> int:
        return int(self.before[-1]) if len(self.before) else 0

    def select(self, k: int) -> int:
        """The offset with ``k`` smaller ones in the set."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.high[at]) << _HIGH) + self.containers[at].select(k - int(self.before[at]))


def line_ends(text: str) -> BoundarySet:
    """Where the lines of a text end."""
    if text.isascii():
        points = np.frombuffer(text.encode(), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] < len(points)):
        ends = np.append(ends, len(points))
    return BoundarySet(ends)


def draws(doc_id: str | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that a document's id decides."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in range(0, 32, 8))  # type: ignore[return-value]


def transform(text: str | None, doc_id: str | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, code points of the prefix, of the middle, output)."""
    text = text or ""
    ends = line_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``transform`` rearranged: the parts hold no marks, so the first of each is the real one."""
    if form == "plain":
        return output
    first, second, last = MARKS if form == "psm" else (MARKS[1], MARKS[0], MARKS[2])
    if not output.startswith(first):
        raise ValueError(f"not a text in the form {form}")
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(last, 1)
    return one + middle + two if form == "psm" else two + middle + one


def apply(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, restored`` of every document."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = [transform(t, i, seed, rate, spm) for i, t in zip(part["doc_id"], part["text"], strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        for c in ("prefix_chars", "middle_chars"):
            out[c] = out[c].astype("Int64")
        return out.assign(doc_id=part["doc_id"].to_numpy(), restored=[restore(o, f) for _, f, _, _, o in rows])
    # Ids pass Python as text: pandas would turn longs with nulls into doubles.
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        C.per_batch(run), "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string, restored string").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def digests(transformed: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                              F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
  ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b FROM h),
p AS (SELECT *, coalesce(list_aggregate(ls[1:a], 'string_agg', ''), '') AS pre, coalesce(list_aggregate(ls[a + 1:b], 'string_agg', ''), '') AS mid,
  coalesce(list_aggregate(ls[b + 1:n], 'string_agg', ''), '') AS suf, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100
  THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
