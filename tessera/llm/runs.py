"""Operator 13: periodic runs of words, caught online over dyadic blocks.

A run is a stretch of consecutive words with smallest period q and at least ``max(MIN_WORDS, MIN_POWER * q)`` words that
neither neighbour extends.  ``Catchers`` takes a text's words slice by slice:

1. At every scale w = 1, 2, 4, ... each completed block of w words (they begin at multiples of w) is a catcher for
   the periods from w to 2 w - 1.  An appended word completes one suffix window of w words at each scale, and exactly
   one catcher watches that window: the block that begins w to 2 w - 1 words before it.  The windows of a
   whole slice advance together, as array operations on hashes that double from scale to scale.
2. A window that equals its catcher's block is a repetition with the distance as period.  Comparing words to the left
   of the two and onwards to the right gives the longest stretch with that period; a stretch that reaches the
   last word stays open and grows with the words appended later.  A run of three periods holds a whole block of
   its scale and that block's copy one period later, so none escapes.
3. Matches inside a stretch already known are the same run and are merged into it, as are those of multiples of
   a period (they give the same stretch; the smallest period names it).

Many short texts go through one sequence, parted by words that occur once; a long one alone, in slices.  A
document's result depends on its row alone, so there is no shuffle.

Defined cases: null text = empty text (no words, no runs; the digests are those of the empty string); a null doc_id is
kept, and ``repeat_some`` leaves its words alone; repeated rows each give their row; an empty table gives no rows; a
text of any length is searched whole (memory: a few numbers a word); ties for the greatest exponent go to the
smallest start, then the smallest period; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

MIN_WORDS = 24
MIN_POWER = 3
SLICE_WORDS = 1 << 16
_U = np.uint64


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of two equally long arrays are equal; looks at growing slices."""
    at, step = 0, 16
    while at < len(a):
        same = a[at:at + step] == b[at:at + step]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + step, step * 4
    return len(a)


class Catchers:
    """The runs of a sequence of word numbers that is appended slice by slice."""

    def __init__(self, min_words: int = MIN_WORDS, min_power: int = MIN_POWER, longest: int | None = None):
        if min_power < 3:
            raise ValueError("a run of less than three periods need not hold a whole block and its copy")
        self.min_words, self.min_power = min_words, min_power
        self.longest = longest                        # no part of the sequence with runs is longer
        self.words = np.empty(0, np.int64)
        self.open: dict[tuple[int, int], int] = {}    # (start, period) of stretches that reach the end
        self.found: dict[tuple[int, int], int] = {}   # (start, end) -> smallest period

    def append(self, words: np.ndarray) -> None:
        before, self.words = len(self.words), np.concatenate([self.words, np.asarray(words, np.int64)])
        n = len(self.words)
        last: dict[int, tuple[int, int]] = {}
        still, self.open = self.open, {}
        for start, q in still:
            end = before + _matching(self.words[before:], self.words[before - q:n - q])
            last[q] = self._note(start, end, q)
        reach = min(n, self.longest or n)
        scale, w = 0, 1
        while self.min_power * w <= reach:
            self._watch(scale, w, before, last)
            scale, w = scale + 1, 2 * w

    def _watch(self, scale: int, w: int, before: int, last: dict[int, tuple[int, int]]) -> None:
        """Compare every window of ``w`` words that ends in the new part with its catcher's block."""
        n = len(self.words)
        first = max(w, before - w + 1)
        if first > n - w:
            return
        base = max(0, (first // w - 1) * w)
        h = self.words[base:].astype(_U)
        for k in range(scale):
            half = 1 << k
            h = (h[:-half] * _U(0x9E3779B97F4A7C15) ^ (h[half:] >> _U(29))) * _U(0xBF58476D1CE4E5B9) + h[half:]
        windows = np.arange(first, n - w + 1)
        blocks = (windows // w - 1) * w
        hit = np.flatnonzero(h[windows - base] == h[blocks - base])
        if len(hit) > 32 and self.found:
            hit = hit[~self._covered(blocks[hit], windows[hit] + w, w)]
        for b, j in zip(blocks[hit].tolist(), windows[hit].tolist(), strict=True):
            q = j - b
            s, e = last.get(q, (0, 0))
            if s <= b and j + w <= e:
                continue
            after = _matching(self.words[j:], self.words[b:n - q])
            if after < w:   # equal hashes of different words
                continue
            back = _matching(self.words[:b][::-1], self.words[q:j][::-1])
            last[q] = self._note(b - back, j + after, q)

    def _covered(self, start: np.ndarray, end: np.ndarray, w: int) -> np.ndarray:
        """Which stretches lie in a known run of a period up to ``w``: their period is a multiple of its period."""
        known = sorted((s, e) for (s, e), p in self.found.items() if p <= w)
        if not known:
            return np.zeros(len(start), bool)
        s, e = np.array(known).T
        return np.maximum.accumulate(e)[np.maximum(np.searchsorted(s, start, "right") - 1, 0)] >= np.where(start >= s[0], end, np.iinfo(np.int64).max)

    def _note(self, start: int, end: int, q: int) -> tuple[int, int]:
        if end == len(self.words):
            self.open[start, q] = end
        if end - start >= max(self.min_words, self.min_power * q):
            self.found[start, end] = min(q, self.found.get((start, end), q))
        return start, end

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of what has been appended, by start, then period."""
        n, ends = len(self.words), {}
        for (s, e), q in self.found.items():
            # a stretch noted at the end of an earlier slice has either grown or was closed there
            if e == n or not self._grows(s, e, q):
                ends[s, e] = q
        return sorted((s, e - s, q) for (s, e), q in ends.items())

    def _grows(self, s: int, e: int, q: int) -> bool:
        return self.words[e] == self.words[e - q]


def runs_of(words: np.ndarray, slice_words: int = SLICE_WORDS, **options) -> list[tuple[int, int, int]]:
    """The runs of one sequence, appended in slices."""
    catchers = Catchers(**options)
    for i in range(0, len(words), slice_words):
        catchers.append(words[i:i + slice_words])
    return catchers.runs()


def split_words(text: str | None) -> list[bytes]:
    """The words between blanks and the control characters 9 to 13 (and no other white space), as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeat_some(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """A tenth of the documents, by their id, repeat a part of theirs up to the end; the others stay as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * (-(-(n - a) // len(part))))[:n - a]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def runs_of_all(texts: list[list[bytes]], slice_words: int = SLICE_WORDS, **options) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words.  Short lists share a sequence; a word that occurs once parts them."""
    out: list[list[tuple[int, int, int]]] = []
    at = 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) < slice_words:
            size += len(texts[upto]) + 1
            upto += 1
        numbers = _Numbers()
        parts, starts, n = [], [], 0
        for k, words in enumerate(texts[at:upto]):
            starts.append(n)
            parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([-1 - k])]
            n += len(words) + 1
        group: list[list[tuple[int, int, int]]] = [[] for _ in starts]
        longest = max(map(len, texts[at:upto]))
        for s, length, q in runs_of(np.concatenate(parts), slice_words, longest=longest, **options):
            k = int(np.searchsorted(starts, s, "right")) - 1
            group[k].append((s - starts[k], length, q))
        out += group
        at = upto
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stay when each run keeps its first period only."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


_SCHEMA = "row_id long, doc_id string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find(docs: DataFrame, repeated: bool = False, row_id: str | None = None, min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> DataFrame:
    """``row_id, doc_id, runs, collapsed`` (the text without the repetitions) of every document; ``repeated`` plants
    repetitions first (``repeat_some``)."""
    if row_id is None:
        docs, row_id = C.with_row_id(docs)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        words = [split_words(t) for t in part["text"]]
        if repeated:
            words = [repeat_some(w, i) for w, i in zip(words, part["doc_id"], strict=True)]
        runs = runs_of_all(words, min_words=min_words, min_power=min_power)
        return pd.DataFrame({"row_id": part["row_id"], "doc_id": part["doc_id"],
                             "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in mine] for mine in runs],
                             "collapsed": [b" ".join(collapse(w, mine)).decode("utf-8", "surrogatepass") for w, mine in zip(words, runs, strict=True)]})
    # Ids pass Python as text: pandas would turn longs with nulls into doubles.
    return docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        C.per_batch(run), _SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period (ties: smallest start, then period)."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def summarise(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of ``find``'s rows."""
    def better(a, b):
        # lengths and periods are word counts of one text: their products fit a long
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        first = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))
        return F.when((x > y) | ((x == y) & first), a).otherwise(b)
    top = F.when(F.size("runs") > 0, F.aggregate(F.col("runs"), F.get("runs", F.lit(0)), better))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumn("_top", top)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "_top.start", "_top.length", "_top.period",
                      F.expr("_top.length * 1000 DIV _top.period").alias("exponent_milli"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
