"""Operator 11: best-fit packing of documents by exact-complement hashing.

Documents become token ids (a closing id after each).  Those longer than a sequence are cut into full sequences behind a
shorter first piece; nothing else is cut.  Pieces are packed into as few sequences as the method finds:

1. What can be packed with what depends on the pieces' lengths alone, so the plan is made from the number of pieces of
   each length: a table of at most ``SEQUENCE`` rows, whatever the corpus.
2. From the longest length down, a sequence's gap is filled exactly by one, two or three lengths, looked up in indexes of
   single lengths, pair sums and triple sums under the counts still available; where none does, the longest
   length that fits goes in and the smaller gap is looked up again.  A combination is used as often as its
   scarcest length allows, so each one uses up a length and there are few thousand of them.
3. Lengths that no combination completes are packed best-fit, longest first, counts at a time.  How many lengths may fill
   a gap is tried out (``fewest``); the shortest plan stays.
4. Every piece gets its number among the pieces of its length (a running count in its input partition plus the counts of
   the partitions before) and reads its sequence and place from the plan by binary search.  No piece waits
   for another and nothing but the counts is gathered.

Defined cases: null text = empty text (its only id is the closing one); a null doc_id is kept; repeated rows are packed
each (``row_id`` tells them apart); an empty table gives no pieces; a text of any length is one document;
special-token strings are ordinary text; ties between combinations go to the most plentiful, then the least length;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.packing import _LETTERS, _pack_ids, vocabulary_path

SEQUENCE = 2048
CLOSING_ID = 0
VOCABULARY = "byte_bpe_50k.json"
_CACHE_PARTS = 300_000

# Characters below U+0250 and common typographic marks, by the classes that the vocabulary's splitter knows.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_SPLIT = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ODD = re.compile("[^\x00-ɏ‐-‧€]")

_vocabularies: dict = {}


_ASCII = dict(enumerate(_LETTERS[:128]))


class _SplitIds(dict):
    """Part of a text, as the splitter gives it -> its ids, merged when first asked for.  Of the ``_CACHE_PARTS`` parts met
    before these, those met again are taken over, so frequent parts are merged once."""

    def __init__(self, tok):
        super().__init__()
        self.tok, self.before = tok, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            letters = part.translate(_ASCII) if part.isascii() else "".join([_LETTERS[b] for b in part.encode("utf-8")])
            ids = _pack_ids([t.id for t in self.tok.model.tokenize(letters)])
        if len(self) >= _CACHE_PARTS:
            self.before = dict(self)
            self.clear()
        self[part] = ids
        return ids


def _parts_of(path: str) -> _SplitIds:
    if path not in _vocabularies:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _vocabularies[path] = _SplitIds(t)
    return _vocabularies[path]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as unsigned 32-bit integers, without the closing id.  The vocabulary merges inside the parts of
    a text only, and parts recur; a text with a character beyond the classes above goes through the tokenizer whole."""
    ids = _parts_of(path)
    return [_pack_ids(ids.tok.encode(t, add_special_tokens=False).ids) if not t.isascii() and _ODD.search(t)
            else b"".join(map(ids.__getitem__, _SPLIT.findall(t))) for t in texts]


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """``row_id, doc_id, piece, start, length, ids_crc32, ids, part, nth``: the pieces of every document, and which of its
    input partition's pieces of that length each is (from 0).  ``ids`` is null unless ``keep_ids``."""
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row, doc, ids in zip(batch["row_id"], batch["doc_id"], encode([t or "" for t in batch["text"]], path), strict=True):
            ids += closing
            n = len(ids) // 4
            starts = [0] if n <= sequence else [*([0] if n % sequence else []), *range(n % sequence, n, sequence)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                own = ids[4 * a:4 * b]
                rows.append((row, doc, k, a, b - a, zlib.crc32(own), own if keep_ids else None))
        return pd.DataFrame(rows, columns=["row_id", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), np.zeros(sequence + 1, np.int64)
        for out in C.per_batch(cut)(batches):
            length = out["length"].to_numpy(np.int64)
            yield out.assign(part=part, nth=seen[length] + out.groupby("length").cumcount().to_numpy())
            seen += np.bincount(length, minlength=len(seen))
    docs, row_id = C.with_row_id(docs)
    # Ids pass Python as text: pandas would turn longs with nulls into doubles.
    return docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        counted, "row_id long, doc_id string, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


class _Gaps:
    """Which lengths fill a gap exactly, under the counts still available."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self._index()

    def _index(self) -> None:
        """Sums of one and of two lengths.  Counts only fall, so an old index names too much, never too little."""
        self.one = self.left > 0
        self.two = np.convolve(self.one, self.one.astype(np.int64))[:len(self.left)] > 0
        self.stale = 0

    def _pair(self, gap: int) -> list[int] | None:
        a = np.arange(1, gap // 2 + 1)
        both = np.minimum(self.left[a], self.left[gap - a])
        if gap % 2 == 0 and len(both):
            both[-1] = self.left[gap // 2] // 2
        best = int(both.argmax()) if len(both) else 0
        return [int(gap - a[best]), int(a[best])] if len(both) and both[best] > 0 else None

    def fill(self, gap: int, most: int) -> list[int] | None:
        """At most ``most`` (one to three) lengths that fill the gap."""
        if self.left[gap]:
            return [gap]
        if most > 1 and self.two[gap] and (pair := self._pair(gap)):
            return pair
        if most < 3:
            return None
        a = np.arange(1, gap - 1)
        a = a[(self.left[a] > 0) & self.two[gap - a]]
        for first in a[np.argsort(-self.left[a], kind="stable")].tolist():
            self.left[first] -= 1
            pair = self._pair(gap - first)
            self.left[first] += 1
            if pair:
                return [first, *pair]
        return None

    def take(self, use: Counter, times: int) -> None:
        for length, k in use.items():
            self.left[length] -= k * times
            self.stale += self.left[length] == 0
        if self.stale > 32:
            self._index()

    def longest(self, gap: int) -> int:
        fit = np.flatnonzero(self.left[:gap + 1])
        return int(fit[-1]) if len(fit) else 0


def combinations(counts: np.ndarray, most: int = 3, onwards: bool = True) -> list[tuple[Counter, int]]:
    """(lengths of a sequence with how often each, number of such sequences) that use up ``counts`` (by length, up
    to the length of a sequence).  A gap takes up to ``most`` lengths; with ``onwards`` a gap that nothing fills
    takes the longest length that fits and the gap behind it is tried."""
    size = len(counts) - 1
    gaps, rest, out = _Gaps(counts), np.zeros_like(counts), []
    while length := gaps.longest(size):
        use, gap, one = Counter(), size, length
        while one:
            use[one] += 1
            gaps.left[one] -= 1
            gap -= one
            done = gaps.fill(gap, most) if gap else []
            one = gaps.longest(gap) if done is None and onwards else 0
        for one, k in use.items():   # what was tried on goes back
            gaps.left[one] += k
        if done is None:
            rest[length], gaps.left[length] = gaps.left[length], 0
            gaps.stale += 1
            continue
        use.update(done)
        times = min(int(gaps.left[one]) // k for one, k in use.items())
        gaps.take(use, times)
        out.append((use, times))
    return out + _best_fit(rest)


def fewest(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """The shortest of three plans.  Combinations of many lengths leave little over where short pieces abound, and use up
    what long ones need where they don't."""
    plans = [combinations(counts, *how) for how in ((3, True), (2, False), (1, False))]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _best_fit(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """Best-fit, longest first: counts of pieces go into counts of equal sequences."""
    size = len(counts) - 1
    with_gap: dict[int, list[tuple[Counter, int]]] = {}
    open_at = np.zeros(size + 1, bool)

    def put(use: Counter, times: int) -> None:
        gap = size - sum(length * k for length, k in use.items())
        with_gap.setdefault(gap, []).append((use, times))
        open_at[gap] = True
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fit = np.flatnonzero(open_at[length:])
            if not len(fit):
                per = size // length
                if left >= per:
                    put(Counter({length: per}), left // per)
                if left % per:
                    put(Counter({length: left % per}), 1)
                break
            gap = length + int(fit[0])
            use, times = with_gap[gap].pop()
            open_at[gap] = bool(with_gap[gap])
            each = min(gap // length, -(-left // times))   # of these pieces into each such sequence
            n = min(times, left // each)
            put(use + Counter({length: each}), n)
            left -= n * each
            if n < times:
                put(use, times - n)
    return [group for groups in with_gap.values() for group in groups]


class Plan:
    """Where the nth piece of a length goes."""

    def __init__(self, counts: np.ndarray):
        rows, given, base = [], Counter(), 0
        for use, times in fewest(np.asarray(counts, np.int64)):
            at = 0
            for length, k in sorted(use.items(), reverse=True):
                rows.append((length, given[length], k, base, at))
                given[length] += k * times
                at += length * k
            base += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.sequences = base
        self.key = (table[:, 0] << 44) + table[:, 1]
        self.first, self.each, self.base, self.at = table[:, 1:].T

    def place(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        row = np.searchsorted(self.key, (length << 44) + nth, "right") - 1
        copy, slot = np.divmod(nth - self.first[row], self.each[row])
        return self.base[row] + copy, self.at[row] + slot * length


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, row_id`` per piece (and its ``ids`` with ``keep_ids``)."""
    table = C.materialise(pieces(docs, path or vocabulary_path(VOCABULARY), sequence, keep_ids), "pieces")
    parts = C.materialise(table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(sequence + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():   # one row a length
        counts[r.length] = r.n
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("head"))
    numbered = table.join(heads, ["part", "length"]).withColumn("nth", F.col("head") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        s, o = plan.value.place(length.to_numpy(np.int64), nth.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": s, "offset": o})
    out = numbered.withColumn("_at", placed("length", "nth"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset", "row_id", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` (unsigned 32-bit, little-endian) of ``pack(keep_ids=True)``: at most ``SEQUENCE`` pieces each."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    ids = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
