"""Operator 2: removal of repeated passages by prefix-free parsing.

Every byte covered by a string of ``LENGTH`` (100) bytes that also starts earlier (smaller doc_id, or the same
document and an earlier start) is removed; strings never cross documents and are judged on the input.

Parse.  A trigger is a ``GRAM``-byte window whose rolling hash is the least of the ``LENGTH - GRAM + 1`` windows of
some string, so every string holds one, and equal strings hold the same one at the same offset.  The
starts whose string has trigger t form a run; the phrase of t reaches from the run's first start to the
end of its last string.  Phrases overlap so far that each string lies inside one phrase: the parse is only
needed to a depth of ``LENGTH`` bytes, and a phrase carries that much of what follows it.

Only phrases whose trigger text occurs more than once can hold a repeated string.  For those the
dictionary of distinct phrases is dealt out by trigger; a task sorts the dictionary's suffixes (to
``LENGTH`` bytes) and joins them with the phrases' occurrences into corpus order: each run of equal
strings keeps its earliest start and marks the others.

Data flow, all in blocks of about ``BLOCK_BYTES`` of text (documents at random):
1. a block parses its texts and sends each distinct trigger hash with its count to the hash's bucket;
2. a bucket tells every block which of its triggers occur more than once, and which very often;
3. a block, again, sends the first occurrence of every distinct repeated phrase to the trigger's bucket, and marks
   the later ones at once.  Strings of triggers with over ``HOT`` occurrences go by the hash of the
   string itself instead, so that no bucket has to hold a very common trigger's phrases;
4. a bucket sorts and marks (above);
5. a block cuts the marked bytes.
Rows between blocks are arrays of entries, summed per block first, so a passage in a third of all
documents is one entry a block.  The text is shuffled once; steps 1, 3 and 5 reuse that exchange.

Defined cases: null text = empty text; texts under 100 bytes lose nothing; null doc_ids come before all
others; rows that share a doc_id, or have none, are taken in one fixed order, so of repeated rows one
keeps its text; very long texts are parsed in segments; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

LENGTH = 100
GRAM = 24
BLOCK_BYTES = 8 << 20
BUCKETS_A_BLOCK = 2
HOT = 4096
_SEGMENT = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(2).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWER = [_U(pow(_BASE, 1 << j, 1 << 64)) for j in range(8)]


def _rolling(b: np.ndarray, length: int) -> np.ndarray:
    """64-bit polynomial hashes of all windows of ``length`` bytes, put together from windows of 1, 2, 4 .. bytes."""
    h, width = _TABLE[b], 1
    out, done = None, 0
    for j in range(length.bit_length()):
        if length >> j & 1:   # windows of ``done`` bytes so far, then ``width`` more
            n = len(h) - done
            out = h if out is None else out[:n] * _POWER[j] + h[done:]
            done += width
        if 2 * width <= length:
            h = h[:-width] * _POWER[j] + h[width:]
            width *= 2
    return out[:max(0, len(b) - length + 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def parse(buf: np.ndarray, first: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts in documents that stand one after another in ``buf`` (document i is
    ``buf[first[i]:first[i + 1]]``): first start, last start, and the hash of the trigger's text."""
    lo_all, hi_all, hash_all = [], [], []
    window = length - gram + 1
    ends = first[1:]
    for at in range(0, max(0, len(buf) - length + 1), _SEGMENT):
        seg = buf[at:at + _SEGMENT + length - 1]
        h = _rolling(seg, gram)
        low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
        w = 1
        while 2 * w <= window:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        if w < window:
            low = np.minimum(low[:len(low) - (window - w)], low[window - w:])
        trigger = (low & _U(0xFFFFFFFF)).astype(np.int64)
        n = len(trigger)
        cuts = np.concatenate([[0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1, first - at, ends - length + 1 - at])
        lo = np.unique(cuts[(cuts >= 0) & (cuts < n)])
        hi = np.append(lo[1:], n) - 1
        doc = np.searchsorted(first, lo + at, "right") - 1
        fits = lo + at + length <= ends[doc]
        lo_all.append(lo[fits] + at)
        hi_all.append(hi[fits] + at)
        hash_all.append(_mix(h[trigger[lo[fits]]]))
    if not lo_all:
        none = np.empty(0, np.int64)
        return none, none, none.astype(_U)
    return np.concatenate(lo_all), np.concatenate(hi_all), np.concatenate(hash_all)


class _Block:
    """The documents of one block in corpus order, one after another."""

    def __init__(self, part: pd.DataFrame):
        named = part["named"].to_numpy() == 1
        part = part.assign(doc_id=np.where(named, part["doc_id"].to_numpy(np.int64), np.iinfo(np.int64).min))
        part = part.iloc[np.lexsort((part["row_id"].to_numpy(), part["doc_id"].to_numpy(), named))]
        self.part = part
        self.doc_id = part["doc_id"].to_numpy(np.int64)
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.bytes = b"".join(texts)
        self.buf = np.frombuffer(self.bytes, np.uint8)

    def parsed(self, length: int, gram: int):
        return parse(self.buf, self.first, length, gram)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document number and start in it of positions of ``buf``."""
        doc = np.searchsorted(self.first, at, "right") - 1
        return doc, at - self.first[doc]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(20)) % _U(buckets)).astype(np.int64)


def _split(bucket: np.ndarray):
    """``(bucket, positions)`` for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(bucket[part[0]]), part


def _triggers(length: int, gram: int, buckets: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        h, n = np.unique(_Block(part).parsed(length, gram)[2], return_counts=True)
        n = np.minimum(n, 65535).astype("<u2")
        block = int(part["block"].iloc[0])
        rows = [(b, block, h[i].astype("<u8").tobytes(), n[i].tobytes()) for b, i in _split(_bucket(h, buckets))]
        return pd.DataFrame(rows, columns=["bucket", "from_block", "hashes", "counts"])
    return run


def _repeated(hot: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(b, "<u8") for b in part["hashes"]]
        names, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.frombuffer(b, "<u2") for b in part["counts"]]))
        kind = np.where(total > hot, 2, (total > 1).astype(int)).astype(np.uint8)[at]
        rows, edge = [], np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        for i, (block, h) in enumerate(zip(part["from_block"], hashes, strict=True)):
            k = kind[edge[i]:edge[i + 1]]
            some = k > 0
            if some.any():
                rows.append((block, h[some].tobytes(), k[some].tobytes()))
        return pd.DataFrame(rows, columns=["to_block", "hashes", "kinds"])
    return run


_ENTRY = "bucket long, kind int, from_block long, body binary, sizes binary, ids binary, docs binary, starts binary"
_PHRASE, _STRING, _MARK = 0, 1, 2


def _phrases(length: int, gram: int, buckets: int):
    def run(part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _ENTRY.split(", ")]
        if not len(part) or not len(told):
            return pd.DataFrame([], columns=columns)
        block = _Block(part)
        number = int(part["block"].iloc[0])
        lo, hi, h = block.parsed(length, gram)
        known = np.concatenate([np.frombuffer(b, "<u8") for b in told["hashes"]])
        kinds = np.concatenate([np.frombuffer(b, np.uint8) for b in told["kinds"]])
        order = np.argsort(known)
        known, kinds = known[order], kinds[order]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        kind = np.where(known[at] == h, kinds[at], 0)
        rows, zip_ = [], zstandard.ZstdCompressor(level=1)
        mark_lo, mark_hi = [], []

        def send(what: int, bucket: np.ndarray, bodies: list[bytes], at: np.ndarray) -> None:
            doc, start = block.place(at)
            for b, i in _split(bucket):
                body = b"".join([bodies[k] for k in i.tolist()])
                size = np.array([len(bodies[k]) for k in i.tolist()], "<u4")
                rows.append((b, what, number, zip_.compress(body), size.tobytes(), block.doc_id[doc[i]].astype("<i8").tobytes(),
                             doc[i].astype("<i4").tobytes(), start[i].astype("<i8").tobytes()))

        cold = np.flatnonzero(kind == 1)
        seen: dict[bytes, int] = {}
        data, fresh = block.bytes, []
        for i, a, b in zip(cold.tolist(), lo[cold].tolist(), hi[cold].tolist(), strict=True):
            if seen.setdefault(data[a:b + length], i) == i:
                fresh.append(i)
            else:
                mark_lo.append(a)
                mark_hi.append(b)
        if fresh:
            fresh_at = np.array(fresh)
            send(_PHRASE, _bucket(h[fresh_at], buckets), list(seen), lo[fresh_at])
        seen = {}
        first_at = []
        hot = kind == 2
        for a, b in zip(lo[hot].tolist(), hi[hot].tolist(), strict=True):
            for p in range(a, b + 1):
                name = hashlib.blake2b(data[p:p + length], digest_size=16).digest()
                if seen.setdefault(name, p) == p:
                    first_at.append(p)
                else:
                    mark_lo.append(p)
                    mark_hi.append(p)
        if first_at:
            names = list(seen)
            send(_STRING, _bucket(np.frombuffer(b"".join(names), "<u8")[::2], buckets), names, np.array(first_at))
        if mark_lo:
            a, b = np.array(mark_lo), np.array(mark_hi)
            doc, start = block.place(a)
            rows.append((number % buckets, _MARK, number, b"", (b - a + 1).astype("<u4").tobytes(), b"",
                         doc.astype("<i4").tobytes(), start.astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=columns)
    return run


def sorted_suffixes(body: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``body[s:s + length]`` and, in that order, which begin a run of equal ones.
    Starts whose string is unique by a 64-bit hash are left out: they are runs of one."""
    h = _rolling(body, length)[starts]
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[at] > 1)
    if not len(some):
        return some, np.empty(0, bool)
    strings = np.lib.stride_tricks.sliding_window_view(body, length)[starts[some]]
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{length}").ravel(), kind="stable")
    strings = strings[order]
    new = np.ones(len(order), bool)
    new[1:] = (strings[1:] != strings[:-1]).any(1)
    return some[order], new


def _later(rank: np.ndarray, ids: np.ndarray, block: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Entries that are not the earliest of their rank."""
    order = np.lexsort((start, doc, block, ids, rank))
    same = np.zeros(len(order), bool)
    same[1:] = rank[order][1:] == rank[order][:-1]
    return order[same]


def _resolve(length: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        marks: list[tuple[np.ndarray, ...]] = []
        for what in (_PHRASE, _STRING):
            rows = part[part["kind"] == what]
            if not len(rows):
                continue
            size = [np.frombuffer(b, "<u4").astype(np.int64) for b in rows["sizes"]]
            block = np.repeat(rows["from_block"].to_numpy(np.int64), [len(s) for s in size])
            size = np.concatenate(size)
            ids, docs, starts = (np.concatenate([np.frombuffer(b, t) for b in rows[c]]) for c, t in
                                 (("ids", "<i8"), ("docs", "<i4"), ("starts", "<i8")))
            data = b"".join(zstandard.ZstdDecompressor().decompress(b) for b in rows["body"])
            edge = np.concatenate([[0], np.cumsum(size)])
            words: dict[bytes, int] = {}
            name = np.array([words.setdefault(data[a:b], len(words)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
            later = _later(name, ids, block, docs, starts)
            if what == _STRING:
                marks.append((block[later], docs[later], starts[later], np.ones(len(later), np.int64)))
                continue
            # Later occurrences of a phrase go whole; the first ones stand for the dictionary.
            marks.append((block[later], docs[later], starts[later], size[later] - length + 1))
            first = np.ones(len(name), bool)
            first[later] = False
            first = np.flatnonzero(first)
            body = np.frombuffer(b"".join(data[edge[i]:edge[i + 1]] for i in first.tolist()), np.uint8)
            n = size[first] - length + 1
            begin = np.concatenate([[0], np.cumsum(size[first])[:-1]])
            owner = np.repeat(np.arange(len(first)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            order, new = sorted_suffixes(body, begin[owner] + offset, length)
            if len(order):
                rank = np.cumsum(new)
                who = first[owner[order]]
                at = starts[who] + offset[order]
                later = _later(rank, ids[who], block[who], docs[who], at)
                marks.append((block[who][later], docs[who][later], at[later], np.ones(len(later), np.int64)))
        rows = part[part["kind"] == _MARK]
        for b, s, d, t in zip(rows["from_block"], rows["sizes"], rows["docs"], rows["starts"], strict=True):
            doc = np.frombuffer(d, "<i4")
            marks.append((np.full(len(doc), b, np.int64), doc, np.frombuffer(t, "<i8"), np.frombuffer(s, "<u4").astype(np.int64)))
        out = []
        if marks:
            block, doc, start, count = (np.concatenate([m[i] for m in marks]) for i in range(4))
            for b, i in _split(block):
                d, lo, hi = _joined(doc[i], start[i], start[i] + count[i])
                out.append((b, d.astype("<i4").tobytes(), lo.astype("<i8").tobytes(), hi.astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["to_block", "docs", "low", "high"])
    return run


def _joined(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of one document joined, in order."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order].astype(np.int64), low[order], high[order]
    if not len(doc):
        return doc, low, high
    shift = doc * (int(high.max()) + 2)  # documents apart on one line
    reach = np.maximum.accumulate(high + shift)
    new = np.ones(len(doc), bool)
    new[1:] = low[1:] + shift[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], low[new], reach[last] - shift[new]


def _cut(length: int, keep_text: bool):
    def run(part: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        block = _Block(part) if len(part) else None
        doc, low, high = (np.concatenate([np.empty(0, np.int64), *[np.frombuffer(b, t) for b in marked[c]]]).astype(np.int64)
                          for c, t in (("docs", "<i4"), ("low", "<i8"), ("high", "<i8")))
        doc, low, high = _joined(doc, low, high + length - 1)
        edge = np.searchsorted(doc, np.arange((len(part)) + 1))
        rows = []
        for i in range(len(part)):
            text = block.bytes[block.first[i]:block.first[i + 1]]
            kept, at, removed = [], 0, 0
            for a, b in zip(low[edge[i]:edge[i + 1]].tolist(), high[edge[i]:edge[i + 1]].tolist(), strict=True):
                kept.append(text[at:a])
                removed += b - a
                at = b
            kept.append(text[at:])
            left = b"".join(kept)
            rows.append((len(text), removed, int(edge[i + 1] - edge[i]), hashlib.sha256(left).hexdigest(), left if keep_text else None))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        if block is not None:
            out["doc_id"] = np.where(block.part["named"].to_numpy() == 1, block.doc_id.astype(str).astype(object), None)
            out["row_id"] = block.part["row_id"].to_numpy()
        else:
            out["doc_id"], out["row_id"] = [], []
        return out if keep_text else out.drop(columns="kept")
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot: int = HOT,
                   keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, row_id`` of every document; with ``keep_text`` also
    ``kept``, the bytes that stay."""
    rows, row_id = C.numbered(docs.select("doc_id", "text"), "passage-rows")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = blocks * BUCKETS_A_BLOCK
    named = F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    dealt = rows.select(F.pmod(F.xxhash64(row_id), F.lit(blocks)).alias("block"), F.col(row_id).alias("row_id"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), named.alias("named"), "text")
    by_block = dealt.groupBy("block")
    triggers = by_block.applyInPandas(_triggers(length, gram, buckets), "bucket long, from_block long, hashes binary, counts binary")
    told = triggers.groupBy("bucket").applyInPandas(_repeated(hot), "to_block long, hashes binary, kinds binary")
    entries = by_block.cogroup(told.groupBy("to_block")).applyInPandas(_phrases(length, gram, buckets), _ENTRY)
    marks = entries.groupBy("bucket").applyInPandas(_resolve(length), "to_block long, docs binary, low binary, high binary")
    out = by_block.cogroup(marks.groupBy("to_block")).applyInPandas(_cut(length, keep_text), "n_bytes long, n_removed long, n_spans long, "
                                                                   "kept_sha256 string, " + "kept binary, " * keep_text + "doc_id string, row_id long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
