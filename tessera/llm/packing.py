"""Operator 3: mixture-controlled packing of token sequences.

Documents become token ids (a closing id after each) and wait in one queue per source.  Deficit
round-robin serves the queues: in every window of ``WINDOW`` sequences each source earns its target share of
the window's tokens and sends whole documents while its balance covers them; what is left over (or
overdrawn) goes on to the next window.  The served tokens form a stream that is cut at sequence ends.

The corpus is dealt at random into shards of about ``SHARD_TOKENS`` tokens that are packed in parallel (with
``in_order``, for an input whose order says what goes together, a shard is a run of that many tokens of
an input partition, the last one of a partition being shorter).  Queues stand in input order.  A
shard always drains its queues, so what each source is owed when a shard begins is known beforehand: the
prefix sum, over the shards before, of (target share x shard's tokens - source's tokens).  That is how
deficits cross partitions without any task waiting for another.  Target shares default to the
sources' shares of the corpus, the only ones that every document can be packed once under.

Sequences hold ``SEQUENCE`` tokens; what is left of a shard is cut into sequences whose lengths are powers
of two, which need no padding.

Defined cases: null text = empty text (its only id is the closing one); null source is a source of its
own; null doc_id is kept; repeated rows are packed each (``row_id`` tells them apart); an empty table gives
no pieces; a text of any length is one document; special-token strings are ordinary text; other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

SEQUENCE = 2048
WINDOW = 32
SHARD_TOKENS = 1 << 20
CLOSING_ID = 1
VOCABULARY = "word_bpe_49k.json"
_CACHE_WORDS = 400_000

_vocabularies: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: printable ones stand for themselves, the
    others take the code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


_LETTERS = _byte_letters()
_TAIL = ".,!?;:"


def _plain(stem: str) -> bool:
    """Letters only, below U+0250 and not U+0130: normal form and lower case work letter by letter there,
    and the vocabulary's splitter leaves the stem whole."""
    return stem.isalpha() and (stem.isascii() or (max(stem) < "\u0250" and "\u0130" not in stem))


def _pack_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _WordIds(dict):
    """Word -> its ids, encoded when first asked for.  A plain stem with or without marks behind it is two
    pieces for the splitter, so stems are encoded once for all spellings, by the model alone; any other
    word goes through the whole tokenizer."""

    def __init__(self, tok):
        super().__init__({"": b""})
        self.tok, self.stems = tok, {}

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(_TAIL)
        if stem and _plain(stem):
            low = stem.lower()
            ids = self.stems.get(low)
            if ids is None:
                letters = low if low.isascii() else "".join([_LETTERS[b] for b in low.encode()])
                ids = self.stems[low] = array("I", [t.id for t in self.tok.model.tokenize(letters)]).tobytes()
            if len(stem) < len(word):
                ids += self[word[len(stem):]]
        else:
            ids = array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def shrink(self) -> None:
        for cache in (self, self.stems):
            if len(cache) > _CACHE_WORDS:
                cache.clear()


def _words_of(path: str) -> _WordIds:
    """The words of a vocabulary file met so far; one per worker."""
    if path not in _vocabularies:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _vocabularies[path] = _WordIds(t)
    return _vocabularies[path]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as unsigned 32-bit integers, without the closing id.

    The vocabulary drops white space and never joins what it parts, so a text's ids are its words' ids
    in order, and each distinct word is encoded once while the cache lasts."""
    ids = _words_of(path)
    ids.shrink()
    return [b"".join(map(ids.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


def tokenise(docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``row_id, doc_id, source, n_tokens, ids, place`` (ids as unsigned 16-bit where they fit, else 32-bit; place: which
    run of about ``shard_tokens`` tokens, by input partition and inside it in input order)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = encode([t or "" for t in part["text"]], path)
        ids = [np.append(np.frombuffer(b, "<u4"), np.uint32(CLOSING_ID)) for b in ids]
        return pd.DataFrame({"row_id": part["row_id"], "doc_id": part["doc_id"], "source": part["source"],
                             "n_tokens": [len(a) for a in ids],
                             "ids": [(a.astype("<u2") if a.max() < 65536 else a).tobytes() for a in ids]})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, done = TaskContext.get().partitionId() << 16, 0
        for out in C.per_batch(run)(batches):
            upto = done + out["n_tokens"].cumsum()
            yield out.assign(place=first + (upto - out["n_tokens"]) // shard_tokens)
            done = int(upto.iloc[-1]) if len(out) else done
    docs, row_id = C.with_row_id(docs)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    # Ids pass Python as text: pandas would turn longs with nulls into doubles.
    return docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("string").alias("doc_id"), source.alias("source"), "text").mapInPandas(
        placed, "row_id long, doc_id string, source string, n_tokens long, ids binary, place long")


def _cuts(total: int, sequence: int) -> np.ndarray:
    """Sequence borders in a stream of ``total`` tokens: full ones, then powers of two."""
    full = total // sequence
    out = [np.arange(full + 1, dtype=np.int64) * sequence]
    at, rest = full * sequence, total % sequence
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            out.append(np.array([at]))
    return np.concatenate(out)


def serve_order(source: np.ndarray, tokens: np.ndarray, share: np.ndarray, owed: np.ndarray, window: int) -> np.ndarray:
    """Deficit round-robin in closed form: a document is sent in the first round whose credit
    (``owed`` + rounds x share x window) covers all of its source's tokens up to its own end; within a round
    sources take turns in order.  ``source`` holds indexes into ``share`` and ``owed``; documents stand in
    their queues' order.  Returns the documents' order of service."""
    upto = np.zeros(len(tokens))
    for s in range(len(share)):
        mine = source == s
        upto[mine] = np.cumsum(tokens[mine])
    rounds = np.maximum(1, np.ceil((upto - owed[source]) / np.maximum(share[source] * window, 1e-9) - 1e-9))
    return np.lexsort((np.arange(len(tokens)), source, rounds))


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, window: int = WINDOW,
         shard_tokens: int = SHARD_TOKENS, in_order: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row_id, source`` per piece.
    ``in_order``: shards are runs of the input's order instead of random."""
    table = C.materialise(tokenise(docs, path or vocabulary_path(), shard_tokens), "tokens")
    table = table.withColumn("source", F.coalesce("source", F.lit("")))
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    table = table.withColumn("shard", F.col("place") if in_order else F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(shards)))
    totals = table.groupBy("shard", "source").agg(F.sum("n_tokens").alias("tokens"))
    state = balances(totals, total).toDF("to_shard", "from_source", "share", "owed")
    span = sequence * window

    def run(part: pd.DataFrame, owed: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["source", "row_id"], kind="stable").reset_index(drop=True)
        owed = owed.sort_values("from_source")
        at = np.searchsorted(owed["from_source"].to_numpy(object), part["source"].to_numpy(object))
        n = part["n_tokens"].to_numpy(np.int64)
        order = serve_order(at, n, owed["share"].to_numpy(float), owed["owed"].to_numpy(float), span)
        part, n = part.iloc[order], n[order]
        stream = np.concatenate([np.frombuffer(b, "<u2" if len(b) == 2 * k else "<u4").astype("<u4")
                                 for b, k in zip(part["ids"], n, strict=True)])
        first = np.concatenate([[0], np.cumsum(n)])
        seqs = _cuts(len(stream), sequence)
        cuts = np.union1d(seqs, first)
        a, b = cuts[:-1], cuts[1:]
        doc = np.searchsorted(first, a, "right") - 1
        seq = np.searchsorted(seqs, a, "right") - 1
        view = memoryview(stream).cast("B")
        return pd.DataFrame({
            "doc_id": part["doc_id"].to_numpy(object)[doc], "start": a - first[doc], "length": b - a,
            "ids_crc32": [zlib.crc32(view[4 * i:4 * j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)],
            "doc_tokens": n[doc], "sequence_id": (int(owed["to_shard"].iloc[0]) << 32) + seq, "offset": a - seqs[seq],
            "row_id": part["row_id"].to_numpy()[doc], "source": part["source"].to_numpy(object)[doc]})
    return (table.select("shard", "row_id", "doc_id", "source", "n_tokens", "ids").groupBy("shard").cogroup(state.groupBy("to_shard"))
            .applyInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                                "offset long, row_id long, source string").withColumn("doc_id", F.col("doc_id").cast("long")))


def balances(totals: DataFrame, total: int, run_shards: int = 1024) -> DataFrame:
    """``shard, source, share, owed`` for each (shard, source) with tokens.

    owed = share x (all tokens of the shards before) - (the source's tokens of the shards before).  Both
    prefix sums run over runs of ``run_shards`` shards first and inside a run second, so no window holds
    more than the runs, or one run, of a source."""
    def before(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
        rows = rows.withColumn("_run", F.expr(f"shard DIV {run_shards}"))
        runs = rows.groupBy(*keys, "_run").agg(F.sum(value).alias("_v"))
        earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select(*keys, "_run", F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_head"))
        inside = Window.partitionBy(*keys, "_run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        return rows.join(runs, [*keys, "_run"]).withColumn(f"{value}_before", F.col("_head") + F.col("_in")).drop("_run", "_head", "_in")
    per_shard = before(totals.groupBy("shard").agg(F.sum("tokens").alias("all")).withColumn("_one", F.lit(1)), ["_one"], "all")
    shares = totals.groupBy("source").agg((F.sum("tokens") / F.lit(max(1, total))).alias("share"))
    own = before(totals, ["source"], "tokens").join(shares, "source").join(per_shard.select("shard", "all_before"), "shard")
    return own.select("shard", "source", "share", (F.col("share") * F.col("all_before") - F.col("tokens_before")).alias("owed"))
