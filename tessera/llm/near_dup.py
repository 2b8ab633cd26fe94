"""Operator 1: n-gram Jaccard join by MinHash banding.

A document is the set of its word 5-grams (words are separated by white space; a text of one to four
words is one gram).  Two documents link when the Jaccard similarity of their sets is at least 0.8.

1. Equal sets become one representative; only representatives go on.
2. MinHash signatures are cut into bands whose count and rows ``bands_for`` picks for a target recall
   at the threshold; (band, hash) rows are shuffled and counted, which gives the candidates: documents that
   share a band.
3. Each document lives in a home with the others of its fullest bucket and goes, as a guest, to the homes of
   its other band mates; which of two homes receives the other's documents is fixed, so a pair of mates
   meets once.  Documents that only hang together over a chain of mates do not meet.
4. A task holds one home (about ``BLOCK_ROWS`` documents, fewer if they are long) and one part of its guests and
   compares full gram sets (64-bit hashes of the grams).  It counts the links of its documents and returns one
   row a document (count, smallest document it hangs with), never the pairs.
5. Components over verified links give the classes.

Defined cases: a null or wordless text has no grams, links with nothing and is its own class; null
doc_ids come last when a class picks its smallest id (all null: class id null, one row is kept); repeated
rows and copies link with each other and count as links; a text of any length is compared whole, and a home
holds fewer documents the longer they are; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 160
BLOCK_ROWS = 256
UNIT_GRAMS = 1024
_U = np.uint64


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding, i.e. most rows a band, that finds a pair at the
    threshold with probability ``recall`` using at most ``max_hashes`` hashes."""
    best = (max_hashes, 1)
    for rows in range(1, 17):
        hit = threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _WordHashes()


def grams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""
    split = (text or "").split()
    if not split:
        return np.empty(0, _U)
    w = np.fromiter(map(_words.__getitem__, split), _U, len(split))
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, _U)
    for i in range(n):
        h = _mix(h + w[i:len(w) - n + 1 + i] * _U(2 * i + 0x9E3779B97F4A7C15))
    return np.unique(h)


def _signer(bands: int, rows: int):
    rng = np.random.default_rng(1)
    mul = rng.integers(0, 2**63, bands * rows, dtype=_U) * _U(2) + _U(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=_U)

    def sign(g: np.ndarray) -> np.ndarray:
        low = np.full(bands * rows, np.iinfo(_U).max, _U)
        for i in range(0, len(g), 2048):
            low = np.minimum(low, (g[i:i + 2048, None] * mul + add).min(0))
        h = np.arange(bands, dtype=_U)
        for column in low.reshape(bands, rows).T:
            h = _mix(h * _U(0x9E3779B97F4A7C15) + column)
        return h.view(np.int64)
    return sign


def signatures(docs: DataFrame, row_id: str, threshold: float, recall: float) -> DataFrame:
    """``row_id, doc_id, set_key, n_grams, bands`` of every document."""
    sign = _signer(*bands_for(threshold, recall))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sets = [grams(t) for t in part["text"]]
        return pd.DataFrame({"row_id": part["row_id"], "doc_id": part["doc_id"],
                             "set_key": [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in sets],
                             "n_grams": [len(g) for g in sets], "bands": [sign(g) if len(g) else [] for g in sets]})
    return docs.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        C.per_batch(run), "row_id long, doc_id string, set_key binary, n_grams int, bands array<long>").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``sets[left]`` with ``sets[right]``, by products of 0/1 matrices over
    slices of the grams that occur at least twice."""
    size = np.array([len(s) for s in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    twice = count[gram] > 1
    gram, row = (np.cumsum(count > 1) - 1)[gram[twice]], row[twice]
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for i in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        a, b = np.searchsorted(gram, [i, i + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], gram[a:b] - i] = 1
        out += m[left] @ m[right].T
    return out


def _verify(threshold: float):
    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = rows.iloc[a:b]
            ids, lives = part["row_id"].to_numpy(), part["lives"].to_numpy()
            own, guest = np.flatnonzero(lives), np.flatnonzero(~lives)
            # a home's own documents meet each other in its first part only
            right = np.arange(len(part)) if part["part"].iloc[0] == 0 else guest
            if not len(own) or not len(right):
                continue
            sets = [np.frombuffer(g, _U) for g in part["grams"]]
            size = np.array([len(s) for s in sets], float)
            inter = _common(sets, own, right)
            union = size[own][:, None] + size[right][None] - inter
            linked = inter >= threshold * union - 1e-6
            linked &= own[:, None] != right[None]
            weight = part["copies"].to_numpy(np.int64)
            count = np.zeros(len(part), np.int64)
            count[own] += linked @ weight[right]
            visiting = ~lives[right]
            count[guest] += linked[:, visiting].T @ weight[own]
            i, j = np.nonzero(linked)
            near = C.local_components(len(part), own[i], right[j])
            # local_components gives the smallest position: rows are sorted by row_id
            keep = (count > 0) | (near < np.arange(len(part)))
            out.append(pd.DataFrame({"row_id": ids[keep], "links": count[keep], "low": ids[near][keep]}))
        return pd.concat(out) if out else pd.DataFrame({"row_id": [], "links": [], "low": []}).astype("int64")
    return run


def homes(reps: DataFrame, block_rows: int) -> DataFrame:
    """``row_id, home, visits``: where each representative that has band mates lives, and the homes of its
    mates that it goes to.

    A document lives with its fullest bucket.  Homes hold ``block_rows`` documents on average (a document counts
    once for every ``UNIT_GRAMS`` grams it has): buckets share homes by their hash, and a bucket that
    fills a home is split over homes of its own.  Of two homes with band mates in each other, one (by the
    parity of a hash of the two) receives the other's documents, so every pair of band mates meets
    once.  A document goes at most to the homes of its mates, however those hang together with others."""
    banded = reps.select("row_id", "weight", F.explode(F.array_distinct("bands")).alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mates = C.materialise(banded.join(shared, "band").select("row_id", "weight", "band", "n"), "band-mates")
    top = F.max(F.struct("n", "band")).alias("top")
    tops = C.materialise(mates.groupBy("row_id").agg(F.first("weight").alias("weight"), top).select("row_id", "weight", "top.band"), "tops")
    living = C.materialise(tops.groupBy("band").agg(F.sum("weight").alias("w")), "living")
    n_homes = max(1, -(-(living.agg(F.sum("w")).first()[0] or 0) // block_rows))
    split = F.ceil(F.col("w") / F.lit(block_rows))
    of_its_own = F.xxhash64("band", F.pmod(F.xxhash64("row_id", F.lit(7)), split))
    lives = tops.join(living, "band").select("row_id", F.when(split > 1, of_its_own).otherwise(F.pmod(F.xxhash64("band"), F.lit(n_homes))).alias("home"))
    lives = C.materialise(lives, "homes")
    placed = C.materialise(mates.select("row_id", "band").join(lives, "row_id"), "placed")
    in_band = placed.select("band", "home").distinct().groupBy("band").agg(F.collect_list("home").alias("homes"))
    seen = placed.join(in_band, "band").groupBy("row_id", "home").agg(F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes"))

    def goes(h):
        even = F.pmod(F.xxhash64(F.least(F.col("home"), h), F.greatest(F.col("home"), h)), F.lit(2)) == 0
        return (h != F.col("home")) & ((F.col("home") < h) == even)
    return C.materialise(seen.select("row_id", "home", F.filter("homes", goes).alias("visits")), "visits")


def places(reps: DataFrame, block_rows: int) -> DataFrame:
    """``row_id, home, part, lives`` of every representative with band mates: the places where it is compared.
    A home's guests are dealt into parts of about ``block_rows``; its own documents go to each part."""
    where = homes(reps, block_rows).join(reps.select("row_id", "weight"), "row_id")
    guests = where.select("row_id", "weight", F.explode("visits").alias("home"))
    parts = guests.groupBy("home").agg(F.ceil(F.sum("weight") / F.lit(block_rows)).cast("int").alias("parts"))
    parts = C.materialise(parts, "parts")
    at = F.pmod(F.xxhash64("row_id", F.lit(11)), F.col("parts")).cast("int")
    stays = where.select("row_id", "home").join(parts, "home", "left").select(
        "row_id", "home", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(True).alias("lives"))
    return stays.unionByName(guests.join(parts, "home").select("row_id", "home", at.alias("part"), F.lit(False).alias("lives")))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block_rows: int = BLOCK_ROWS,
         row_id: str | None = None) -> DataFrame:
    """``row_id, doc_id, class_id, n_links, class_size, kept`` of every document."""
    if row_id is None:
        docs, row_id = C.numbered(docs.select("doc_id", "text"), "near-rows")
    signed = C.materialise(signatures(docs, row_id, threshold, recall), "signatures")
    sets = C.materialise(C.equal_groups(signed.drop("bands"), ["set_key"], "row_id", "doc_id"), "sets")
    weight = F.ceil(F.col("n_grams") / F.lit(UNIT_GRAMS)).cast("long")
    reps = C.materialise(sets.where("row_id = keep_row AND n_grams > 0").select("row_id", F.col("group_size").alias("copies"), weight.alias("weight"))
                         .join(signed.select("row_id", "bands"), "row_id"), "representatives")
    dealt = places(reps, block_rows).groupBy("row_id").agg(
        F.collect_list("home").alias("homes"), F.collect_list(F.when(F.col("lives"), F.col("part")).otherwise(-1 - F.col("part"))).alias("parts"))
    dealt = C.materialise(dealt.join(reps.select("row_id", "copies"), "row_id"), "places")

    def gram_sets(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(grams=[grams(t).tobytes() for t in part["text"]]).drop(columns="text")
    # One join at every size: the planner would broadcast the places of a small corpus only.
    texts = docs.select(F.col(row_id).alias("row_id"), "text").join(dealt.hint("merge"), "row_id")
    full = texts.select("row_id", "text", "copies", "homes", "parts").mapInPandas(
        C.per_batch(gram_sets), "row_id long, copies long, homes array<long>, parts array<int>, grams binary")
    full = full.select("row_id", "copies", "grams", F.explode(F.arrays_zip("homes", "parts")).alias("at"))
    part = F.col("at.parts")
    full = full.select("row_id", "copies", "grams", F.col("at.homes").alias("home"), F.when(part < 0, -1 - part).otherwise(part).alias("part"), (part >= 0).alias("lives"))
    keys = ["home", "part"]
    checked = (full.repartition(*keys).sortWithinPartitions(*keys, "row_id")
               .mapInPandas(C.whole_groups(keys, _verify(threshold)), "row_id long, links long, low long"))
    checked = C.materialise(checked, "verified")
    classes = C.connected_components(checked.where("row_id <> low").select(F.col("row_id").alias("a"), F.col("low").alias("b")), "classes")
    return _result(sets, checked, classes)


def _result(sets: DataFrame, checked: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts and classes of the representatives, carried to every row of ``sets``."""
    links = checked.groupBy("row_id").agg(F.sum("links").alias("links"))
    linked = C.materialise(classes.join(links, classes["node"] == links["row_id"]).select("node", "component", "links"), "linked")
    heads = sets.where("row_id = keep_row").select("keep_row", "keep_id", "group_size")
    grouped = linked.join(heads, linked["node"] == heads["keep_row"])
    order = F.coalesce("keep_id", F.lit(C.MAX_LONG))
    total = C.materialise(grouped.groupBy("component").agg(F.min("keep_id").alias("class_id"), F.min_by("node", order).alias("class_row"),
                                                           F.sum("group_size").alias("class_size")), "class-totals")
    per_rep = C.materialise(linked.join(total, "component").select(F.col("node").alias("keep_row"), "links", "class_id", "class_row", "class_size"), "rep-classes")
    out = sets.join(per_rep, "keep_row", "left")
    some = F.col("n_grams") > 0
    alone = F.when(some, F.col("keep_id")).otherwise(F.col("doc_id"))
    mine = F.when(some, F.coalesce("class_row", "keep_row")).otherwise(F.col("row_id"))
    in_class = F.col("class_row").isNotNull()
    return out.select("row_id", "doc_id", F.when(in_class, F.col("class_id")).otherwise(alone).alias("class_id"),
                      F.when(some, F.col("group_size") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                      F.when(some, F.coalesce("class_size", "group_size")).otherwise(1).cast("long").alias("class_size"),
                      (F.col("row_id") == mine).alias("kept"))
