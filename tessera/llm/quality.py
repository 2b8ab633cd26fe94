"""Operator 7: quality classifier.

Histogram gradient-boosted trees over statistics of a text, flattened into arrays and walked
with numpy.  Labels of rows with ``crc32(doc_id as text) % 5 <> 0`` train the model, the others are
held out.  The fit uses at most ``MAX_TRAIN_ROWS`` labelled rows (those with the smallest hash of the
id); scoring reads every row and whole texts.  Inputs of a score come from the text alone.

Defined cases: a null text counts as empty and is scored like any other (all statistics 0); a null
doc_id is held out (it has no remainder) and is scored; label rows that are null, or name a document
twice with different labels, are left out of the fit; no usable label: every score is 0.5-like
(the smoothed share of label 1 among none); repeated rows are scored each; texts are read
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import gbt

MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".", "comma": b",;:", "exclaim": b"!", "question": b"?",
    "bar": b"|", "mark": b"#$%&*+=@^~_\\/<>", "bracket": b"()[]{}", "quote": b"\"'`-", "high": bytes(range(128, 256)),
}
_MAP = np.zeros((256, len(_CLASSES)))
for _i, _v in enumerate(_CLASSES.values()):
    _MAP[list(_v), _i] = 1
_STEP = 1 << 20
FEATURES = [*(f"{c}_share" for c in _CLASSES), "log_bytes", "log_words", "word_length", "distinct_words", "top_word",
            "top_bigram_repeat", "log_lines", "line_length", "distinct_lines", "byte_entropy", "longest_word", "comma_per_stop"]


def _bytes(b: bytes) -> np.ndarray:
    a = np.frombuffer(b, np.uint8)
    out = np.zeros(256)
    for i in range(0, len(a), _STEP):  # bincount widens its input: keep it small for very long texts
        out += np.bincount(a[i:i + _STEP], minlength=256)
    return out


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    b = text.encode("utf-8", "surrogatepass")
    h = _bytes(b)
    n = len(b)
    kinds = h @ _MAP
    words = text.split()
    count = Counter(words)
    w = max(1, len(words))
    lines = text.split("\n")
    p = h[h > 0] / n
    same_next = sum(map(str.__eq__, words, words[1:])) / w
    return [*(kinds / n), np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / w, len(count) / w,
            max(count.values(), default=0) / w, same_next, np.log1p(len(lines)), n / len(lines),
            len(set(lines)) / len(lines), float(-(p * np.log2(p)).sum()),
            min(max(map(len, count), default=0), 1000), kinds[6] / (kinds[5] + 1)]


def statistics_of(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))


def training_labels(labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``(doc_id, quality)`` of the labelled rows that may train, at most ``max_rows``."""
    one = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
           .where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
           .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_max"))
           .where("quality = _max").drop("_max"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> gbt.Trees:
    """Fit the trees on the bounded sample.  The sample's ids (at most ``max_rows``) are broadcast to
    the scan; statistics are computed there, and only they come to the driver."""
    def rows(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i:i + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "quality": part["quality"],
                                    "x": list(statistics_of(part["text"]))})
    picked = docs.select("doc_id", "text").join(F.broadcast(training_labels(labels, max_rows)), "doc_id")
    got = picked.mapInPandas(rows, "doc_id long, quality int, x array<double>").dropDuplicates(["doc_id"]).toPandas()
    got = got.sort_values("doc_id")
    return gbt.fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["quality"].to_numpy(float))


def score_column(model: gbt.Trees, text):
    """A column expression: the score of ``text``."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [model.score(statistics_of(texts.iloc[i:i + 256])) for i in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))
    return score(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; a narrow pass, no shuffle."""
    model = train(docs, labels, max_train_rows)
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    out = docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
    return out.select("doc_id", F.coalesce(crc == 0, F.lit(True)).alias("held_out"), "score",
                      F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
