"""Text-model operators with deterministic default backends, one pass per text.

* sentences: split after ``. ! ?`` plus white space, or at line breaks, with character
  offsets (code points) into the source text.
* summariser (extractive): sentence score = mean in-document frequency of its lower-cased
  words; rank by score, then position; keep rank 1, or while the running word count stays
  within ``max_length``, or while the words before it are fewer than ``min_length``; print
  in original order.
* answerer (extractive): the sentence holding most distinct question words, earliest on ties;
  confidence = matched / distinct question words; offsets into the context.
* entities: a fixed rule table of regular expressions, confidence 1.0.

Summary, answer and analysis depend on one row of text, so each is an Arrow-batched function of that
row: no word or sentence rows, no shuffle.  Where a model is given (``tessera.operators.models``), it
takes the rule's place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import WS_CLASS, words
from tessera.operators.models import PandasTextModel, windows

# The reference's summary limits (single text, batch over chunks) and its texts for
# "nothing retrieved", "no such document" and "neither text (context) nor document given".
SUMMARY_MAX, SUMMARY_MIN = 150, 30
CHUNK_SUMMARY_MAX, CHUNK_SUMMARY_MIN = 100, 20
NO_CONTEXT_ANSWER = "No relevant context found for the question."
NOT_FOUND = "Document not found"
NO_INPUT = "Either text or document_id must be provided"
NO_CONTEXT_INPUT = "Either context or document_id must be provided"

MARK = "\u0001"
BOUNDARY = f"([.!?]{WS_CLASS}+|\\n{WS_CLASS}*)"

# Entity rule table (our deterministic default; label, pattern).  ASCII-only classes, so
# Java, RE2 and Python's ``re`` find the same matches.
ENTITY_RULES = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("URL", r"https?://[^ \t\n\r\f<>\"']+"),
    ("PHONE", r"(\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    ("CARD_NUMBER", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    ("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("HEX_SECRET", r"[0-9a-f]{40}"),
]


ENTITY_NEEDS = {"EMAIL": "@", "URL": "http", "PHONE": "[0-9]", "CARD_NUMBER": "[0-9]", "IP_ADDRESS": "[0-9]"}
_DIGIT = re.compile("[0-9]")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sentences(df: DataFrame, key: str, text: str = "text", *, carry: list[str] | None = None,
              with_offsets: bool = True, keep_empty: bool = False) -> DataFrame:
    """``key, pos, sentence[, start_position, end_position][, carry...]`` (code points).

    Expects ``df`` clustered by ``key`` (see ``by_key``); the running offset is a window sum
    over the pieces of one text, which needs no further shuffle.  ``keep_empty`` keeps blank
    pieces (``sentence = ''``) so every input row survives, which lets callers finish with a
    single aggregate instead of joining back to their input.
    """
    carry = list(carry or [])
    # A marker in the text itself counts as the blank it is replaced by, so offsets hold.
    pieces = F.split(F.regexp_replace(F.translate(_c(text), MARK, " "), BOUNDARY, "$1" + MARK), MARK)
    explode = F.posexplode_outer if keep_empty else F.posexplode
    ex = df.select(key, *carry, explode(pieces).alias("pos", "piece"))
    sent = F.regexp_replace("piece", f"^{WS_CLASS}+|{WS_CLASS}+$", "")
    cols = [key, F.col("pos").cast("int").alias("pos"), sent.alias("sentence")]
    if with_offsets:
        w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        off = F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0))
        lead = F.length("piece") - F.length(F.regexp_replace("piece", f"^{WS_CLASS}+", ""))
        cols.append((off + lead).cast("int").alias("start_position"))
    out = ex.select(*cols, *carry)
    if with_offsets:
        out = out.withColumn("end_position", (F.col("start_position") + F.length("sentence")).cast("int"))
    return out if keep_empty else out.where(F.col("sentence") != "")


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Cluster rows by ``key`` once, so later windows/aggregates on ``key`` add no shuffle."""
    return df.repartition(key)


_BOUNDARY_RE = re.compile(r"[.!?]\s+|\n\s*")


def split_sentences(text: str) -> list[tuple[str, int]]:
    """``(sentence, start)`` of the non-blank sentences of one text, as ``sentences`` finds them."""
    text = text.replace(MARK, " ")
    out, start = [], 0
    for end in [*(m.end() for m in _BOUNDARY_RE.finditer(text)), len(text)]:
        piece = text[start:end]
        sent = piece.strip()
        if sent:
            out.append((sent, start + len(piece) - len(piece.lstrip())))
        start = end
    return out


def summary_of(text: str | None, max_length: int, min_length: int) -> tuple[str, int, int, float]:
    """``(summary, original words, summary words, ratio)`` of one text."""
    sents = [s for s, _ in split_sentences(text or "")]
    toks = [s.lower().split() for s in sents]
    freq = Counter(w for t in toks for w in t)
    total = len((text or "").split())
    score = [sum(map(freq.__getitem__, t)) / len(t) for t in toks]
    kept, n = [], 0
    for rank, i in enumerate(sorted(range(len(sents)), key=lambda i: (-score[i], i))):
        before, n = n, n + len(toks[i])
        if rank == 0 or n <= max_length or before < min_length:
            kept.append(i)
    kept.sort()
    size = sum(len(toks[i]) for i in kept)
    return " ".join(sents[i] for i in kept), total, size, size / total if total else 0.0


def _length(value) -> Column:
    return F.col(value) if isinstance(value, str) else F.lit(value)


def summarize(docs: DataFrame, key: str = "document_id", text: str = "text",
              max_length: int | str = SUMMARY_MAX, min_length: int | str = SUMMARY_MIN,
              model: PandasTextModel | None = None) -> DataFrame:
    """``key, summary, original_length, summary_length, compression_ratio`` for every row.

    The lengths are numbers, or names of columns with each row's own.  A ``model`` takes the text and
    returns the summary."""
    if (isinstance(max_length, int) and max_length < 1) or (isinstance(min_length, int) and min_length < 0):
        raise ValueError("max_length must be >= 1 and min_length >= 0")
    if model is not None:
        got = model.apply(docs, key, text)
        size = docs.select(key, F.size(words(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("original_length"))
        got = got.select(key, "summary", F.size(words("summary")).cast("long").alias("summary_length")).join(size, key)
        ol, sl = F.col("original_length"), F.col("summary_length")
        return got.select(key, "summary", "original_length", "summary_length",
                          F.when(ol > 0, sl.cast("double") / ol).otherwise(F.lit(0.0)).alias("compression_ratio"))

    @F.pandas_udf("summary string, original_length long, summary_length long, compression_ratio double")
    def run(texts: pd.Series, most: pd.Series, least: pd.Series) -> pd.DataFrame:
        rows = [summary_of(t, a, b) for t, a, b in zip(texts, most, least, strict=True)]
        return pd.DataFrame(rows, columns=["summary", "original_length", "summary_length", "compression_ratio"])
    return docs.select(key, run(F.col(text), _length(max_length), _length(min_length)).alias("_s")).select(key, "_s.*")


def answer_of(question: str | None, context: str | None) -> tuple[str, float, int | None, int | None]:
    """``(answer, confidence, start, end)`` of one question and its context."""
    terms = set((question or "").lower().split())
    best = (0, "", 0)
    for sent, start in split_sentences(context or ""):
        n = len(terms.intersection(sent.lower().split()))
        if n > best[0]:
            best = (n, sent, start)
    n, sent, start = best
    return (sent, n / len(terms), start, start + len(sent)) if n else ("", 0.0, None, None)


def answer(questions: DataFrame, key: str = "question_id", question: str = "question",
           context: str = "context", model: PandasTextModel | None = None) -> DataFrame:
    """``key, answer, confidence, start_position, end_position`` (offsets into ``context``); a ``model``
    takes (question, context) and returns the other columns."""
    if model is not None:
        return model.apply(questions, key, question, context)

    @F.pandas_udf("answer string, confidence double, start_position int, end_position int")
    def run(asked: pd.Series, given: pd.Series) -> pd.DataFrame:
        rows = [answer_of(q, c) for q, c in zip(asked, given, strict=True)]
        out = pd.DataFrame(rows, columns=["answer", "confidence", "start_position", "end_position"])
        return out.astype({"start_position": "Int32", "end_position": "Int32"})
    return questions.select(key, run(F.col(question), F.col(context)).alias("_a")).select(key, "_a.*")


def entity_count_columns(text) -> list[Column]:
    """Per rule, the number of matches in ``text`` (JVM regex, no Python).  What every match
    of a rule holds is looked for first: most texts lack it."""
    def count(label: str, pattern: str) -> Column:
        n = F.size(F.regexp_extract_all(_c(text), F.lit(pattern), 0))
        must = ENTITY_NEEDS.get(label)
        has = None if must is None else _c(text).rlike(must) if must[0] == "[" else F.contains(_c(text), F.lit(must))
        return (n if has is None else F.when(has, n).otherwise(0)).alias(label)
    return [count(label, p) for label, p in ENTITY_RULES]


def entity_counts(df: DataFrame, text: str = "content") -> DataFrame:
    """Corpus-wide ``label, n_entities, n_texts`` (partial sums map-side)."""
    counts = df.select(*entity_count_columns(text))
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(label).cast("long").alias("n")) for label, _ in ENTITY_RULES
    ])).alias("e"))
    return stacked.groupBy(F.col("e.label").alias("label")).agg(
        F.sum("e.n").alias("n_entities"), F.count_if(F.col("e.n") > 0).alias("n_texts"))


ENTITY_SCHEMA = "key string, text string, label string, confidence double, start_position int, end_position int"


_RULES = [(label, re.compile(p)) for label, p in ENTITY_RULES]


def entities_of(text: str | None) -> list[tuple[str, str, float, int, int]]:
    """``(text, label, confidence, start, end)`` of the entities of one text."""
    text = text or ""
    digits = _DIGIT.search(text) is not None
    rules = [(label, rx) for label, rx in _RULES
             if (digits if (must := ENTITY_NEEDS.get(label, "")) == "[0-9]" else must in text)]
    return [(m[0], label, 1.0, m.start(), m.end()) for label, rx in rules for m in rx.finditer(text)]


def extract_entities(df: DataFrame, key: str = "document_id", text: str = "text",
                     model: PandasTextModel | None = None) -> DataFrame:
    """One row per entity with character offsets: ``key, text, label, confidence, start, end``.

    1:N per row with offsets needs ``finditer``; this is the one Python step, a small helper
    over Arrow batches.  A ``model`` (``many=True``) takes the text and returns its entities."""
    if model is not None:
        return model.apply(df, key, text)

    def find(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "text", "label", "confidence", "start_position", "end_position"]
        for pdf in it:
            yield pd.DataFrame([(str(k), *e) for k, t in zip(pdf["k"], pdf["t"], strict=True) for e in entities_of(t)], columns=names)

    src = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return src.mapInPandas(find, ENTITY_SCHEMA).withColumnRenamed("key", key)


_ENTITIES = "array<struct<text: string, label: string, confidence: double, start_position: int, end_position: int>>"


def entity_lists(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, entities, entity_count`` of every row: its entities as one array, by start."""
    @F.pandas_udf(_ENTITIES)
    def run(texts: pd.Series) -> pd.Series:
        names = ["text", "label", "confidence", "start_position", "end_position"]
        return pd.Series([[dict(zip(names, e, strict=True)) for e in sorted(entities_of(t), key=lambda e: (e[3], e[1]))] for t in texts])
    out = df.select(key, run(F.col(text)).alias("entities"))
    return out.withColumn("entity_count", F.size("entities").cast("long"))


def analyze(doc_text: DataFrame, *, include_summary: bool = True, include_entities: bool = True,
            key: str = "document_id", text: str = "text") -> DataFrame:
    """Per document: ``text_length`` (words of the rebuilt text, overlaps counted twice as in
    the reference), ``chunk_count``, and optionally the summary and the entity list.  One pass over
    the text, no join."""
    shape = "text_length long, summary string, compression_ratio double, entities array<struct<text: string, label: string, confidence: double>>"

    @F.pandas_udf(shape)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            summ, _, _, ratio = summary_of(t, SUMMARY_MAX, SUMMARY_MIN) if include_summary else (None, 0, 0, None)
            ents = sorted(entities_of(t), key=lambda e: (e[3], e[0], e[1])) if include_entities else []
            rows.append((len((t or "").split()), summ, ratio, [{"text": e[0], "label": e[1], "confidence": e[2]} for e in ents]))
        return pd.DataFrame(rows, columns=["text_length", "summary", "compression_ratio", "entities"])

    out = doc_text.select(key, F.col("chunk_count").cast("long").alias("chunk_count"), run(F.col(text)).alias("_a"))
    cols = [key, F.col("_a.text_length").alias("text_length"), "chunk_count"]
    if include_summary:
        cols.append(F.struct(F.col("_a.summary").alias("text"), F.col("_a.compression_ratio").alias("compression_ratio")).alias("summary"))
    if include_entities:
        cols.append(F.struct(F.size("_a.entities").cast("long").alias("total_count"), F.col("_a.entities").alias("entities")).alias("entities"))
    return out.select(*cols)


def resolve_text(requests: DataFrame, doc_text: DataFrame, key: str = "request_id", no_input: str = NO_INPUT) -> DataFrame:
    """Text given, else the stored document text, else an error (400 / 404 cases)."""
    j = requests.join(doc_text.select(F.col("document_id").alias("_d"), F.col("text").alias("_doc_text")),
                      F.col("document_id") == F.col("_d"), "left")
    has_text = F.coalesce(F.col("text") != "", F.lit(False))
    has_doc = F.col("document_id").isNotNull() & (F.col("document_id") != "")
    return j.select(
        key,
        F.when(has_text, F.lit("text")).when(has_doc & F.col("_d").isNotNull(), F.lit("document")).alias("source"),
        F.when(has_text, F.col("text")).when(has_doc, F.col("_doc_text")).alias("resolved_text"),
        F.when(has_text, F.lit(None).cast("string")).when(has_doc & F.col("_d").isNull(), F.lit(NOT_FOUND))
        .when(~has_doc, F.lit(no_input)).alias("error"))


# Merge rules for models whose input is shorter than a text (``PandasTextModel(window=...)``).

def best_answer(parts, call) -> dict:
    """The answer with the highest confidence, the earliest on ties, with its offsets in the whole text."""
    def place(part):
        start, out = part
        return -(out["confidence"] or 0.0), start + (out["start_position"] or 0)
    start, out = min(parts, key=place)
    shift = lambda at: None if at is None else at + start
    return {**out, "start_position": shift(out["start_position"]), "end_position": shift(out["end_position"])}


def joined_entities(parts, call) -> list[dict]:
    """The entities of all windows with their offsets in the whole text.  One that two windows see counts once; of those of a
    label that overlap across a seam, the longest stays (the others are what a window's edge left of it)."""
    seen = {}
    for start, found in parts:
        for e in found:
            seen.setdefault((e["label"], e["start_position"] + start, e["end_position"] + start), e)
    out, reach = [], {}
    for (label, a, b), e in sorted(seen.items(), key=lambda x: (x[0][0], x[0][1], -x[0][2])):   # by label and place
        last = reach.get(label)
        if last is None or a >= last["end_position"]:
            reach[label] = {**e, "start_position": a, "end_position": b}
            out.append(reach[label])
        elif b - a > last["end_position"] - last["start_position"]:
            last |= {**e, "start_position": a, "end_position": b}
    return sorted(out, key=lambda e: (e["start_position"], e["label"]))


def summary_of_summaries(size: int, overlap: int = 0):
    """A merge rule: the windows' summaries, in order, are summarised again, by windows while they are longer than ``size`` words
    (and as long as that makes them shorter)."""
    def merge(parts, call) -> dict:
        text = " ".join(out["summary"] for _, out in parts)
        while len(text.split()) > size:
            shorter = " ".join(out["summary"] for out in call([piece for _, piece in windows(text, size, overlap)]))
            if len(shorter.split()) >= len(text.split()):
                text = " ".join(text.split()[:size])
                break
            text = shorter
        return call([text])[0]
    return merge


# Batch task registry over a chunks table (MD-8): task name -> operator.  An unknown task
# raises before any job starts.
def _task_embeddings(chunks: DataFrame) -> DataFrame:
    from tessera.operators import embed
    return embed.embed_chunks(chunks)


def _task_summarization(chunks: DataFrame) -> DataFrame:
    return summarize(chunks, "chunk_id", "content", CHUNK_SUMMARY_MAX, CHUNK_SUMMARY_MIN)


def _task_ner(chunks: DataFrame) -> DataFrame:
    return extract_entities(chunks, "chunk_id", "content")


BATCH_TASKS = {"embeddings": _task_embeddings, "summarization": _task_summarization, "ner": _task_ner}


def batch_process_chunks(chunks: DataFrame, task: str = "embeddings") -> DataFrame:
    try:
        op = BATCH_TASKS[task]
    except KeyError:
        raise ValueError(f"Unsupported batch processing task: {task}") from None
    return op(chunks)
