"""Text-model queries with the deterministic default backends: summaries, answers, entities,
batch summaries, analysis, text resolution and retrieval QA."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.text import WS_CLASS, iso_timestamp
from tessera.operators import chunking, embed as E, knn as K, nlp
from tessera.plans import fixtures as fx
from tessera.plans.catalog import ORACLES, register
from tessera.plans.fixtures import WORDS_SQL, _fmt, sql_with
from tessera.plans.q_tables import hash_sql

WS = WS_CLASS
DOC_TEXT_SQL = """
doc_text AS (SELECT document_id, string_agg(content, ' ' ORDER BY chunk_index) AS text, count(*) AS chunk_count
             FROM stored_chunks GROUP BY document_id)"""


def sentences_sql(prefix: str, src: str, key: str, text: str) -> str:
    """``{prefix}sent(k, pos, sentence, start_position, end_position)`` over ``src``."""
    b = f"([.!?]{WS}+|\\n{WS}*)"
    return f"""
{prefix}pieces AS (SELECT {key} AS k, string_split(regexp_replace(replace({text}, chr(1), ' '), '{b}', '\\1' || chr(1), 'g'), chr(1)) AS ps
            FROM {src}),
{prefix}pz AS (SELECT k, CAST(i AS INTEGER) AS pos, ps[i + 1] AS piece
        FROM (SELECT k, ps, unnest(range(len(ps))) AS i FROM {prefix}pieces)),
{prefix}s0 AS (SELECT k, pos, piece,
               coalesce(sum(length(piece)) OVER (PARTITION BY k ORDER BY pos
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
        FROM {prefix}pz),
{prefix}sent AS (SELECT k, pos, sentence, start_position,
                 CAST(start_position + length(sentence) AS INTEGER) AS end_position
          FROM (SELECT k, pos, regexp_replace(piece, '^{WS}+|{WS}+$', '', 'g') AS sentence,
                       CAST(off + length(piece) - length(regexp_replace(piece, '^{WS}+', '')) AS INTEGER)
                         AS start_position
                FROM {prefix}s0)
          WHERE sentence <> '')"""


def summary_sql(prefix: str, src: str, key: str, text: str, max_len, min_len) -> str:
    """``{prefix}summ(k, summary, original_length, summary_length, compression_ratio)``."""
    w = _fmt(WORDS_SQL, t="lower(sentence)")
    return sentences_sql(prefix, src, key, text) + f""",
{prefix}toks AS (SELECT k, pos, unnest({w}) AS tok FROM {prefix}sent),
{prefix}freq AS (SELECT k, tok, count(*) AS f FROM {prefix}toks GROUP BY ALL),
{prefix}score AS (SELECT t.k, t.pos, CAST(sum(f.f) AS DOUBLE) / count(*) AS score
           FROM {prefix}toks t JOIN {prefix}freq f ON f.k = t.k AND f.tok = t.tok GROUP BY ALL),
{prefix}ranked AS (SELECT s.k, s.pos, s.sentence, len({_fmt(WORDS_SQL, t="s.sentence")}) AS nw, sc.score,
                   row_number() OVER (PARTITION BY s.k ORDER BY sc.score DESC, s.pos) AS rk,
                   sum(len({_fmt(WORDS_SQL, t="s.sentence")})) OVER (PARTITION BY s.k ORDER BY sc.score DESC, s.pos
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
            FROM {prefix}sent s JOIN {prefix}score sc ON sc.k = s.k AND sc.pos = s.pos),
{prefix}kept AS (SELECT k, string_agg(sentence, ' ' ORDER BY pos) AS summary, sum(nw) AS summary_length
          FROM {prefix}ranked WHERE rk = 1 OR cum <= {max_len} OR cum - nw < {min_len} GROUP BY k),
{prefix}summ AS (SELECT x.k, coalesce(kp.summary, '') AS summary, x.original_length,
                 CAST(coalesce(kp.summary_length, 0) AS BIGINT) AS summary_length,
                 CASE WHEN x.original_length > 0
                      THEN CAST(coalesce(kp.summary_length, 0) AS DOUBLE) / x.original_length ELSE 0.0 END
                   AS compression_ratio
          FROM (SELECT {key} AS k, CAST(len({_fmt(WORDS_SQL, t=text)}) AS BIGINT) AS original_length FROM {src}) x
          LEFT JOIN {prefix}kept kp ON kp.k = x.k)"""


def answer_sql(prefix: str, src: str, key: str, question: str, context: str) -> str:
    """``{prefix}ans(k, answer, confidence, start_position, end_position)``."""
    return sentences_sql(prefix, src, key, context) + f""",
{prefix}terms AS (SELECT {key} AS k, list_distinct({_fmt(WORDS_SQL, t=f"lower({question})")}) AS terms FROM {src}),
{prefix}m AS (SELECT s.*, len(list_intersect(t.terms, {_fmt(WORDS_SQL, t="lower(s.sentence)")})) AS matched
       FROM {prefix}sent s JOIN {prefix}terms t ON t.k = s.k),
{prefix}best AS (SELECT * FROM {prefix}m WHERE matched > 0
          QUALIFY row_number() OVER (PARTITION BY k ORDER BY matched DESC, pos) = 1),
{prefix}ans AS (SELECT t.k, coalesce(b.sentence, '') AS answer,
                CASE WHEN b.matched IS NOT NULL THEN CAST(b.matched AS DOUBLE) / len(t.terms) ELSE 0.0 END
                  AS confidence,
                b.start_position, b.end_position
         FROM {prefix}terms t LEFT JOIN {prefix}best b ON b.k = t.k)"""


def _doc_text(spark, sf_dir, ids=None):
    """Stored document text rebuilt from chunks; with ``ids`` only for the requested documents."""
    return chunking.reassemble_text(fx.stored_chunks(spark, sf_dir, ids))


def _round_ratio(df, col="compression_ratio"):
    return df.withColumn(col, F.round(col, 6))


# ------------------------------------------------------------------------------ summaries

@register("summarize_documents", sql_with("stored_chunks").rstrip() + "," + DOC_TEXT_SQL + "," +
          summary_sql("", "doc_text", "document_id", "text", nlp.SUMMARY_MAX, nlp.SUMMARY_MIN) + """
SELECT k AS document_id, summary, original_length, summary_length, round(compression_ratio, 6) AS compression_ratio
FROM summ""")
def summarize_documents(spark, sf_dir):
    return _round_ratio(nlp.summarize(_doc_text(spark, sf_dir), "document_id", "text"))


@register("summarize_chunks", sql_with("stored_chunks").rstrip() + "," +
          summary_sql("", "stored_chunks", "chunk_id", "content", nlp.CHUNK_SUMMARY_MAX, nlp.CHUNK_SUMMARY_MIN) + """
SELECT k AS chunk_id, summary, original_length, summary_length, round(compression_ratio, 6) AS compression_ratio
FROM summ""")
def summarize_chunks(spark, sf_dir):
    s = nlp.summarize(fx.stored_chunks(spark, sf_dir), "chunk_id", "content",
                      nlp.CHUNK_SUMMARY_MAX, nlp.CHUNK_SUMMARY_MIN)
    return _round_ratio(s)


_BATCH_SQL = sql_with("stored_chunks").rstrip() + "," + DOC_TEXT_SQL + "," + summary_sql(
    "", "doc_text", "document_id", "text", nlp.SUMMARY_MAX, nlp.SUMMARY_MIN) + """,
batch AS (SELECT l.doc_id AS pos, CAST(l.doc_id AS VARCHAR) AS document_id, s.summary,
                 CAST(s.compression_ratio AS VARCHAR) AS compression_ratio,
                 CASE WHEN s.k IS NULL THEN '""" + nlp.NOT_FOUND + """' END AS error
          FROM labels l LEFT JOIN summ s ON s.k = CAST(l.doc_id AS VARCHAR))
"""


def python_str(col):
    """``str(float)``, the text form the batch response uses."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else str(float(v))).astype(object)
    return run(F.col(col))


def _batch(spark, sf_dir):
    req = fx.labelled_ids(spark, sf_dir)
    s = nlp.summarize(_doc_text(spark, sf_dir, req), "document_id", "text")
    j = req.join(s.withColumn("_ok", F.lit(True)), "document_id", "left")
    return j.select("pos", "document_id", "summary", python_str("compression_ratio").alias("compression_ratio"),
                    F.when(F.col("_ok").isNull(), F.lit(nlp.NOT_FOUND)).alias("error"))


@register("batch_summarize", _BATCH_SQL + "SELECT * FROM batch")
def batch_summarize(spark, sf_dir):
    return _batch(spark, sf_dir)


@register("batch_summarize_totals", _BATCH_SQL + """
SELECT count(*) AS total_processed, count(*) FILTER (WHERE error IS NULL) AS successful FROM batch""")
def batch_summarize_totals(spark, sf_dir):
    b = _batch(spark, sf_dir)
    return b.agg(F.count("*").alias("total_processed"), F.count_if(F.col("error").isNull()).alias("successful"))


# ------------------------------------------------------------------------------ answers

@register("answer_questions", sql_with("stored_chunks").rstrip() + "," + DOC_TEXT_SQL + """,
qctx AS (SELECT b.item_id AS question_id, b.text AS question, d.text AS context
         FROM benchmark b JOIN doc_text d ON d.document_id = CAST(b.item_id AS VARCHAR)),""" +
          answer_sql("", "qctx", "question_id", "question", "context") + """
SELECT b.item_id AS question_id, a.answer, round(a.confidence, 6) AS confidence, a.start_position, a.end_position,
       CASE WHEN a.k IS NULL THEN '""" + nlp.NOT_FOUND + """' END AS error
FROM benchmark b LEFT JOIN ans a ON a.k = b.item_id""")
def answer_questions(spark, sf_dir):
    q = fx.questions(spark, sf_dir)
    ctx = q.join(_doc_text(spark, sf_dir, q).select("document_id", F.col("text").alias("context")), "document_id")
    a = nlp.answer(ctx, "question_id", "question", "context")
    j = q.select("question_id").join(a.withColumn("_ok", F.lit(True)), "question_id", "left")
    return j.select("question_id", "answer", F.round("confidence", 6).alias("confidence"),
                    "start_position", "end_position",
                    F.when(F.col("_ok").isNull(), F.lit(nlp.NOT_FOUND)).alias("error"))


# ------------------------------------------------------------------------------ entities

def _sql_str(p: str) -> str:
    return p.replace("'", "''")


@register("entity_counts", sql_with("stored_chunks") + "\n UNION ALL ".join(
    f"""SELECT '{label}' AS label, CAST(sum(len(regexp_extract_all(content, '{_sql_str(p)}'))) AS BIGINT) AS n_entities,
       count(*) FILTER (WHERE len(regexp_extract_all(content, '{_sql_str(p)}')) > 0) AS n_texts
FROM stored_chunks""" for label, p in nlp.ENTITY_RULES))
def entity_counts(spark, sf_dir):
    return nlp.entity_counts(fx.stored_chunks(spark, sf_dir), "content")


def entities_sql(src: str, key: str, text: str) -> str:
    """``ents(k, label, text, start_position, end_position)``: a match starts after the pieces that a split
    leaves before it and the matches before it."""
    parts = "\n UNION ALL ".join(
        f"SELECT {key} AS k, '{label}' AS label, regexp_extract_all({text}, '{_sql_str(p)}') AS m, "
        f"regexp_split_to_array({text}, '{_sql_str(p)}') AS p FROM {src}" for label, p in nlp.ENTITY_RULES)
    return f"""
found AS ({parts}),
placed AS (SELECT k, label, m[i + 1] AS text,
                  CAST(list_sum(list_transform(p[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS INTEGER)
                    AS start_position
           FROM (SELECT *, unnest(range(len(m))) AS i FROM found)),
ents AS (SELECT *, CAST(start_position + length(text) AS INTEGER) AS end_position FROM placed)"""


@register("extract_entities", sql_with("doc_raw", "doc").rstrip() + "," + entities_sql("doc", "document_id", "text") + """
SELECT k AS document_id, text, label, 1.0::DOUBLE AS confidence, start_position, end_position FROM ents""")
def extract_entities(spark, sf_dir):
    return nlp.extract_entities(fx.doc(spark, sf_dir), "document_id", "text")


# ------------------------------------------------------------------------------ models with a limited input

WINDOW, OVERLAP, BUDGET = 200, 32, 4096   # words: the model's longest input, what windows share, a batch


def _limited(rule):
    """The default rule as a model that takes no more than ``WINDOW`` words."""
    def factory():
        def model(*inputs):
            if any(len(t.split()) > WINDOW for t in inputs[-1]):
                raise ValueError(f"more than {WINDOW} words")
            return [rule(*row) for row in zip(*inputs, strict=True)]
        return model
    return factory


@register("entities_windowed", ORACLES["extract_entities"])
def entities_windowed(spark, sf_dir):
    """Entities by a model that sees ``WINDOW`` words at a time: the same as over whole texts."""
    def rule(text):
        return [dict(zip(("text", "label", "confidence", "start_position", "end_position"), e, strict=True)) for e in nlp.entities_of(text)]
    model = nlp.PandasTextModel(_limited(rule), nlp.ENTITY_SCHEMA.replace("key", "document_id", 1), many=True, window=WINDOW, overlap=OVERLAP,
                                merge=nlp.joined_entities, budget=BUDGET)
    return nlp.extract_entities(fx.doc(spark, sf_dir), "document_id", "text", model)


@register("answer_windowed")
def answer_windowed(spark, sf_dir):
    """Each question asked of its document by a model that sees ``WINDOW`` words: the best answer of all windows, with its
    offsets in the whole text."""
    def rule(question, context):
        return dict(zip(("answer", "confidence", "start_position", "end_position"), nlp.answer_of(question, context), strict=True))
    model = nlp.PandasTextModel(_limited(rule), "question_id long, answer string, confidence double, start_position int, end_position int",
                                window=WINDOW, overlap=OVERLAP, merge=nlp.best_answer, budget=BUDGET)
    asked = fx.questions(spark, sf_dir).join(fx.accepted_text(spark, sf_dir), "document_id")
    return nlp.answer(asked, "question_id", context="text", model=model)


@register("summarize_windowed")
def summarize_windowed(spark, sf_dir):
    """Summaries of whole documents by a model that sees ``WINDOW`` words: summaries of the windows, summarised again."""
    def rule(text):
        return {"summary": nlp.summary_of(text, 60, 10)[0]}
    model = nlp.PandasTextModel(_limited(rule), "document_id string, summary string", window=WINDOW, overlap=OVERLAP,
                                merge=nlp.summary_of_summaries(WINDOW, OVERLAP), budget=BUDGET)
    return _round_ratio(nlp.summarize(fx.accepted_text(spark, sf_dir), model=model))


# ------------------------------------------------------------------------------ the batch method over chunks, by task

@register("batch_task_summarization", ORACLES["summarize_chunks"])
def batch_task_summarization(spark, sf_dir):
    return _round_ratio(nlp.batch_process_chunks(fx.stored_chunks(spark, sf_dir), "summarization"))


@register("batch_task_ner", sql_with("stored_chunks").rstrip() + "," + entities_sql("stored_chunks", "chunk_id", "content") + """
SELECT k AS chunk_id, text, label, 1.0::DOUBLE AS confidence, start_position, end_position FROM ents""")
def batch_task_ner(spark, sf_dir):
    return nlp.batch_process_chunks(fx.stored_chunks(spark, sf_dir), "ner")


@register("batch_task_embeddings", sql_with("stored_chunks").rstrip() + "," + hash_sql("stored_chunks") + """
SELECT chunk_id, bucket, round(w, 6) AS weight FROM lf""")
def batch_task_embeddings(spark, sf_dir):
    return E.long_form(nlp.batch_process_chunks(fx.stored_chunks(spark, sf_dir), "embeddings"))


@register("entity_mentions", sql_with("doc_raw", "doc") + "SELECT document_id, label, text, count(*) AS n FROM (" +
          "\n UNION ALL ".join(
              f"SELECT document_id, '{label}' AS label, unnest(regexp_extract_all(text, '{_sql_str(p)}')) AS text FROM doc"
              for label, p in nlp.ENTITY_RULES) + ") GROUP BY ALL")
def entity_mentions(spark, sf_dir):
    """Distinct entity mentions per document with their counts (the offsets query, grouped)."""
    e = nlp.extract_entities(fx.doc(spark, sf_dir), "document_id", "text")
    return e.groupBy("document_id", "label", "text").agg(F.count("*").alias("n"))


@register("analyze_documents", sql_with("stored_chunks").rstrip() + "," + DOC_TEXT_SQL + "," +
          summary_sql("", "doc_text", "document_id", "text", nlp.SUMMARY_MAX, nlp.SUMMARY_MIN) + """
SELECT d.document_id, CAST(len(""" + _fmt(WORDS_SQL, t="d.text") + """) AS BIGINT) AS text_length,
       d.chunk_count, s.summary, round(s.compression_ratio, 6) AS compression_ratio,
       CAST(""" + " + ".join(f"len(regexp_extract_all(d.text, '{_sql_str(p)}'))" for _, p in nlp.ENTITY_RULES) +
          """ AS BIGINT) AS entity_total
FROM doc_text d JOIN summ s ON s.k = d.document_id""")
def analyze_documents(spark, sf_dir):
    a = nlp.analyze(_doc_text(spark, sf_dir))
    return a.select("document_id", "text_length", "chunk_count", F.col("summary.text").alias("summary"),
                    F.round("summary.compression_ratio", 6).alias("compression_ratio"),
                    F.col("entities.total_count").alias("entity_total"))


REQUESTS_SQL = """
req AS (SELECT item_id AS request_id, text AS question,
               CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN '' WHEN 4 THEN text END AS text,
               CASE item_id % 5 WHEN 1 THEN CAST(item_id AS VARCHAR)
                                WHEN 2 THEN 'missing-' || CAST(item_id AS VARCHAR)
                                WHEN 4 THEN CAST(item_id AS VARCHAR) END AS document_id
        FROM benchmark),"""


def resolved_sql(no_input: str) -> str:
    """``resolved(request_id, question, rtext, error)`` of the text-or-document requests."""
    return sql_with("stored_chunks").rstrip() + "," + DOC_TEXT_SQL + "," + REQUESTS_SQL + """
resolved AS (
  SELECT r.request_id, r.question,
         CASE WHEN coalesce(r.text <> '', false) THEN r.text
              WHEN r.document_id IS NOT NULL AND r.document_id <> '' THEN d.text END AS rtext,
         CASE WHEN coalesce(r.text <> '', false) THEN NULL
              WHEN r.document_id IS NOT NULL AND r.document_id <> '' AND d.document_id IS NULL THEN '""" + nlp.NOT_FOUND + """'
              WHEN NOT (r.document_id IS NOT NULL AND r.document_id <> '') THEN '""" + no_input + """'
         END AS error
  FROM req r LEFT JOIN doc_text d ON d.document_id = r.document_id),"""


def _resolved(spark, sf_dir, req, no_input=nlp.NO_INPUT):
    return nlp.resolve_text(req, _doc_text(spark, sf_dir, req.where(F.col("document_id").isNotNull())), no_input=no_input)


@register("summarize_requests", resolved_sql(nlp.NO_INPUT) + """
ok AS (SELECT request_id, rtext FROM resolved WHERE error IS NULL),""" + summary_sql(
    "", "ok", "request_id", "rtext", "CASE k % 3 WHEN 1 THEN 20 WHEN 2 THEN 60 ELSE 150 END",
    "CASE k % 3 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 30 END") + """
SELECT r.request_id, s.summary, s.original_length, s.summary_length,
       round(s.compression_ratio, 6) AS compression_ratio, r.error
FROM resolved r LEFT JOIN summ s ON s.k = r.request_id""")
def summarize_requests(spark, sf_dir):
    """Summarise the given text, else the stored document's text, to the request's own lengths, else
    report the error."""
    req = fx.requests(spark, sf_dir)
    r = _resolved(spark, sf_dir, req)
    ok = r.where(F.col("error").isNull()).join(req.select("request_id", "max_length", "min_length"), "request_id")
    s = nlp.summarize(ok, "request_id", "resolved_text", "max_length", "min_length")
    return r.select("request_id", "error").join(s, "request_id", "left").select(
        "request_id", "summary", "original_length", "summary_length",
        F.round("compression_ratio", 6).alias("compression_ratio"), "error")


@register("answer_requests", resolved_sql(nlp.NO_CONTEXT_INPUT) + """
ok AS (SELECT request_id, question, rtext FROM resolved WHERE error IS NULL),""" + answer_sql("", "ok", "request_id", "question", "rtext") + """
SELECT r.request_id, a.answer, round(a.confidence, 6) AS confidence, a.start_position, a.end_position, r.error
FROM resolved r LEFT JOIN ans a ON a.k = r.request_id""")
def answer_requests(spark, sf_dir):
    """A question with its context, or with the document that is its context, else the error."""
    req = fx.requests(spark, sf_dir)
    r = _resolved(spark, sf_dir, req, nlp.NO_CONTEXT_INPUT)
    asked = fx.questions(spark, sf_dir).select(F.col("question_id").alias("request_id"), "question")
    a = nlp.answer(r.where("error IS NULL").join(asked, "request_id"), "request_id", "question", "resolved_text")
    return r.select("request_id", "error").join(a, "request_id", "left").select(
        "request_id", "answer", F.round("confidence", 6).alias("confidence"), "start_position", "end_position", "error")


@register("entity_requests", resolved_sql(nlp.NO_INPUT) + """
ok AS (SELECT request_id, rtext FROM resolved WHERE error IS NULL),""" + entities_sql("ok", "request_id", "rtext") + """
SELECT r.request_id, CASE WHEN r.error IS NULL THEN coalesce(e.n, 0) END AS entity_count,
       CASE WHEN r.error IS NULL THEN coalesce(e.said, '') END AS entities, r.error
FROM resolved r LEFT JOIN (SELECT k, count(*) AS n, string_agg(label || ':' || start_position || ':' || end_position, ',' ORDER BY start_position, label) AS said
                           FROM ents GROUP BY k) e ON e.k = r.request_id""")
def entity_requests(spark, sf_dir):
    """The entities of a text, or of a stored document, with their count, else the error."""
    r = _resolved(spark, sf_dir, fx.requests(spark, sf_dir))
    e = nlp.entity_lists(r.where("error IS NULL"), "request_id", "resolved_text")
    said = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["label"], x["start_position"], x["end_position"])), ",")
    e = e.select("request_id", "entity_count", said.alias("entities"))
    return r.select("request_id", "error").join(e, "request_id", "left").select("request_id", "entity_count", "entities", "error")


@register("resolve_text", sql_with("stored_chunks").rstrip() + "," + DOC_TEXT_SQL + """,
req AS (SELECT item_id AS request_id,
               CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN '' WHEN 4 THEN text END AS text,
               CASE item_id % 5 WHEN 1 THEN CAST(item_id AS VARCHAR)
                                WHEN 2 THEN 'missing-' || CAST(item_id AS VARCHAR)
                                WHEN 4 THEN CAST(item_id AS VARCHAR) END AS document_id
        FROM benchmark)
SELECT r.request_id,
       CASE WHEN coalesce(r.text <> '', false) THEN 'text'
            WHEN r.document_id IS NOT NULL AND r.document_id <> '' AND d.document_id IS NOT NULL THEN 'document'
       END AS source,
       CASE WHEN coalesce(r.text <> '', false) THEN r.text
            WHEN r.document_id IS NOT NULL AND r.document_id <> '' THEN d.text END AS resolved_text,
       CASE WHEN coalesce(r.text <> '', false) THEN NULL
            WHEN r.document_id IS NOT NULL AND r.document_id <> '' AND d.document_id IS NULL THEN '""" + nlp.NOT_FOUND + """'
            WHEN NOT (r.document_id IS NOT NULL AND r.document_id <> '') THEN '""" + nlp.NO_INPUT + """'
       END AS error
FROM req r LEFT JOIN doc_text d ON d.document_id = r.document_id""")
def resolve_text(spark, sf_dir):
    return _resolved(spark, sf_dir, fx.requests(spark, sf_dir))


# ------------------------------------------------------------------------------ retrieval QA

def chunk_vector_id(document_id, chunk_index):
    """Numeric vector id of a fixture chunk (document ids are numeric strings)."""
    return (F.col(document_id).cast("long") * 100000 + F.col(chunk_index)).cast("long")


def stored_vectors(spark, sf_dir):
    ch = fx.stored_chunks(spark, sf_dir).withColumn("vector_index_id", chunk_vector_id("document_id", "chunk_index"))
    return E.embed_chunks(ch)


def hash_search_sql(query_src: str, limit: int, threshold: float, only: str = "") -> str:
    """CTEs (continuing a ``WITH`` that defines ``stored_chunks``) for a search of hashed
    query texts against hashed stored chunks: defines ``res(query_id, hit_chunk_id, score,
    content, rank)``.  ``query_src`` has ``chunk_id`` (numeric query id as text) and
    ``content`` (query text); pairs sharing no bucket score 0 and cannot pass a positive
    threshold, so the sparse join is exact.  ``only``: a document filter over ``query_id, document_id``."""
    return "," + hash_sql("stored_chunks", prefix="c_") + "," + hash_sql(
        "(SELECT chunk_id, chunk_id AS document_id, content FROM " + query_src + ")", prefix="q_") + """,
qnorm AS (SELECT chunk_id, sqrt(sum(w * w)) AS qn FROM q_lf GROUP BY chunk_id),
pairs AS (SELECT CAST(q.chunk_id AS BIGINT) AS query_id, c.chunk_id AS hit_chunk_id,
                 round(sum(q.w / n.qn * c.w), 10) AS score
          FROM q_lf q JOIN qnorm n ON n.chunk_id = q.chunk_id JOIN c_lf c ON c.bucket = q.bucket
          GROUP BY ALL),
cand AS (SELECT p.*, s.content, s.document_id, s.chunk_index, CAST(s.document_id AS BIGINT) * 100000 + s.chunk_index AS vid,
                row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC,
                                   CAST(s.document_id AS BIGINT) * 100000 + s.chunk_index) AS cand_rank
         FROM pairs p JOIN stored_chunks s ON s.chunk_id = p.hit_chunk_id
         QUALIFY cand_rank <= """ + str(2 * limit) + """),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cand_rank) AS rank
        FROM cand WHERE score >= """ + str(threshold) + only + """ QUALIFY rank <= """ + str(limit) + """)"""


QA_SEARCH_SQL = sql_with("stored_chunks").rstrip() + hash_search_sql(
    "(SELECT CAST(item_id AS VARCHAR) AS chunk_id, text AS content FROM benchmark)",
    fx.QA_LIMIT, fx.QA_THRESHOLD, " AND (query_id % 4 <> 3 OR CAST(document_id AS BIGINT) BETWEEN query_id * 3 AND query_id * 3 + 59)") + """,
ctx AS (SELECT r.query_id, string_agg(r.content, ' ' ORDER BY r.rank) AS context,
               string_agg(concat_ws('|', r.document_id, r.hit_chunk_id, CAST(CAST(round(r.score, 4) AS DECIMAL(9,4)) AS VARCHAR), d.filename,
                                    d.document_type, strftime(d.upload_timestamp, '%Y-%m-%dT%H:%M:%S'), r.chunk_index), ';' ORDER BY r.rank) AS sources,
               count(*) AS n_sources
        FROM res r LEFT JOIN doc d ON d.document_id = r.document_id GROUP BY r.query_id),
qctx AS (SELECT b.item_id AS question_id, b.text AS question, c.context
         FROM benchmark b JOIN ctx c ON c.query_id = b.item_id),""" + answer_sql(
    "", "qctx", "question_id", "question", "context") + """
SELECT b.item_id AS question_id, b.text AS question,
       CASE WHEN c.query_id IS NULL THEN '""" + nlp.NO_CONTEXT_ANSWER + """' ELSE a.answer END AS answer,
       CASE WHEN c.query_id IS NULL THEN 0.0 ELSE round(a.confidence, 6) END AS confidence,
       coalesce(c.n_sources, 0) AS n_sources, coalesce(c.sources, '') AS sources
FROM benchmark b LEFT JOIN ctx c ON c.query_id = b.item_id LEFT JOIN ans a ON a.k = b.item_id
"""


def qa_search_frame(spark, questions, vectors, documents, limit=fx.QA_LIMIT, threshold=fx.QA_THRESHOLD, model=None):
    """Retrieve context for every question (from its ``document_ids`` where given), then answer from it; no
    hit -> fixed answer.  ``sources``: the hits in order, each with its document's metadata."""
    emb = E.HashingEmbedder()
    q = questions.select(F.col("question_id").alias("query_id"), "question", "document_ids", emb.column("question").alias("embedding"))
    req = q.select("query_id", "embedding", "document_ids", F.lit(limit).alias("limit"), F.lit(threshold).alias("similarity_threshold"))
    hits = K.attach_metadata(K.search_requests(req, vectors, vectors, vector_dim=emb.dim), documents, iso_timestamp)
    ctx = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "content", "document_id", "chunk_id", "similarity_score", "metadata"))).alias("_h"))
    ctx = ctx.select("query_id", F.array_join(F.transform("_h", lambda x: x["content"]), " ").alias("context"),
                     F.transform("_h", lambda x: F.struct(x["document_id"].alias("document_id"), x["chunk_id"].alias("chunk_id"),
                                                          x["similarity_score"].alias("similarity_score"), x["metadata"].alias("metadata"))).alias("sources"))
    both = q.select("query_id", "question").join(ctx, "query_id", "left")
    a = nlp.answer(both, "query_id", "question", "context", model)
    none = F.col("context").isNull()
    return both.join(a, "query_id").select(
        F.col("query_id").alias("question_id"), "question",
        F.when(none, F.lit(nlp.NO_CONTEXT_ANSWER)).otherwise(F.col("answer")).alias("answer"),
        F.when(none, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("n_sources"), "sources")


@register("qa_search", QA_SEARCH_SQL)
def qa_search(spark, sf_dir):
    r = qa_search_frame(spark, fx.questions(spark, sf_dir), stored_vectors(spark, sf_dir), fx.doc(spark, sf_dir))
    said = F.transform("sources", lambda x: F.concat_ws(
        "|", x["document_id"], x["chunk_id"], F.round(x["similarity_score"], 4).cast("decimal(9,4)").cast("string"), x["metadata"]["filename"],
        x["metadata"]["document_type"], x["metadata"]["upload_timestamp"], x["metadata"]["chunk_index"].cast("string")))
    return r.select("question_id", "question", "answer", F.round("confidence", 6).alias("confidence"),
                    F.greatest("n_sources", F.lit(0)).cast("long").alias("n_sources"), F.coalesce(F.array_join(said, ";"), F.lit("")).alias("sources"))
