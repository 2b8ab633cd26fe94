"""Vector queries: k-NN, semantic search variants, metadata, responses, similar documents,
statistics and compaction over the stored-vector fixture (every stored vector also serves as
a query, so the work grows with the table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import iso_timestamp
from tessera.operators import knn as K
from tessera.operators import tables
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register
from tessera.plans.fixtures import sql_with

# ------------------------------------------------------------------------------ SQL helpers

QN_SQL = """
qraw AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
qn AS (SELECT query_id,
              CASE WHEN nrm > 0 THEN list_transform(e, lambda x: x / nrm) ELSE e END AS e
       FROM (SELECT query_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM qraw))"""


def _cand_sql(k: int, vec_view: str = "vec", q_view: str = "qn") -> str:
    return f"""
cand AS (SELECT query_id, vector_index_id, score,
                row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_index_id) AS cand_rank
         FROM (SELECT q.query_id, v.vector_index_id,
                      round(list_dot_product(q.e, CAST(v.embedding AS DOUBLE[])), 10) AS score
               FROM {q_view} q, {vec_view} v)
         QUALIFY cand_rank <= {k})"""


def search_sql(limit: int, threshold: float, *, post_ids=None, pre_ids=None, deleted: bool = False) -> str:
    """The reference filter chain as SQL over the fixture views; defines ``res``."""
    views = ["doc_raw", "del_ids", "vec"] if deleted else ["vec"]
    live = "(SELECT * FROM vec WHERE document_id NOT IN (SELECT document_id FROM del_ids))" if deleted else "vec"
    vec_view = "vec"
    if pre_ids:
        ids = ", ".join(f"'{i}'" for i in pre_ids)
        vec_view = f"(SELECT * FROM vec WHERE document_id IN ({ids}))"
    post = ""
    if post_ids:
        ids = ", ".join(f"'{i}'" for i in post_ids)
        post = f" AND v.document_id IN ({ids})"
    return sql_with(*views).rstrip() + "," + QN_SQL + "," + _cand_sql(2 * limit, vec_view) + f""",
hits AS (SELECT c.query_id, c.cand_rank, c.vector_index_id, c.score, v.document_id, v.chunk_id,
                v.content, v.chunk_index
         FROM cand c JOIN {live} v ON v.vector_index_id = c.vector_index_id
         WHERE c.score >= {threshold}{post}),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cand_rank) AS rank
        FROM hits QUALIFY rank <= {limit})
"""


SEARCH_COLS_SQL = ("SELECT query_id, rank, vector_index_id, document_id, chunk_id, content, chunk_index, "
                   "round(score, 6) AS similarity_score FROM res")


def _out(df):
    return df.select(F.col("query_id").cast("long"), F.col("rank").cast("long"), "vector_index_id",
                     "document_id", "chunk_id", "content", "chunk_index",
                     F.round("similarity_score", 6).alias("similarity_score"))


def _search(spark, sf_dir, *, limit=fx.SEARCH_LIMIT, threshold=fx.SEARCH_THRESHOLD, deleted=False, **kw):
    v = fx.vec(spark, sf_dir)
    live = tables.delete_by_ids(v, fx.deleted_ids(spark, sf_dir)) if deleted else v
    return K.semantic_search(fx.query_vectors(spark, sf_dir), v, live, limit=limit, threshold=threshold, **kw)


# ------------------------------------------------------------------------------ queries

@register("knn_join", sql_with("vec").rstrip() + "," + QN_SQL + "," + _cand_sql(10) + """
SELECT query_id, cand_rank AS rank, vector_index_id, round(score, 6) AS similarity_score FROM cand""")
def knn_join(spark, sf_dir):
    r = K.knn(fx.query_vectors(spark, sf_dir), fx.vec(spark, sf_dir), 10)
    return r.select("query_id", F.col("rank").cast("long"), "vector_index_id",
                    F.round("score", 6).alias("similarity_score"))


@register("semantic_search", search_sql(fx.SEARCH_LIMIT, fx.SEARCH_THRESHOLD) + SEARCH_COLS_SQL)
def semantic_search(spark, sf_dir):
    return _out(_search(spark, sf_dir))


@register("semantic_search_docs_post",
          search_sql(fx.SEARCH_LIMIT, fx.SEARCH_THRESHOLD, post_ids=fx.DOC_FILTER_IDS) + SEARCH_COLS_SQL)
def semantic_search_docs_post(spark, sf_dir):
    return _out(_search(spark, sf_dir, document_ids=fx.DOC_FILTER_IDS, filter_mode="post"))


@register("semantic_search_docs_pre",
          search_sql(fx.SEARCH_LIMIT, fx.SEARCH_THRESHOLD, pre_ids=fx.DOC_FILTER_IDS) + SEARCH_COLS_SQL)
def semantic_search_docs_pre(spark, sf_dir):
    return _out(_search(spark, sf_dir, document_ids=fx.DOC_FILTER_IDS, filter_mode="pre"))


def label_filter(spark, sf_dir):
    """Per-query filter from the data: a query may match the documents holding a vector with the
    same ``label`` as the query's own embedding.  Each query's set, and the sets."""
    e = fx.read(spark, sf_dir, "embeddings")
    v = fx.vec(spark, sf_dir).select("vector_index_id", "document_id")
    doc_labels = v.join(e.select(F.col("vec_id").alias("vector_index_id"), "label"), "vector_index_id") \
        .select(F.col("label").alias("set_id"), "document_id").distinct()
    return e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("set_id")), doc_labels


@register("semantic_search_per_query_pre", sql_with("vec").rstrip() + "," + QN_SQL + """,
allowed AS (SELECT DISTINCT q.vec_id AS query_id, v.document_id
            FROM embeddings q JOIN embeddings e ON e.label = q.label JOIN vec v ON v.vector_index_id = e.vec_id),
cand AS (SELECT query_id, vector_index_id, score,
                row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_index_id) AS cand_rank
         FROM (SELECT q.query_id, v.vector_index_id,
                      round(list_dot_product(q.e, CAST(v.embedding AS DOUBLE[])), 10) AS score
               FROM qn q JOIN allowed a ON a.query_id = q.query_id JOIN vec v ON v.document_id = a.document_id)
         QUALIFY cand_rank <= """ + str(2 * fx.SEARCH_LIMIT) + """),
hits AS (SELECT c.query_id, c.cand_rank, c.vector_index_id, c.score, v.document_id, v.chunk_id,
                v.content, v.chunk_index
         FROM cand c JOIN vec v ON v.vector_index_id = c.vector_index_id
         WHERE c.score >= """ + str(fx.SEARCH_THRESHOLD) + """),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cand_rank) AS rank
        FROM hits QUALIFY rank <= """ + str(fx.SEARCH_LIMIT) + """)
""" + SEARCH_COLS_SQL)
def semantic_search_per_query_pre(spark, sf_dir):
    own, sets = label_filter(spark, sf_dir)
    return _out(_search(spark, sf_dir, document_ids=own, document_sets=sets, filter_mode="pre"))


@register("semantic_search_deleted",
          search_sql(fx.SEARCH_LIMIT, fx.SEARCH_THRESHOLD, deleted=True) + SEARCH_COLS_SQL)
def semantic_search_deleted(spark, sf_dir):
    return _out(_search(spark, sf_dir, deleted=True))


_META_SQL = search_sql(fx.SEARCH_LIMIT, fx.SEARCH_THRESHOLD).replace(
    sql_with("vec").rstrip(), sql_with("doc_raw", "doc", "vec").rstrip()) + """
SELECT r.query_id, r.rank, r.chunk_id, round(r.score, 6) AS similarity_score,
       d.filename AS meta_filename, d.document_type AS meta_document_type,
       strftime(d.upload_timestamp, '%Y-%m-%dT%H:%M:%S') AS meta_upload_timestamp,
       CASE WHEN d.document_id IS NOT NULL THEN r.chunk_index END AS meta_chunk_index
FROM res r LEFT JOIN doc d ON d.document_id = r.document_id"""


@register("search_with_metadata", _META_SQL)
def search_with_metadata(spark, sf_dir):
    hits = _search(spark, sf_dir)
    docs = fx.doc(spark, sf_dir)
    m = K.attach_metadata(hits, docs, iso_timestamp)
    return m.select(F.col("query_id").cast("long"), F.col("rank").cast("long"), "chunk_id",
                    F.round("similarity_score", 6).alias("similarity_score"),
                    F.col("metadata.filename").alias("meta_filename"),
                    F.col("metadata.document_type").alias("meta_document_type"),
                    F.col("metadata.upload_timestamp").alias("meta_upload_timestamp"),
                    F.col("metadata.chunk_index").alias("meta_chunk_index"))


def per_query_response(queries, hits, values: dict[str, tuple[str, str]], count_name: str):
    """AG-14: one row per query (left join, so a query without hits gets 0 and '').  ``values``: name -> (column of the
    hits, separator); all of them come from one aggregate."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", *dict.fromkeys(c for c, _ in values.values()))))
    agg = hits.groupBy("query_id").agg(F.count("*").alias(count_name), ordered.alias("_hits"))
    # a field of an array of structs is the array of that field
    joined = [F.coalesce(F.array_join(F.col(f"_hits.{c}"), sep), F.lit("")).alias(name) for name, (c, sep) in values.items()]
    return queries.select(F.col("query_id").cast("long")).join(agg, "query_id", "left").select(
        "query_id", F.coalesce(count_name, F.lit(0)).cast("long").alias(count_name), *joined)


REQUESTS_SQL = sql_with("vec").rstrip() + "," + QN_SQL + """,
req AS (SELECT vec_id AS query_id, 'vector ' || CAST(vec_id AS VARCHAR) AS query,
               CASE WHEN vec_id % 3 > 0 THEN CAST(vec_id % 7 + 1 AS INTEGER) END AS lim,
               CASE WHEN vec_id % 4 > 0 THEN 0.1 * (vec_id % 6) END AS thr,
               CASE vec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE [CAST(vec_id % 50 AS VARCHAR), CAST(label AS VARCHAR), '7', '21'] END AS ids
        FROM embeddings),""" + _cand_sql(20) + """,
hits AS (SELECT c.query_id, c.cand_rank, c.score, v.chunk_id,
                row_number() OVER (PARTITION BY c.query_id ORDER BY c.cand_rank) AS rank, coalesce(r.lim, 10) AS lim
         FROM cand c JOIN req r ON r.query_id = c.query_id JOIN vec v ON v.vector_index_id = c.vector_index_id
         WHERE c.cand_rank <= 2 * coalesce(r.lim, 10) AND c.score >= coalesce(r.thr, 0.25)
           AND (r.ids IS NULL OR len(r.ids) = 0 OR list_contains(r.ids, v.document_id)))
SELECT r.query_id, r.query, count(h.chunk_id) AS total_results,
       coalesce(string_agg(h.chunk_id || '=' || CAST(round(h.score, 4) AS DECIMAL(9,4))::VARCHAR, ',' ORDER BY h.rank), '') AS results
FROM req r LEFT JOIN (SELECT * FROM hits WHERE rank <= lim) h ON h.query_id = r.query_id GROUP BY r.query_id, r.query"""


def request_table(spark, sf_dir):
    """Search requests with their own limit, threshold and document list, or none, from ``embeddings``."""
    e = fx.read(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    own = F.array((v % 50).cast("string"), F.col("label").cast("string"), F.lit("7"), F.lit("21"))
    ids = F.when(v % 5 == 0, F.lit(None)).when(v % 5 == 1, F.array().cast("array<string>")).otherwise(own)
    return e.select(v.alias("query_id"), F.concat(F.lit("vector "), v.cast("string")).alias("query"), "embedding",
                    F.when(v % 3 > 0, (v % 7 + 1).cast("int")).alias("limit"),
                    F.when(v % 4 > 0, F.lit(0.1) * (v % 6)).alias("similarity_threshold"), ids.alias("document_ids"))


@register("search_requests", REQUESTS_SQL)
def search_requests(spark, sf_dir):
    """One response per request: its query, the number of hits and the hits in order."""
    req, v = request_table(spark, sf_dir), fx.vec(spark, sf_dir)
    hits = K.search_requests(req, v, v, limit=fx.SEARCH_LIMIT, threshold=fx.SEARCH_THRESHOLD)
    score = F.round("similarity_score", 4).cast("decimal(9,4)").cast("string")
    hits = hits.select("query_id", "rank", F.concat_ws("=", "chunk_id", score).alias("hit"))
    resp = per_query_response(req, hits, {"results": ("hit", ",")}, "total_results")
    return req.select("query_id", "query").join(resp, "query_id").select("query_id", "query", "total_results", "results")


@register("search_response",
          search_sql(fx.SEARCH_LIMIT, fx.SEARCH_THRESHOLD, post_ids=fx.DOC_FILTER_IDS) + """
SELECT q.query_id, count(r.chunk_id) AS total_results,
       coalesce(string_agg(r.chunk_id, ',' ORDER BY r.rank), '') AS result_chunk_ids
FROM qraw q LEFT JOIN res r ON r.query_id = q.query_id GROUP BY q.query_id""")
def search_response(spark, sf_dir):
    hits = _search(spark, sf_dir, document_ids=fx.DOC_FILTER_IDS, filter_mode="post")
    return per_query_response(fx.query_vectors(spark, sf_dir), hits, {"result_chunk_ids": ("chunk_id", ",")}, "total_results")


@register("qa_context", search_sql(fx.QA_LIMIT, fx.QA_THRESHOLD) + """
SELECT q.query_id, count(r.chunk_id) AS n_sources,
       coalesce(string_agg(r.content, ' ' ORDER BY r.rank), '') AS context,
       coalesce(string_agg(r.chunk_id, ',' ORDER BY r.rank), '') AS source_chunk_ids
FROM qraw q LEFT JOIN res r ON r.query_id = q.query_id GROUP BY q.query_id""")
def qa_context(spark, sf_dir):
    hits = _search(spark, sf_dir, limit=fx.QA_LIMIT, threshold=fx.QA_THRESHOLD)
    q = fx.query_vectors(spark, sf_dir)
    out = per_query_response(q, hits, {"context": ("content", " "), "source_chunk_ids": ("chunk_id", ",")}, "n_sources")
    return out.select("query_id", "n_sources", "context", "source_chunk_ids")


@register("similar_documents", sql_with("vec").rstrip() + """,
reps AS (SELECT document_id AS source_document_id, arg_min(vector_index_id, chunk_index) AS query_id
         FROM vec GROUP BY document_id),
qn AS (SELECT r.query_id, r.source_document_id,
              CASE WHEN nrm > 0 THEN list_transform(e, lambda x: x / nrm) ELSE e END AS e
       FROM (SELECT vector_index_id, CAST(embedding AS DOUBLE[]) AS e,
                    sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS nrm
             FROM vec) v JOIN reps r ON r.query_id = v.vector_index_id),""" + _cand_sql(40) + """,
hits AS (SELECT c.query_id, q.source_document_id, c.cand_rank, c.score, v.document_id, v.chunk_id
         FROM cand c JOIN vec v ON v.vector_index_id = c.vector_index_id
                     JOIN qn q ON q.query_id = c.query_id
         WHERE c.score >= 0.25),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cand_rank) AS kr FROM hits QUALIFY kr <= 20),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kr) AS r FROM kept
        WHERE document_id <> source_document_id QUALIFY r <= 10),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY r) AS d FROM cut QUALIFY d = 1)
SELECT source_document_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS position,
       document_id, chunk_id, round(score, 6) AS similarity_score,
       count(*) OVER (PARTITION BY query_id) AS total_found
FROM best""")
def similar_documents(spark, sf_dir):
    v = fx.vec(spark, sf_dir)
    r = K.similar_documents(v, v, limit=fx.SEARCH_LIMIT, threshold=fx.SEARCH_THRESHOLD)
    return r.select("source_document_id", F.col("position").cast("long"), "document_id", "chunk_id",
                    F.round("similarity_score", 6).alias("similarity_score"), "total_found")


@register("corpus_stats", sql_with("doc_raw", "doc", "del_ids", "vec") + """
SELECT (SELECT count(*) FROM doc WHERE document_id NOT IN (SELECT document_id FROM del_ids)) AS document_count,
       (SELECT count(*) FROM vec WHERE document_id NOT IN (SELECT document_id FROM del_ids)) AS chunk_count,
       (SELECT count(*) FROM vec) AS vector_count,
       (SELECT count(*) FROM vec WHERE document_id NOT IN (SELECT document_id FROM del_ids)) AS live_vector_count,
       (SELECT count(*) FROM vec WHERE document_id IN (SELECT document_id FROM del_ids)) AS stale_vector_count,
       (SELECT CAST(max(len(embedding)) AS BIGINT) FROM vec) AS index_dimension""")
def corpus_stats(spark, sf_dir):
    dels = fx.deleted_ids(spark, sf_dir)
    v = fx.vec(spark, sf_dir)
    docs = tables.delete_by_ids(fx.doc(spark, sf_dir), dels)
    live_chunks = tables.delete_by_ids(v.drop("embedding"), dels)
    return tables.corpus_stats(docs, live_chunks, v)


@register("compact_vectors", sql_with("doc_raw", "del_ids", "vec") + """
SELECT vector_index_id, document_id, chunk_index FROM vec
WHERE document_id NOT IN (SELECT document_id FROM del_ids)""")
def compact_vectors(spark, sf_dir):
    v = fx.vec(spark, sf_dir)
    live = tables.delete_by_ids(v.drop("embedding"), fx.deleted_ids(spark, sf_dir))
    return tables.compact_vectors(v, live).select("vector_index_id", "document_id", "chunk_index")
