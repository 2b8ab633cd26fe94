"""Physical-plan properties we rely on at scale."""

from tessera.operators import knn as K, tables
from tessera.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paging_is_take_ordered(spark):
    p = _plan(tables.list_documents(fx.doc(spark, SF), limit=50, offset=10))
    assert "TakeOrderedAndProject" in p


def test_knn_final_rank_uses_window_group_limit(spark):
    q = fx.query_vectors(spark, SF)
    p = _plan(K.knn(q, fx.vec(spark, SF), 10))
    assert "WindowGroupLimit" in p
    assert "SinglePartition" not in p


def test_planning_runs_no_job_and_deals_by_block(spark):
    """Building the search plans over read tables starts no Spark job; vectors are dealt by block, never round-robin."""
    q, v = fx.query_vectors(spark, SF), fx.vec(spark, SF)
    group = f"plan-{id(q)}"
    spark.sparkContext.setJobGroup(group, "planning")
    try:
        frames = [K.knn(q, v, 10), K.semantic_search(q, v, v),
                  K.semantic_search(q, v, v, document_ids=["1"], filter_mode="pre"), K.similar_documents(v, v)]
        plans = [_plan(f) for f in frames]
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert not any("RoundRobin" in p for p in plans)
    assert "hashpartitioning(vb" in plans[0] and "BroadcastNestedLoop" not in plans[0] and "CartesianProduct" not in plans[0]


def test_filters_and_columns_reach_the_scan(spark):
    df = fx.read(spark, SF, "documents").where("doc_id = 3").select("doc_id", "lang")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_short_id_list_is_pushed_to_the_scan(spark):
    df = fx.read(spark, SF, "documents").withColumnRenamed("doc_id", "document_id")
    p = _plan(tables.restrict_to_ids(df, [3, 1]))
    assert "PushedFilters: [In(doc_id, [1,3])]" in p or "In(doc_id" in p
    ids = spark.createDataFrame([(3,), (1,)], "document_id long")
    assert tables.restrict_to_ids(df, ids).count() == 2


def test_summariser_adds_no_exchange_after_reassembly(spark):
    from tessera.operators import chunking, nlp
    text = chunking.reassemble_text(fx.stored_chunks(spark, SF))
    plan = nlp.summarize(text)._jdf.queryExecution().executedPlan().toString()
    base = text._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == base.count("Exchange")
