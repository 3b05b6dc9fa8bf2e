"""Queries over small tables of their own: every row takes part."""

from pyspark.sql import functions as F

from intentlake.operators import index
from intentlake.plans import catalogue, pipelines


def test_every_request_is_judged_by_scores(spark, tmp_path):
    rows = [("a", 1, "One", 0.95), ("a", 2, "Two", 0.5), ("b", 3, "Two", 0.6), ("c", 4, None, 0.99), ("c", 5, "One", float("nan")), ("d", 6, "Two", 0.9), ("d", 7, "One", 0.97)]
    spark.createDataFrame(rows, "qid string, hit_id long, tool_name string, score double").write.parquet(f"{tmp_path}/hits.parquet")
    got = {r.qid: r for r in catalogue.queries()["evaluate_scored_rankings"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    assert (got["a"].recall_10, got["a"].hit_1, got["d"].recall_10, got["d"].ndcg_1) == (1, 1, 1, 1)
    for q in ("b", "c"):
        assert (got[q].recall_10, got[q].ndcg_10, got[q].full_coverage_3) == (0, 0, 1)
    strata = {r.stratum: r["count"] for r in catalogue.queries()["evaluate_scored_strata"](spark, str(tmp_path)).collect()}
    assert strata == {"all": 2, "single": 1, "multi": 1}


def test_pools_of_all_published_sizes(spark, tmp_path):
    tools = [(i, f"tool {i}") for i in range(250)]
    spark.createDataFrame(tools, "ord long, name string").write.parquet(f"{tmp_path}/tools.parquet")
    spark.createDataFrame([(0, "q", "tool 7")], "ord long, query string, ground_truth_tool string").write.parquet(f"{tmp_path}/cases.parquet")
    rows = catalogue.queries()["sample_pools_scaled"](spark, str(tmp_path)).groupBy("pool_size").count().collect()
    assert {r.pool_size: r["count"] for r in rows} == {n: n for n in (2, 5, 10, 20, 50, 100, 200)}
    assert {f"{q}_scaled" for q in ("filter_after_ranking", "filter_before_ranking", "evaluate_by_pool_size", "select_by_overlap")} <= set(catalogue.oracle_sql())


def test_dense_tools_count_all_units(spark, tmp_path):
    # Sixty units of one tool lie nearest, so a cut at fifty units would leave one tool.
    v = lambda x: [1.0, x] + [0.0] * 62
    rows = [(0, "query", v(0.0))] + [(i, "hot", v(i / 1e4)) for i in range(1, 61)] + [(60 + i, f"tool {i}", v(-0.5 - i)) for i in range(1, 13)]
    spark.createDataFrame(rows, "unit_id long, tool_name string, vector array<float>").write.parquet(f"{tmp_path}/query_augmented_units.parquet")
    got = catalogue.queries()["vector_unit_tools"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.tool for r in got] == ["hot", *[f"tool {i}" for i in range(1, 10)]]
    assert abs(got[0].score - 1.25) < 1e-6


def test_tfidf_statistics_are_of_the_pool(spark):
    docs = spark.createDataFrame([("a", "apple pear"), ("b", "pear"), ("c", "apple")], "name string, document string")
    drawn = spark.createDataFrame([(0, 2, "a", 1), (0, 2, "b", 2), (1, 2, "c", 1), (1, 2, "b", 2)], "ord long, pool_size int, name string, pos int")
    cases = spark.createDataFrame([(0, "apple"), (1, "plum")], "ord long, query string")
    idf = index.smooth_idf(drawn.join(docs, "name"), ["name"], F.col("document"), ["ord", "pool_size"])
    got = {(r.ord, r.term): r.df for r in idf.collect()}
    assert got == {(0, "apple"): 1, (0, "pear"): 2, (1, "apple"): 1, (1, "pear"): 1}
    rows = pipelines.pool_tfidf_ranking(cases, drawn, docs, 10).orderBy("ord", "rank").collect()
    assert [(r.ord, r.name, r.score > 0) for r in rows] == [(0, "a", True), (0, "b", False), (1, "c", False), (1, "b", False)]
