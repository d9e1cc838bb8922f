"""Plan-shape regression tests: pruning, partial aggregation, pre-shuffle top-k, no cartesian."""
import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "blindspot_report")
    docs = [line for line in plan.splitlines() if "documents.parquet" in line and "FileScan" in line]
    assert docs, plan
    for line in docs:
        cols = re.search(r"FileScan parquet \[([^\]]*)\]", line).group(1)
        assert "text" not in cols.split(","), line      # the long text column is never read here


def test_partial_aggregation_before_shuffle(spark):
    plan = _plan(spark, "blindspot_report")
    assert "partial_count" in plan


def test_topk_limits_before_shuffle(spark):
    plan = _plan(spark, "source_recent_articles")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_cartesian_products(spark):
    for name in ("clusters_filtered", "cluster_summary", "gazetteer_entities",
                 "popular_clusters", "token_upsert", "coverage_velocity", "earliest_article", "best_cluster_for_vector"):
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_a_lookup_of_articles_by_id_shuffles_their_texts_only(spark):
    """the semi join by id stands below the join of documents and events, and a text is cut before it."""
    from eventlens.sources.tables import DriverTables
    articles = DriverTables(spark, "/root/testdata/sf0.001").articles
    ids = spark.range(3)
    plan = articles.join(ids, "id", "left_semi").select("id", "published_at", "description")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Inner") < plan.index("LeftSemi")
    shuffled = articles.select("id", "headline")._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled.index("Inner") < shuffled.index("substring_index")
