"""Online assignment, centroid update, window velocity, watermark dedup, cluster driver."""
import datetime as dt

from pyspark.sql import functions as F

from eventlens.plans import run_once as pipeline
from eventlens.sources.tables import DriverTables
from eventlens.streaming import jobs

AS_OF = dt.datetime(2025, 1, 3, 12, 0)


def test_assign_batch_and_update_centroids(spark):
    cents = spark.createDataFrame(
        [(10, [1.0, 0.0], AS_OF - dt.timedelta(hours=1), 2), (20, [0.0, 1.0], AS_OF - dt.timedelta(hours=200), 1)],
        "cluster_id long, centroid array<double>, created_at timestamp_ntz, n long")
    batch = spark.createDataFrame(
        [(1, 1, "h", "d", "2025-01-03 10:00:00", [0.9, 0.1]),     # matches cluster 10
         (2, 2, "h", "d", "2025-01-03 10:05:00", [0.1, 0.9]),     # cluster 20 is outside the 72 h window
         (3, 3, "h", "d", "2025-01-03 10:10:00", [0.12, 0.88])],  # joins article 2's new cluster
        "id long, source_id long, headline string, description string, published_at string, embedding array<float>")
    matched, fresh = jobs.assign_batch(batch, cents, F.lit(AS_OF).cast("timestamp_ntz"))
    assert [(r.cluster_id, r.article_id) for r in matched.collect()] == [(10, 1)]
    assert {r.article_id: r.cluster_id for r in fresh.collect()} == {2: 2, 3: 2}
    up = {r.cluster_id: r for r in jobs.update_centroids(cents, matched, batch).collect()}
    assert up[10].n == 3
    assert abs(up[10].centroid[0] - (2 * 1.0 + 0.9) / 3) < 1e-6 and up[20].centroid == [0.0, 1.0]


def test_velocity_from_windows(spark):
    t = dt.datetime(2025, 1, 1)
    counts = spark.createDataFrame(
        [(1, t, 2), (1, t + dt.timedelta(hours=6), 3), (1, t + dt.timedelta(hours=12), 0), (2, t, 4)],
        "cluster_id long, window_start timestamp_ntz, n long")
    v = {(r.cluster_id, r.window_start.hour): r for r in jobs.velocity_from_windows(counts).collect()}
    assert v[(1, 6)].velocity == 1.5 and v[(1, 6)].previous == 2
    assert v[(1, 0)].velocity == 2.0            # no previous window: velocity = recent count
    assert v[(1, 12)].velocity == 0.0


def test_dedup_within_watermark(spark, tmp_dir):
    rows = [("h1", dt.datetime(2025, 1, 1, 0)), ("h1", dt.datetime(2025, 1, 1, 1)), ("h2", dt.datetime(2025, 1, 1, 2))]
    spark.createDataFrame(rows, "content_hash string, event_time timestamp").write.parquet(f"{tmp_dir}/in")
    src = spark.readStream.schema("content_hash string, event_time timestamp").parquet(f"{tmp_dir}/in")
    q = jobs.dedup_within_watermark(src).writeStream.format("memory").queryName("dedup_test") \
        .trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted(r.content_hash for r in spark.table("dedup_test").collect()) == ["h1", "h2"]


def test_cluster_new_and_refresh(spark):
    t = DriverTables(spark, "/root/testdata/sf0.001")
    emb = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    none = spark.createDataFrame([], "cluster_id long, article_id long, similarity_score double")
    as_of = t.as_of()
    clusters, links, rejects = pipeline.cluster_new(t.articles, none, emb, t.sources, as_of, threshold=0.3)
    n_vec = emb.join(t.articles.select("id"), "id").count()
    assert links.count() + rejects.count() == n_vec
    cl = clusters.collect()
    assert len(cl) == links.select("cluster_id").distinct().count()
    assert all(r.blindspot_type is not None for r in cl if r.bias_coverage_pro is not None)
    refreshed = pipeline.refresh(clusters.withColumn("coverage_velocity", F.lit(None).cast("double"))
                                 .withColumn("is_trending", F.lit(None).cast("boolean"))
                                 .withColumn("last_coverage_check", F.lit(None).cast("timestamp_ntz"))
                                 .withColumn("first_seen_at", F.lit(None).cast("timestamp_ntz")),
                                 links, t.articles, as_of)
    assert refreshed.count() == len(cl)
    recent = F.to_timestamp("published_at", "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz") \
        >= as_of - F.expr("INTERVAL 48 HOURS")
    # clusters of the 48-hour look-back are refreshed, the others keep their values
    assert refreshed.filter(recent & F.col("coverage_velocity").isNull()).count() == 0
    assert refreshed.filter(~recent & F.col("coverage_velocity").isNotNull()).count() == 0
    assert refreshed.filter(recent).count() > 0
