"""Compositions over the driver tables: homepage, popular sweep, cluster integrity."""
from pyspark.sql import functions as F

from eventlens.operators import clustering, notify, serving
from eventlens.sources.tables import DriverTables

SF = "/root/testdata/sf0.001"


def test_homepage_parts(spark):
    t = DriverTables(spark, SF)
    parts = serving.homepage(t.clusters, t.links, t.articles, t.sources, t.entities, t.as_of(), 1, 20)
    assert set(parts) == {"clusters", "pages", "cities", "sidebar", "trending", "cards"}
    cards = parts["cards"].collect()
    assert len(cards) == 20 and all(c.category_label and c.dominant_label and c.ago for c in cards)
    assert parts["clusters"].count() == 20
    page = parts["pages"].collect()[0]
    assert page.page_numbers == [1, 2, 3]          # 49 clusters / 20 per page
    assert parts["sidebar"].count() <= 5 and parts["trending"].count() <= 5


def test_popular_sweep(spark):
    t = DriverTables(spark, SF)
    box, summary = notify.popular_sweep(t.clusters, t.links, t.articles, t.tokens, t.as_of())
    n_tokens = t.tokens.filter(F.col("token").isNotNull()).count()
    rows = summary.collect()
    assert 0 < len(rows) <= 10
    assert all(r.queued == n_tokens for r in rows)
    assert box.count() == n_tokens * len(rows)


def test_event_clusters_one_article_per_source(spark):
    t = DriverTables(spark, SF)
    links = clustering.event_clusters(t.vectors, threshold=0.3)
    j = links.join(t.articles.select(F.col("id").alias("article_id"), "source_id"), "article_id")
    assert j.groupBy("cluster_id", "source_id").count().filter("count > 1").count() == 0
    assert links.count() == t.vectors.count()
    roots = links.filter(F.col("cluster_id") == F.col("article_id"))
    assert roots.filter(F.col("similarity_score") != 1.0).count() == 0
    cl = clustering.materialize_clusters(links, t.articles)
    assert cl.count() == roots.count()
