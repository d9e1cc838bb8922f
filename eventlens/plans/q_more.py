"""Driver-bound queries: sidebar, topics, notification stats, article detail,
TF-IDF vectors and the two streaming jobs (run with AvailableNow, read back)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import serving
from ..session import ensure_checkpoint_dir, materialize
from ..sources import feeds
from ..sources.tables import DriverTables
from ..streaming import jobs
from . import sqlgen as S
from .run_once import tfidf_embeddings
from .q_text import TEST_LEXICON
from .registry import query


@query("topic_sidebar", """
select id, title, published_at from v_clusters c
where c.id in (select l.cluster_id from v_links l join v_entities e on e.article_id = l.article_id
               where e.category = 'security')
order by published_at desc nulls last, id desc limit 5""")
def topic_sidebar(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.topic_sidebar(t.clusters, t.links, t.entities, "security", 5, topic_map={}) \
        .select("id", "title", "published_at")


@query("distinct_topics", "select distinct category from v_entities where category is not null")
def distinct_topics(spark, sf_dir):
    return serving.distinct_topics(DriverTables(spark, sf_dir).entities)


@query("notification_stats", """
WITH newest AS (
  select *, row_number() over (order by published_at desc nulls last, id desc) as rr
  from v_clusters order by published_at desc nulls last, id desc limit 100),
cnt AS (select cluster_id, count(*) as n from v_links group by cluster_id),
pop AS (select n.id from newest n join cnt on cnt.cluster_id = n.id
        where n.created_at >= (select as_of from v_asof) - INTERVAL 48 HOUR and cnt.n >= 2
        order by cnt.n desc, n.rr limit 10)
select (select count(*) from v_tokens) as total_tokens,
  (select count(*) from v_tokens where platform = 'ios') as ios_tokens,
  (select count(*) from v_tokens where platform = 'android') as android_tokens,
  (select count(*) from pop) as popular_clusters_count""")
def notification_stats(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    tk = t.tokens
    pop = serving.popular_clusters(t.clusters, t.links, t.as_of())
    return tk.agg(F.count(F.lit(1)).alias("total_tokens"),
                  F.count_if(F.col("platform") == "ios").alias("ios_tokens"),
                  F.count_if(F.col("platform") == "android").alias("android_tokens")) \
        .withColumn("popular_clusters_count", pop.agg(F.count(F.lit(1))).scalar())


@query("article_with_entities", """
select a.id, a.headline, a.published_at, s.name as source_name, s.url as source_url, a.category,
  e.cities, e.category as nlp_category
from v_articles a left join v_sources s on s.id = a.source_id left join v_entities e on e.article_id = a.id""")
def article_with_entities(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    ent = t.entities.select("id", "article_id", "cities", "category")
    x = E.article_with_entities(t.articles, ent, t.sources)
    return x.select("id", "headline", "published_at", "source_name", "source_url", "category",
                    F.col("entities.cities").alias("cities"), F.col("entities.nlp_category").alias("nlp_category"))


@query("tfidf_embeddings")
def tfidf(spark, sf_dir):
    d = DriverTables(spark, sf_dir).raw("documents")
    v = tfidf_embeddings(d.select(F.col("doc_id").alias("id"), "text"), dims=256)
    nnz = F.size(F.filter("embedding", lambda x: x != 0))
    return v.select("id", nnz.alias("nonzero"),
                    F.bround(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/eventlens-{name}-{uuid.uuid4().hex}"


@query("stream_ingest", f"""
WITH h AS (select {S.content_hash('headline', 'description')} as content_hash, 'src' || source_id as feed from v_articles),
s AS (select feed, row_number() over (order by feed) as source_id from (select distinct feed from h)),
k AS (select content_hash, min(feed) as feed from h group by content_hash)
select row_number() over (order by content_hash) as id, source_id, content_hash, 'local' as category
from k join s on s.feed = k.feed""")
def stream_ingest(spark, sf_dir):
    """Every article of the test binding landed as a one-item RSS document (one per line,
    files per source), streamed through L-1 into a scratch table, read back."""
    t = DriverTables(spark, sf_dir)
    root = _scratch(spark, "stream-ingest")
    item = F.concat(
        F.lit('<?xml version="1.0"?><rss><channel><item><title><![CDATA['), F.col("headline"),
        F.lit("]]></title><description><![CDATA["), F.col("description"),
        F.lit("]]></description><pubDate>"), F.col("published_at"),
        F.lit("</pubDate><link>http://example.org/a/"), F.col("id").cast("string"),
        F.lit("</link></item></channel></rss>"))
    a = t.articles.select(F.concat(F.lit("src"), F.col("source_id").cast("string")).alias("feed"),
                          item.alias("value"))
    a.write.partitionBy("feed").text(f"{root}/land")  # a task writes a file for each of its feeds
    reg = materialize(feeds.registry_from(a.select(F.concat(F.lit("feed="), "feed").alias("feed_key"),
                                                   F.col("feed").alias("source")).distinct()), "stream-registry")
    q = feeds.feed_item_stream(spark, f"{root}/land", glob="*.txt").writeStream \
        .foreachBatch(jobs.upsert_batch(f"{root}/tables", reg, TEST_LEXICON)) \
        .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/tables/articles").select("id", "source_id", "content_hash", "category")


@query("stream_windowed_coverage", """
select l.cluster_id, time_bucket(INTERVAL 6 HOUR, a.created_at) as window_start, count(*) as n
from v_links l join v_articles a on a.id = l.article_id group by 1, 2""")
def stream_windowed_coverage(spark, sf_dir):
    """Link events (cluster, created_at) streamed through L-3 in update mode; the last
    update per (cluster, window) is the count."""
    t = DriverTables(spark, sf_dir)
    root = _scratch(spark, "stream-coverage")
    ev = t.links.join(t.articles.select(F.col("id").alias("article_id"), "created_at"), "article_id") \
        .select("cluster_id", F.col("created_at").cast("timestamp").alias("created_at"))
    ev.write.parquet(f"{root}/events")
    src = spark.readStream.schema("cluster_id long, created_at timestamp").parquet(f"{root}/events")

    def sink(batch, epoch_id):
        batch.withColumn("epoch", F.lit(epoch_id)).write.mode("append").parquet(f"{root}/out")

    q = jobs.windowed_coverage(src).writeStream.outputMode("update").foreachBatch(sink) \
        .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("cluster_id", F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.max("n").alias("n"))

