"""Notifications as data (K-1 … K-6, F-18): messages and a delivery outbox.

Delivery to a push service is outside the engine; the outbox table is what a
sender consumes.  The fan-out joins every message with every active token;
the messages are written first, so the planner sees their size and broadcasts
them while they are small.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.dates import parse_iso
from ..session import materialize
from .serving import cluster_articles


def active_tokens(tokens: DataFrame) -> DataFrame:
    """K-1: tokens with a value."""
    return tokens.filter(F.col("token").isNotNull()).select("token", "platform")


def message_data(kind: str, **more: Column) -> Column:
    """The data map that goes with a message; all values are text."""
    pairs = {"clusterId": F.col("cluster_id"), "type": F.lit(kind)} | more
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


def new_cluster_messages(clusters: DataFrame) -> DataFrame:
    """K-2: one message per cluster."""
    return clusters.withColumnRenamed("id", "cluster_id").select(
        "cluster_id",
        F.lit(fx.NEW_CLUSTER_TITLE).alias("title"),
        F.concat(F.lit(fx.NEW_CLUSTER_BODY_PREFIX), F.substring("title", 1, fx.TRUNCATE_TITLE),
                 F.lit("...")).alias("body"),
        F.lit("new_cluster").alias("type"), message_data("new_cluster").alias("data"))


def popular_messages(popular: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """K-3: per popular cluster, the earliest dated article's headline (first 50 chars) and
    'N sources – date'; without any parseable date, the cluster title and an article count."""
    ca = cluster_articles(links.join(popular.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi"),
                          articles).withColumn("_t", parse_iso("published_at"))
    g = ca.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("article_count"),
        F.min_by(F.struct("headline", "_t"), F.when(F.col("_t").isNotNull(), F.struct("_t", "article_id")))
        .alias("e"))
    p = popular.select(F.col("id").alias("cluster_id"), F.col("title").alias("cluster_title"))
    j = p.join(g, "cluster_id")
    dated = F.col("e._t").isNotNull()
    title = F.when(dated, F.substring(F.coalesce("e.headline", "cluster_title"), 1, fx.TRUNCATE_TITLE)) \
        .otherwise(F.substring("cluster_title", 1, fx.TRUNCATE_TITLE))
    body = F.when(dated, F.concat(F.lit(fx.POPULAR_BODY_PREFIX), F.col("article_count").cast("string"),
                                  F.lit(fx.POPULAR_BODY_SOURCES), F.date_format("e._t", "yyyy-MM-dd HH:mm"))) \
        .otherwise(F.concat(F.lit(fx.POPULAR_FALLBACK_PREFIX), F.col("article_count").cast("string"),
                            F.lit(fx.POPULAR_FALLBACK_SUFFIX)))
    return j.select("cluster_id", title.alias("title"), body.alias("body"), "article_count",
                    F.lit("popular_cluster").alias("type"),
                    message_data("popular_cluster", articleCount=F.col("article_count")).alias("data"))


def custom_message(spark, title: str, body: str, kind: str = "custom") -> DataFrame:
    """K-4: a single literal message."""
    return spark.createDataFrame([(None, title, body, kind)],
                                 "cluster_id long, title string, body string, type string")


def outbox(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """K-5: every message × every active token, which is the feature.  The messages are written
    once, so their plan runs once and the planner chooses the join from their real size."""
    data = F.col("data") if "data" in messages.columns else F.lit(None).cast("map<string,string>")
    m = materialize(messages.select("cluster_id", "title", "body", "type", data.alias("data")), "outbox-messages")
    return active_tokens(tokens).join(m, how="cross")


def delivery_counts(results: DataFrame) -> DataFrame:
    """F-18: success / failure totals of a delivery-result table (status column)."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def popular_sweep(clusters: DataFrame, links: DataFrame, articles: DataFrame, tokens: DataFrame,
                  as_of: Column) -> tuple[DataFrame, DataFrame]:
    """K-6: popular clusters → one message each → outbox rows, plus the per-cluster
    summary (cluster, title, sources, queued deliveries) the sweep reports."""
    from .serving import popular_clusters
    pop = popular_clusters(clusters, links, as_of)
    msgs = popular_messages(pop, links, articles)
    box = outbox(msgs, tokens)
    queued = box.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("queued"))
    summary = pop.select(F.col("id").alias("cluster_id"), "title", F.col("number_of_sources").alias("sources")) \
        .join(queued, "cluster_id", "left").fillna(0, ["queued"])
    return box, summary
