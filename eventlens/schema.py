"""Declared schemas of the application tables (the data model)."""
from __future__ import annotations

from pyspark.sql import types as T

from .fixed_values import ENTITY_LIST_KEYS

_S = T.StringType()
_L = T.LongType()
_TS = T.TimestampNTZType()

SOURCES = T.StructType([
    T.StructField("id", _L, False),
    T.StructField("name", _S), T.StructField("url", _S), T.StructField("language", _S),
    T.StructField("owner", _S), T.StructField("founded_at", _S),
    T.StructField("hq_location", _S), T.StructField("bias", _S),
])

ARTICLES = T.StructType([
    T.StructField("id", _L, False),
    T.StructField("source_id", _L),
    T.StructField("headline", _S), T.StructField("description", _S),
    T.StructField("published_at", _S),
    T.StructField("created_at", _TS), T.StructField("updated_at", _TS),
    T.StructField("article_url", _S), T.StructField("image_url", _S),
    T.StructField("category", _S), T.StructField("content_hash", _S),
])

CLUSTERS = T.StructType([
    T.StructField("id", _L, False),
    T.StructField("title", _S),
    T.StructField("number_of_sources", _L),
    T.StructField("published_at", _S),
    T.StructField("created_at", _TS),
    T.StructField("blindspot_type", _S),
    T.StructField("bias_coverage_pro", _L), T.StructField("bias_coverage_neutral", _L),
    T.StructField("bias_coverage_oppose", _L),
    T.StructField("bias_balance_score", T.DoubleType()),
    T.StructField("coverage_velocity", T.DoubleType()),
    T.StructField("is_trending", T.BooleanType()),
    T.StructField("first_seen_at", _TS), T.StructField("last_coverage_check", _TS),
])

CLUSTER_ARTICLES = T.StructType([
    T.StructField("cluster_id", _L, False),
    T.StructField("article_id", _L, False),
    T.StructField("similarity_score", T.DoubleType()),
])

ENTITIES = T.StructType(
    [T.StructField("id", _L, False), T.StructField("article_id", _L)]
    + [T.StructField(k, T.ArrayType(_S)) for k in ENTITY_LIST_KEYS]
    + [T.StructField("category", _S), T.StructField("created_at", _TS)]
)

USER_TOKENS = T.StructType([
    T.StructField("id", _L, False), T.StructField("user_id", _L),
    T.StructField("device_id", _S), T.StructField("token", _S), T.StructField("platform", _S),
    T.StructField("created_at", _TS), T.StructField("updated_at", _TS),
])

# Landed feed item (RSS <item>), as read by the XML source.
FEED_ITEM = T.StructType([
    T.StructField("title", _S),
    T.StructField("description", _S),
    T.StructField("pubDate", _S),
    T.StructField("link", _S),
    T.StructField("content", T.StructType([T.StructField("_url", _S)])),  # media:content
    T.StructField("encoded", _S),                                         # content:encoded
    T.StructField("_corrupt_record", _S),
])

# Bias rating file (JSON array).
BIAS_RATING = T.StructType([
    T.StructField("Source_name", _S), T.StructField("website_url", _S), T.StructField("Bias", _S),
])

COVERAGE_HISTORY = T.StructType([
    T.StructField("cluster_id", _L), T.StructField("checked_at", _TS),
    T.StructField("recent", _L), T.StructField("previous", _L),
    T.StructField("velocity", T.DoubleType()),
])
