"""Content-hash de-duplication (E-4, H-1, G-7, D-J11).

Dedup keeps the lowest id per hash.  ``min`` by hash is a partial
aggregate, so a hash shared by a third of all rows still costs one row per
map task before the shuffle, never one giant sorted group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


def with_content_hash(articles: DataFrame) -> DataFrame:
    return articles.withColumn("content_hash", content_hash(F.col("headline"), F.col("description")))


def first_per_hash(hashed: DataFrame, order_col: str = "id") -> DataFrame:
    """(content_hash, keep_id): the first row of each hash."""
    return hashed.groupBy("content_hash").agg(F.min(order_col).alias("keep_id"))


def dedup_batch(articles: DataFrame) -> DataFrame:
    """H-1 within a batch: one row per content hash, the lowest id wins."""
    h = with_content_hash(articles)
    return first_rows(h, F.col("id")).select(*h.columns)


def first_rows(hashed: DataFrame, order: Column) -> DataFrame:
    """The whole first row of each content hash, as one partial aggregation: a hash that a third
    of the rows hold sends one row per map task."""
    rest = [c for c in hashed.columns if c != "content_hash"]
    return hashed.groupBy("content_hash").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("content_hash", "_r.*")


def insert_new(batch: DataFrame, table: DataFrame) -> DataFrame:
    """H-1 across runs / D-J11: rows of the de-duplicated batch whose hash is not stored yet."""
    existing = table.select("content_hash").where(F.col("content_hash").isNotNull())
    return dedup_batch(batch).join(existing, "content_hash", "left_anti")


#: Ids of a hash that one chunk may hold.
CHUNK = 4096


def mark_duplicates(articles: DataFrame) -> DataFrame:
    """G-7: among rows without a hash, the first of each hash gets it, the others
    get ``DUPLICATE_OF_<first id>``.  Output: id, content_hash, is_duplicate.

    Ids are gathered in chunks of a hash and an id range, so the first id meets a row per chunk and not
    a row per article; a hash that a third of the rows hold is spread over its chunks."""
    if "content_hash" in articles.columns:  # rows hashed before are neither marked again nor kept as the first
        articles = articles.filter(F.col("content_hash").isNull()).drop("content_hash")
    h = with_content_hash(articles).select("content_hash", "id")
    chunks = h.groupBy("content_hash", F.floor(F.col("id") / CHUNK).alias("part")).agg(F.collect_list("id").alias("ids"))
    keep = chunks.groupBy("content_hash").agg(F.min(F.array_min("ids")).alias("keep_id"))
    j = chunks.join(keep, "content_hash").select("content_hash", "keep_id", F.explode("ids").alias("id"))
    dup = F.col("id") != F.col("keep_id")
    return j.select(
        "id",
        F.when(dup, F.concat(F.lit("DUPLICATE_OF_"), F.col("keep_id").cast("string")))
        .otherwise(F.col("content_hash")).alias("content_hash"),
        dup.alias("is_duplicate"),
    )


def mark_duplicates_report(marked: DataFrame) -> DataFrame:
    """Run counters: unique hashes updated, duplicates marked, rows left without a hash."""
    return marked.agg(
        F.count_if(~F.col("is_duplicate")).alias("updated"),
        F.count_if(F.col("is_duplicate")).alias("duplicates"),
        F.count_if(F.col("content_hash").isNull()).alias("remaining"),
    )
