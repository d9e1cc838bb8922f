"""Structured Streaming re-aims of the periodic batch (L-1 … L-5).

The reference re-runs its batch on a timer and relies on the content hash for
idempotence.  Here the same DataFrame functions run inside streaming queries;
``Trigger.AvailableNow`` replaces the scheduler.

* L-1 ingest: landed files → items → parsed articles → ``foreachBatch`` upsert
  (anti join on content_hash against the key index, ``keys.py``, then append): exact,
  unbounded de-duplication across runs, and replays of a micro-batch are
  harmless because the anti join sees the rows already written.
* L-2 bounded-state dedup: ``dropDuplicatesWithinWatermark`` on the hash.
* L-3 windowed coverage: link events counted per (6-hour window, cluster)
  under a watermark; velocity = this window / previous window.
* L-4 online assignment: each micro-batch is matched against the stored
  centroids (C-8); the rest is clustered among itself (C-4).
* L-5 coverage history: refresh rows appended per check.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.text import content_hash
from ..operators import clustering, similarity
from ..operators.relevance import Lexicon
from ..session import materialize
from ..sources.feeds import feed_item_stream, items_from_text, parse_items
from .keys import KeyIndex


def upsert_batch(table_path: str, registry: DataFrame, lexicon: Lexicon = Lexicon()):
    """``foreachBatch`` body of L-1: ingest one micro-batch into the article table.

    Which hashes are stored comes from the key index, of which a batch reads its own prefixes only.  A batch
    that is replayed finds its rows there, or in article files that were not indexed yet, and adds nothing."""
    from ..plans.run_once import ingest
    from ..schema import SOURCES

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        parsed = materialize(parse_items(items_from_text(batch)), "ingest-items")  # read and parsed once
        spark.createDataFrame([], SOURCES).write.mode("ignore").parquet(f"{table_path}/sources")  # a no-op but for the first batch
        sources = spark.read.schema(SOURCES).parquet(f"{table_path}/sources")
        index = KeyIndex(spark, table_path)
        stored = index.stored(parsed.select(content_hash(F.col("headline"), F.col("description")).alias("content_hash")))
        as_of = F.current_timestamp().cast("timestamp_ntz")
        res = ingest(parsed, registry, sources, stored, as_of, lexicon)
        new_src = res.sources.join(sources.select("url"), "url", "left_anti")
        new_src.write.mode("append").parquet(f"{table_path}/sources")
        res.new_articles.write.mode("append").parquet(f"{table_path}/articles")  # the ids are fixed in a table of their own
        index.refresh()

    return run


def start_ingest(spark: SparkSession, landing: str, table_path: str, checkpoint: str,
                 registry: DataFrame, lexicon: Lexicon = Lexicon()):
    """L-1: process every file landed so far, then stop (AvailableNow)."""
    return feed_item_stream(spark, landing).writeStream \
        .foreachBatch(upsert_batch(table_path, registry, lexicon)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_within_watermark(stream: DataFrame, ts_col: str = "event_time", delay: str = "48 hours") -> DataFrame:
    """L-2: drop repeated content hashes seen within the watermark delay (bounded state)."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_coverage(link_events: DataFrame, ts_col: str = "created_at",
                      width: str = f"{fx.RECENT_HOURS} hours", delay: str = "12 hours") -> DataFrame:
    """L-3: article count per (window, cluster); rows are final once the watermark passes."""
    return link_events.withWatermark(ts_col, delay) \
        .groupBy(F.window(ts_col, width).alias("w"), "cluster_id").agg(F.count(F.lit(1)).alias("n")) \
        .select("cluster_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def velocity_from_windows(counts: DataFrame, width_hours: int = fx.RECENT_HOURS) -> DataFrame:
    """L-3 (batch view of the sink): velocity of each window against the window before it."""
    prev = counts.select("cluster_id",
                         (F.col("window_start") + F.expr(f"INTERVAL {width_hours} HOURS")).alias("window_start"),
                         F.col("n").alias("prev_n"))
    j = counts.join(prev, ["cluster_id", "window_start"], "left")
    p = F.coalesce(F.col("prev_n"), F.lit(0))
    v = F.when(p > 0, F.col("n") / p).when(F.col("n") > 0, F.col("n").cast("double")).otherwise(F.lit(0.0))
    return j.select("cluster_id", "window_start", "n", p.alias("previous"), F.bround(v, 2).alias("velocity"))


def assign_batch(batch: DataFrame, centroids: DataFrame, as_of, threshold: float = fx.SIMILARITY_THRESHOLD,
                 window_hours: float = fx.TIME_WINDOW_HOURS) -> tuple[DataFrame, DataFrame]:
    """L-4: (links to existing clusters, links of new clusters) for one micro-batch of
    (id, source_id, headline, description, published_at, embedding).

    A cluster takes one article of a source: of the batch's matches the first by (published_at, id), and none of
    a source that the cluster has (``sources``, a list of strings, if the centroids carry it).  What is not taken is clustered
    with the rest."""
    best = similarity.best_cluster_for_vectors(batch.select("id", "embedding"), centroids, as_of, threshold)
    j = best.join(batch.select("id", F.col("source_id").cast("string").alias("src"), "published_at"), "id")
    if "sources" in centroids.columns:
        j = j.join(centroids.select("cluster_id", "sources"), "cluster_id").filter(
            ~F.coalesce(F.array_contains("sources", F.col("src")), F.lit(False)))
    taken = j.groupBy("cluster_id", "src").agg(F.min_by(F.struct("id", "similarity"), F.struct("published_at", "id")).alias("m"))
    matched = materialize(taken.select("cluster_id", F.col("m.id").alias("article_id"), F.col("m.similarity").alias("similarity_score")), "l4-matched")
    rest = batch.join(matched.select(F.col("article_id").alias("id")), "id", "left_anti")
    pts, _ = clustering.prepare(rest)
    lab = clustering.cluster_labels(pts, threshold, window_hours)
    fresh = lab.select(F.col("label").alias("cluster_id"), F.col("id").alias("article_id"),
                       F.col("score").alias("similarity_score"))
    return matched, fresh


def update_centroids(centroids: DataFrame, matched: DataFrame, vectors: DataFrame) -> DataFrame:
    """L-4 / C-9: fold newly matched vectors into the stored means (count-weighted)."""
    add = matched.join(vectors.select(F.col("id").alias("article_id"), "embedding"), "article_id")
    s = similarity.centroids(add.select("cluster_id", "embedding")) \
        .join(add.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("k")), "cluster_id")
    j = centroids.join(s.select("cluster_id", F.col("centroid").alias("add_mean"), "k"), "cluster_id", "left")
    k = F.coalesce(F.col("k"), F.lit(0))
    merged = F.when(k > 0, F.zip_with("centroid", "add_mean",
                                      lambda c, a: (c * F.col("n") + a * k) / (F.col("n") + k))) \
        .otherwise(F.col("centroid"))
    return j.select("cluster_id", merged.alias("centroid"), (F.col("n") + k).alias("n"),
                    *[c for c in centroids.columns if c not in ("cluster_id", "centroid", "n")])


def history_rows(refreshed: DataFrame) -> DataFrame:
    """L-5: one (cluster, checked_at, recent, previous, velocity) row per refresh."""
    from ..operators.trending import coverage_history_rows
    return coverage_history_rows(refreshed)

