"""The run-once job graph (C-10 and the ingest → cluster → score → notify chain).

    landed feed files → items (A-1…A-4) → parse (E-5…E-7) → feed registry (A-2)
    → sources get-or-create (H-2) → relevance gate (B-11) → content hash (E-4)
    → dedup against the table (H-1) → new article rows
    → unclustered (D-J2) → event clustering (C-4) → clusters (C-7)
    → blindspot (F-1/F-2) → trending refresh (F-5) → popular sweep (G-5, K-3)

Every stage is a DataFrame function; the boundaries become shuffles on
content_hash (dedup), time band / vector block (pairs), label (rounds) and
cluster_id (metrics).  Each phase's output is written as a new table version
by the caller (``write_version``), which also cuts the lineage.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.text import content_hash
from ..operators import bias, clustering, trending, upserts
from ..operators.dedup import first_rows
from ..operators.relevance import Lexicon, relevance_gate
from ..session import materialize
from ..sources.feeds import feed_key


@dataclass
class IngestResult:
    sources: DataFrame
    new_articles: DataFrame
    counts: DataFrame
    rejects: DataFrame


def ingest(parsed: DataFrame, registry: DataFrame, sources: DataFrame, articles: DataFrame,
           as_of: Column, lexicon: Lexicon = Lexicon(), filter_local: bool = False,
           parity: bool = False) -> IngestResult:
    """Parsed items → (sources table, new article rows, per-source counters F-19, rejects).

    The counters are the items read, those found relevant and those inserted; items of a
    folder that is not registered are rejects."""
    keyed = parsed.withColumn("feed_key", feed_key(F.col("path")))
    rejects = keyed.join(registry.select("feed_key"), "feed_key", "left_anti") \
        .select("path", "item_no", F.lit("unregistered feed").alias("reason"))
    x = keyed.join(registry, "feed_key")
    reg_src = registry.select(F.col("source").alias("url"), F.col("source").alias("name"),
                              F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("bias"))
    src = materialize(upserts.get_or_create_sources(sources, reg_src), "ingest-sources")  # the planner knows its size
    x = x.join(src.select(F.col("id").alias("source_id"), F.col("url").alias("source")), "source")
    read = x.groupBy("source_id").agg(F.count(F.lit(1)).alias("processed"))
    x = relevance_gate(x, lexicon, filter_local, parity)
    relevant = x.groupBy("source_id").agg(F.count(F.lit(1)).alias("relevant"))
    x = x.withColumn("published_at", F.nullif(F.col("published_at"), F.lit("N/A")))
    x = x.withColumn("content_hash", content_hash(F.col("headline"), F.col("description")))
    existing = articles.select("content_hash").where(F.col("content_hash").isNotNull())
    # ids in hash order (deterministic), given to the bare hashes: only these are sorted and written
    ids = upserts.next_ids(x.select("content_hash").distinct().join(existing, "content_hash", "left_anti"), articles, ["content_hash"])
    ids = ids.select(F.col("content_hash").alias("_hash"), "id")
    # first occurrence per hash inside the batch: feed order (path, item number)
    new = first_rows(x, F.struct("path", "item_no")).join(ids, F.col("content_hash").eqNullSafe(F.col("_hash")))
    new = new.select("id", "source_id", "headline", "description", "published_at",
                     as_of.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
                     "article_url", "image_url", "category", "content_hash")
    inserted = new.groupBy("source_id").agg(F.count(F.lit(1)).alias("inserted"))
    counts = read.join(relevant, "source_id", "left").join(inserted, "source_id", "left").fillna(0, ["relevant", "inserted"])
    return IngestResult(src, new, counts, rejects)


def tfidf_embeddings(docs: DataFrame, text_col: str = "text", id_col: str = "id",
                     dims: int = 256) -> DataFrame:
    """C-2 (re-aimed): hashed TF-IDF, L2-normalised, as ARRAY<DOUBLE> of ``dims``.

    IDF is fitted on the given corpus (one distributed aggregation)."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=1)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims)
    t = tf.transform(tok.transform(docs.select(id_col, text_col)))
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(t)
    n = Normalizer(inputCol="_idf", outputCol="_v", p=2.0).transform(idf.transform(t))
    return n.select(id_col, vector_to_array("_v").alias("embedding"))


def unclustered(articles: DataFrame, links: DataFrame, as_of: Column | None = None,
                hours: float | None = None) -> DataFrame:
    """D-J2: articles without a link row, of all times or of the ``hours`` before ``as_of`` (Q-6)."""
    if hours is not None:
        articles = articles.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))
    return articles.join(links.select(F.col("article_id").alias("id")), "id", "left_anti")


def cluster_new(articles: DataFrame, links: DataFrame, embeddings: DataFrame, sources: DataFrame,
                as_of: Column, threshold: float = fx.SIMILARITY_THRESHOLD,
                window_hours: float = fx.TIME_WINDOW_HOURS,
                hours: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C-10: unclustered articles → (new clusters with blindspot metrics, new links, rejects).

    Q-8: every result is a new cluster (existing clusters do not grow in this batch op).
    An article without a vector is among the rejects."""
    todo = unclustered(articles, links, as_of, hours).join(embeddings.select("id", "embedding"), "id", "left")
    pts, rejects = clustering.prepare(todo)
    lab = clustering.cluster_labels(pts, threshold, window_hours)
    new_links = lab.select(F.col("label").alias("cluster_id"), F.col("id").alias("article_id"),
                           F.col("score").alias("similarity_score"))
    cl = clustering.materialize_clusters(new_links, articles, created_at=as_of)
    metrics = bias.blindspot_metrics(new_links, articles, sources)
    return bias.apply_blindspot(cl, metrics), new_links, rejects


def refresh(clusters: DataFrame, links: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """F-5 write-back: refreshed values for clusters of the look-back, others unchanged."""
    r = trending.refresh_trending(clusters, links, articles, as_of)
    upd = r.select("id", "coverage_velocity", "is_trending", "last_coverage_check", "first_seen_at")
    keep = clusters.join(upd.select("id"), "id", "left_anti")
    cols = clusters.columns
    fresh = clusters.drop("coverage_velocity", "is_trending", "last_coverage_check", "first_seen_at") \
        .join(upd, "id")
    return keep.unionByName(fresh.select(*[c for c in cols if c in fresh.columns]), allowMissingColumns=True)


def write_version(df: DataFrame, root: str, name: str, version: int) -> DataFrame:
    """Write a table version (write-then-swap) and read it back: the lineage stops here."""
    path = f"{root.rstrip('/')}/{name}/v{version:06d}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
