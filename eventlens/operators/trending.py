"""Coverage velocity and trending (F-4, F-5, G-3, L-5).

One pass: link ⋈ article → conditional counts per cluster (partial
aggregation before the shuffle on cluster_id) → left join onto clusters.
``as_of`` is a Column (a literal or a scalar subquery), never the wall clock.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.dates import parse_ntz


def _hours(h: float) -> Column:
    return F.expr(f"INTERVAL {int(h * 3600)} SECONDS")


def coverage_counts(links: DataFrame, articles: DataFrame, as_of: Column,
                    recent_hours: float = fx.RECENT_HOURS,
                    previous_hours: float = fx.PREVIOUS_HOURS) -> DataFrame:
    """(cluster_id, recent_count, previous_count) over linked articles' created_at, for the
    clusters with an article in either span.  Older articles are filtered before the join."""
    six, twelve = as_of - _hours(recent_hours), as_of - _hours(previous_hours)
    a = articles.select(F.col("id").alias("article_id"), "created_at").filter(F.col("created_at") > twelve)
    c = F.col("created_at")
    return links.select("cluster_id", "article_id").join(a, "article_id").groupBy("cluster_id").agg(
        F.count_if(c > six).alias("recent_count"),
        F.count_if(c <= six).alias("previous_count"),
    )


def velocity(recent: Column, previous: Column) -> Column:
    return (F.when(previous > 0, recent / previous)
            .when(recent > 0, recent.cast("double"))
            .otherwise(F.lit(0.0)))


def coverage_velocity(clusters: DataFrame, links: DataFrame, articles: DataFrame, as_of: Column,
                      threshold: float = fx.TRENDING_VELOCITY,
                      min_sources: int = fx.TRENDING_MIN_SOURCES) -> DataFrame:
    """F-4 for every cluster row: counts, rounded velocity, trending flag, check time.
    Trending compares the *unrounded* velocity."""
    cnt = coverage_counts(links.join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi"), articles, as_of)
    j = clusters.join(cnt, clusters.id == cnt.cluster_id, "left").drop("cluster_id")
    r = F.coalesce(F.col("recent_count"), F.lit(0)).cast("long")
    p = F.coalesce(F.col("previous_count"), F.lit(0)).cast("long")
    v = velocity(r, p)
    first_seen = F.coalesce(F.col("first_seen_at"), F.col("created_at")) if "first_seen_at" in clusters.columns \
        else F.col("created_at")
    return j.withColumns({
        "recent_count": r,
        "previous_count": p,
        "velocity_raw": v,
        "coverage_velocity": F.bround(v, 2),
        "is_trending": (v > threshold) & (F.col("number_of_sources") >= min_sources),
        "last_coverage_check": as_of,
        "first_seen_at": first_seen,
    })


def refresh_trending(clusters: DataFrame, links: DataFrame, articles: DataFrame, as_of: Column,
                     lookback_hours: float = fx.TRENDING_LOOKBACK_HOURS) -> DataFrame:
    """F-5: F-4 over clusters published within the look-back; other clusters keep their values."""
    pub = parse_ntz("published_at")
    recent = clusters.filter(pub >= as_of - _hours(lookback_hours))
    return coverage_velocity(recent, links, articles, as_of)


def trending_topk(refreshed: DataFrame, as_of: Column, k: int = 10,
                  lookback_hours: float = fx.TRENDING_LOOKBACK_HOURS) -> DataFrame:
    """G-3: trending clusters of the look-back, velocity desc (id breaks ties), top k."""
    pub = parse_ntz("published_at")
    return (refreshed.filter(F.col("is_trending") & (pub >= as_of - _hours(lookback_hours)))
            .orderBy(F.desc("coverage_velocity"), F.asc("id")).limit(k))


def coverage_history_rows(refreshed: DataFrame) -> DataFrame:
    """L-5: one history row per refreshed cluster (append to the history table)."""
    return refreshed.select(
        F.col("id").alias("cluster_id"), F.col("last_coverage_check").alias("checked_at"),
        F.col("recent_count").alias("recent"), F.col("previous_count").alias("previous"),
        F.col("coverage_velocity").alias("velocity"),
    )


def coverage_history(links: DataFrame, articles: DataFrame, until: Column, step_hours: int = fx.RECENT_HOURS,
                     recent_hours: int = fx.RECENT_HOURS, previous_hours: int = fx.PREVIOUS_HOURS,
                     threshold: float = fx.TRENDING_VELOCITY) -> DataFrame:
    """L-5 + F-4 in one pass: (cluster_id, checked_at, recent, previous, velocity) at every check time, the multiples of
    ``step_hours`` since 1970 up to ``until``, at which the cluster has an article in either span.

    An article counts as recent at the checks of the ``recent_hours`` after it and as previous at those up to
    ``previous_hours``.  Articles are counted per cluster and step first, so a cluster with a third of all articles
    sends a row per step, and each step adds to the same few checks; no window over a cluster's rows is needed."""
    if recent_hours % step_hours or previous_hours % step_hours:
        raise ValueError("the spans must be multiples of the step")
    step, recent, both = step_hours * 3_600_000_000, recent_hours // step_hours, previous_hours // step_hours
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at"))
    a = articles.filter(F.col("created_at") <= until).select(F.col("id").alias("article_id"), F.floor((us + (step - 1)) / step).cast("long").alias("first"))
    steps = links.select("cluster_id", "article_id").join(a, "article_id").groupBy("cluster_id", "first").agg(F.count(F.lit(1)).alias("n"))
    seen = steps.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(both - 1))))
    counts = seen.groupBy("cluster_id", (F.col("first") + F.col("age")).alias("check")).agg(
        F.sum(F.when(F.col("age") < recent, F.col("n")).otherwise(0)).alias("recent"),
        F.sum(F.when(F.col("age") >= recent, F.col("n")).otherwise(0)).alias("previous"))
    at = F.timestamp_add("HOUR", (F.col("check") * step_hours).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    v = velocity(F.col("recent"), F.col("previous"))
    return counts.select("cluster_id", at.alias("checked_at"), "recent", "previous", F.bround(v, 2).alias("velocity"), (v > threshold).alias("rising")) \
        .filter(F.col("checked_at") <= until)
