"""Coverage balance of an event across source leanings (blindspots).

All metrics are one shuffle on ``cluster_id`` with map-side partial
aggregation (``count_if``), so a hot cluster costs one row per map task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx


def bias_side(bias: Column) -> Column:
    """'pro' / 'oppose' / 'neutral' from a bias rating; null or '' -> null (not counted)."""
    low = F.lower(bias)
    return (
        F.when(bias.isNull() | (bias == ""), F.lit(None).cast("string"))
        .when(low.contains("pro"), F.lit("pro"))
        .when(low.contains("oppose"), F.lit("oppose"))
        .otherwise(F.lit("neutral"))
    )


def article_sides(links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, article_id, side) for every linked article; side null when unrated."""
    a = articles.select(F.col("id").alias("article_id"), "source_id")
    s = sources.select(F.col("id").alias("source_id"), "bias")
    return (
        links.select("cluster_id", "article_id")
        .join(a, "article_id")
        .join(s, "source_id", "left")
        .select("cluster_id", "article_id", bias_side(F.col("bias")).alias("side"))
    )


def side_aggregates() -> list[Column]:
    """Counts per ``side`` and in all, for any grouping."""
    return [*[F.count_if(F.col("side") == k).alias(f"{k}_count") for k in ("pro", "neutral", "oppose")],
            F.count(F.lit(1)).alias("total_articles")]


def side_share(k: str) -> Column:
    """Percentage of one side among all articles counted by ``side_aggregates``."""
    n = F.col("total_articles")
    return F.when(n > 0, F.bround(F.col(f"{k}_count") / n * 100, 1)).otherwise(F.lit(0.0)).alias(f"{k}_pct")


def side_counts(sides: DataFrame) -> DataFrame:
    return sides.groupBy("cluster_id").agg(*side_aggregates())


def blindspot_metrics(
    links: DataFrame,
    articles: DataFrame,
    sources: DataFrame,
    ideal: float = fx.IDEAL_SHARE,
) -> DataFrame:
    """F-1: per cluster with at least one rated article: counts, type and balance score."""
    c = side_counts(article_sides(links, articles, sources))
    total = F.col("pro_count") + F.col("neutral_count") + F.col("oppose_count")
    c = c.withColumn("total_rated", total).filter(F.col("total_rated") > 0)
    pct = {k: F.col(f"{k}_count") / F.col("total_rated") * 100 for k in ("pro", "neutral", "oppose")}
    btype = (
        F.when((pct["oppose"] > fx.BLINDSPOT_MAJORITY) & (pct["pro"] < fx.BLINDSPOT_MINORITY),
               F.lit(fx.PRO_SAF_BLINDSPOT))
        .when((pct["pro"] > fx.BLINDSPOT_MAJORITY) & (pct["oppose"] < fx.BLINDSPOT_MINORITY),
              F.lit(fx.OPPOSE_SAF_BLINDSPOT))
        .when((pct["neutral"] > fx.NEUTRAL_ONLY_SHARE) & (F.col("total_rated") > fx.NEUTRAL_ONLY_MIN_TOTAL),
              F.lit(fx.NEUTRAL_ONLY))
        .when((pct["neutral"] < fx.PARTISAN_NEUTRAL_SHARE) & (F.col("total_rated") > fx.PARTISAN_MIN_TOTAL),
              F.lit(fx.PARTISAN_STORY))
        .otherwise(F.lit(fx.BALANCED))
    )
    spread = (F.abs(pct["pro"] - ideal) + F.abs(pct["neutral"] - ideal)) + F.abs(pct["oppose"] - ideal)
    balance = F.bround(F.greatest(F.lit(0.0), 1 - spread / 100), 2)
    return c.select(
        "cluster_id", "pro_count", "neutral_count", "oppose_count", "total_rated",
        btype.alias("blindspot_type"), balance.alias("balance_score"),
    )


def apply_blindspot(clusters: DataFrame, metrics: DataFrame) -> DataFrame:
    """F-2: write the metrics onto the cluster rows that have them; keep the others."""
    m = metrics.select(
        F.col("cluster_id").alias("_cid"),
        F.col("blindspot_type").alias("_bt"), F.col("pro_count").alias("_p"),
        F.col("neutral_count").alias("_n"), F.col("oppose_count").alias("_o"),
        F.col("balance_score").alias("_b"),
    )
    j = clusters.join(m, clusters.id == m._cid, "left")
    hit = F.col("_cid").isNotNull()
    out = j
    for col, new in (("blindspot_type", "_bt"), ("bias_coverage_pro", "_p"),
                     ("bias_coverage_neutral", "_n"), ("bias_coverage_oppose", "_o"),
                     ("bias_balance_score", "_b")):
        old = F.col(col) if col in clusters.columns else F.lit(None)
        out = out.withColumn(col, F.when(hit, F.col(new)).otherwise(old))
    return out.drop("_cid", "_bt", "_p", "_n", "_o", "_b")


def bias_distribution(links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """F-3: count and share per side; the share's denominator is *all* linked articles."""
    c = side_counts(article_sides(links, articles, sources))
    return c.select("cluster_id", "total_articles",
                    *[x for k in ("pro", "neutral", "oppose") for x in (f"{k}_count", side_share(k))])


def dominant_side(distribution: DataFrame) -> DataFrame:
    """E-18: side with the largest share (first wins ties), share rounded half-even to an integer."""
    (kp, lp), (kn, ln), (ko, lo) = fx.SIDE_LABELS
    p, n, o = F.col(f"{kp}_pct"), F.col(f"{kn}_pct"), F.col(f"{ko}_pct")
    label = F.when((p >= n) & (p >= o), F.lit(lp)).when(n >= o, F.lit(ln)).otherwise(F.lit(lo))
    value = F.when((p >= n) & (p >= o), p).when(n >= o, n).otherwise(o)
    return distribution.select(
        "cluster_id", label.alias("dominant_label"),
        F.bround(value, 0).cast("long").alias("dominant_pct"),
    )
